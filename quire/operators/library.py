"""Document library as a change log plus snapshots (SNK-1/2, SRC-10, SRT-1, PRJ-12).

Parquet has no MERGE, so the library is an append-only change log
``(id, seq, op, entry fields...)``; ``op`` is 'upsert' or 'delete'.

* snapshot: the last change per id by ``seq`` (``max_by`` - a partial
  aggregate, so an id with millions of changes is combined map-side) and
  keep it when it is an upsert;
* delete report: a delete ``existed`` when the id's previous change is an
  upsert (skew-safe lag, see ``sequence.previous_in_key``);
* newest first: ``created`` descending, ties in insertion order - the seq of
  the upsert that (re)inserted the id, since updating an entry keeps its place
  and deleting then re-adding moves it to the end;
* commits write ``<root>/v=<n>/`` and then ``_SUCCESS``; readers take the
  highest complete version, so a failed writer never exposes half a snapshot.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.names import sanitize_stem
from quire.functions.options import OPTIONS_STRUCT
from quire.functions.paths import relativize
from quire.functions.time import epoch_micros
from quire.operators.sequence import MIN_HOT_ROWS, global_rank, previous_in_key

ENTRY_FIELDS = ["original_name", "stem", "created", "options", "device", "seconds", "source", "parse_dir",
                "markdown_path", "content_list_path", "images_dir", "markdown_chars", "blocks"]

LIBRARY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("original_name", T.StringType()),
    T.StructField("stem", T.StringType()),
    T.StructField("created", T.TimestampType()),
    T.StructField("options", OPTIONS_STRUCT),
    T.StructField("device", T.StringType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("parse_dir", T.StringType()),
    T.StructField("markdown_path", T.StringType()),
    T.StructField("content_list_path", T.StringType()),
    T.StructField("images_dir", T.StringType()),
    T.StructField("markdown_chars", T.LongType()),
    T.StructField("blocks", T.LongType()),
])


PATH_FIELDS = ("source", "parse_dir", "markdown_path", "content_list_path", "images_dir")
#: What a done event may say about its document, as JSON.
DONE_PAYLOAD = T.StructType([
    T.StructField("device", T.StringType()), T.StructField("options", OPTIONS_STRUCT),
    *[T.StructField(c, T.StringType()) for c in PATH_FIELDS],
    T.StructField("markdown_chars", T.LongType()), T.StructField("blocks", T.LongType())])


def make_entry(result: DataFrame, id_col: str = "doc_id", name_col: str = "original_name", root: str | None = None) -> DataFrame:
    """Library entry from an extraction/job result row (PRJ-12, MTH-1).

    With ``root``, the data folder, paths are stored relative to it.
    Counts come from the result when precomputed, else from the payloads;
    seconds are rounded to one place (Spark rounds half up; Python's round
    on binary doubles can differ on exact ties such as 0.25)."""
    cols = set(result.columns)

    def opt(c, typ="string"):
        return F.col(c) if c in cols else F.lit(None).cast(typ)

    chars = F.coalesce(opt("markdown_chars", "bigint"), F.length(F.coalesce(opt("markdown"), F.lit(""))))
    blocks = F.coalesce(opt("blocks", "bigint"),
                        F.size(F.coalesce(opt("content_list", "array<string>"), F.array())))
    if root is not None:
        result = result.withColumn("_paths", F.array(*[relativize(opt(c), F.lit(root)) for c in PATH_FIELDS]))
    return result.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(name_col).alias("original_name"),
        sanitize_stem(name_col).alias("stem"),
        F.coalesce(opt("created", "timestamp"), F.current_timestamp()).alias("created"),
        opt("options", OPTIONS_STRUCT).cast(OPTIONS_STRUCT).alias("options"),
        opt("device").alias("device"),
        F.round(opt("seconds", "double"), 1).alias("seconds"),
        *[(opt(c) if root is None else F.col("_paths")[i]).alias(c) for i, c in enumerate(PATH_FIELDS)],
        chars.cast("bigint").alias("markdown_chars"),
        blocks.cast("bigint").alias("blocks"),
    )


def entries_from_done(done: DataFrame, payload_col: str = "result", root: str | None = None) -> DataFrame:
    """Library entries from done jobs (``doc_id, original_name, created, seconds`` and the done event's payload).

    Counts, paths, device and options come from the payload; what it leaves out is 0 or null."""
    d = done.withColumn("_p", F.from_json(payload_col, DONE_PAYLOAD))
    return make_entry(d.select("doc_id", "original_name", "created", "seconds", *[F.col(f"_p.{f.name}").alias(f.name) for f in DONE_PAYLOAD.fields]), root=root)


def snapshot(changes: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """Current library: last change per id, kept when it is an upsert (SNK-1, SNK-2)."""
    fields = [c for c in changes.columns if c not in (id_col, seq_col)]
    last = changes.groupBy(id_col).agg(
        F.max_by(F.struct(*[F.col(c) for c in fields + [seq_col]]), F.col(seq_col)).alias("_last"))
    return last.filter(F.col("_last.op") == "upsert").select(
        id_col, *[F.col(f"_last.{c}").alias(c) for c in fields if c != "op"], F.col(f"_last.{seq_col}").alias(seq_col))


def delete_report(changes: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """For each delete: did the id exist at that moment?"""
    prev = previous_in_key(changes.select(id_col, seq_col, "op"), [id_col], [seq_col], ["op"])
    return prev.filter(F.col("op") == "delete").select(
        id_col, seq_col, F.coalesce(F.col("prev_op") == "upsert", F.lit(False)).alias("existed"))


def removed_folders(report: DataFrame, roots=("uploads", "output"), id_col: str = "id") -> DataFrame:
    """A delete report with one row per folder that goes with the document, whether or not it was listed (SNK-2)."""
    folders = F.array(*[F.concat(F.lit(f"{r}/"), F.col(id_col).cast("string")) for r in roots])
    return report.withColumn("folder", F.explode(folders))


def insertion_order(changes: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """(id, ins_seq): the seq of the upsert that last (re)inserted each id.

    The first upsert after the id's last delete: two partial aggregates and a join on the id."""
    log = changes.select(id_col, seq_col, "op")
    gone = log.groupBy(id_col).agg(F.max(F.when(F.col("op") == "delete", F.col(seq_col))).alias("_gone"))
    after = log.filter(F.col("op") == "upsert").join(gone, id_col).filter(F.col("_gone").isNull() | (F.col(seq_col) > F.col("_gone")))
    return after.groupBy(id_col).agg(F.min(seq_col).alias("ins_seq"))


def newest_first(changes: DataFrame, id_col: str = "id", seq_col: str = "seq",
                 min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Listing order of the current library: created desc (missing = epoch), then insertion order."""
    snap = snapshot(changes, id_col, seq_col).select(id_col, "created")
    ordered = snap.join(insertion_order(changes, id_col, seq_col), id_col, "inner")
    dtype = snap.schema["created"].dataType
    created = F.coalesce(F.col("created"), F.lit("1970-01-01 00:00:00").cast(dtype))
    # newest first as an ascending numeric key, so the global rank can cut the
    # (single, hot) key into order buckets instead of one window task
    ordered = ordered.withColumn("_newest", -epoch_micros(created, dtype))
    return global_rank(ordered, ["_newest", "ins_seq"], "position", min_hot_rows).drop("_newest")


class VersionTakenError(RuntimeError):
    pass


# -- versioned snapshot storage ---------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def latest_version(spark: SparkSession, root: str, below: int | None = None) -> int | None:
    """Highest ``v=<n>`` folder under ``root`` that holds ``_SUCCESS`` (and is
    below ``below`` when given)."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return None
    best = None
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v=") and name[2:].isdigit():
            if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                n = int(name[2:])
                if below is not None and n >= below:
                    continue
                best = n if best is None or n > best else best
    return best


def read_library(spark: SparkSession, root: str, schema: T.StructType = None) -> DataFrame:
    """Latest complete snapshot; an absent library is empty (SRC-10)."""
    v = latest_version(spark, root)
    if v is None:
        return spark.createDataFrame([], schema or LIBRARY_SCHEMA)
    return spark.read.parquet(f"{root.rstrip('/')}/v={v}")


def commit_library(df: DataFrame, root: str, version: int | None = None) -> int:
    """Write a new snapshot version; Spark's committer writes ``_SUCCESS`` last.
    Re-running a commit with the same version rewrites the same folder
    (idempotent per streaming batch id)."""
    spark = df.sparkSession
    if version is not None:
        df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/v={version}")
        return version
    cur = latest_version(spark, root)
    version = 0 if cur is None else cur + 1
    # claiming the version by creating a file that must not exist: of two writers one fails
    fs, claim = _fs(spark, f"{root.rstrip('/')}/_claims/v={version}")
    try:
        fs.create(claim, False).close()
    except Exception as e:
        raise VersionTakenError(f"version {version} of {root} is being written by another commit") from e
    df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/v={version}")
    return version


def vacuum_versions(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete snapshot versions older than the newest ``keep`` complete ones
    (readers always take the newest complete version, so older ones are only
    history).  Returns the versions removed."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    done = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v=") and name[2:].isdigit() and fs.exists(
                spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            done.append((int(name[2:]), st.getPath()))
    done.sort()
    removed = []
    for v, path in done[:-keep] if keep > 0 else done:
        fs.delete(path, True)
        removed.append(v)
    return removed
