"""Stream plumbing: time-ordered file drops derived from tables, and a runner
that drives a streaming query to completion with an idempotent sink.

``drop_files`` splits a table into ``n`` drops by equal-width ranges of an
order column (min/max are exact, so the split is deterministic) and writes
them one after another, each as the same number of files, so a file stream
with ``maxFilesPerTrigger`` set to that number takes one whole drop per
micro-batch - per-key arrival order equals time order, which is what makes a
stream replay equal to its batch twin.

``run_available_now`` starts the query with ``trigger(availableNow=True)`` and
a ``foreachBatch`` sink that overwrites ``<out>/batch=<id>``: a retried batch
rewrites its own folder, so the sink is idempotent per batch id.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.sequence import order_value
from quire.session import scratch_path


def files_per_drop(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism // 2)


def drop_files(df: DataFrame, order_col: str, n: int, name: str) -> str:
    """Write ``df`` as ``n`` time-ordered drops of ``files_per_drop`` files each
    (round-robin, so every drop has exactly that many files); returns the folder.
    Drops are written one after another, so every file of drop k is older than
    every file of drop k + 1; reading with ``maxFilesPerTrigger`` equal to the
    files per drop makes each micro-batch exactly one drop."""
    spark = df.sparkSession
    folder = scratch_path(spark, name)
    x, text = order_value(df, order_col)
    if text:
        raise TypeError("drops are cut by a number or a time")
    lo, hi = df.agg(F.min(x), F.max(x)).first()  # one row
    if lo is None:
        lo = hi = 0.0
    part = F.least(F.floor((x - F.lit(lo)) * n / F.lit(hi - lo + 1)), F.lit(n - 1))
    tagged = df.withColumn("_drop", part.cast("int"))
    k = files_per_drop(spark)
    for i in range(n):  # n is a small fixed number of drops, not data-dependent
        (tagged.filter(F.col("_drop") == i).drop("_drop").repartition(k)
         .write.mode("overwrite").parquet(f"{folder}/drop={i:05d}"))
    return folder


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    files_per_trigger = files_per_trigger or files_per_drop(spark)
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("recursiveFileLookup", "true").parquet(folder))


def run_available_now(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run to completion; return everything the sink received, with ``batch_id``."""
    spark = stream.sparkSession
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id:09d}")

    q = (stream.writeStream.foreachBatch(sink).outputMode(output_mode)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema.add("batch_id", "int"))  # no batch came
    return spark.read.parquet(out).withColumnRenamed("batch", "batch_id")


def latest_per_key(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Update-mode output -> current snapshot: the last update per key (STR-7)."""
    cols = [c for c in updates.columns if c not in keys and c != "batch_id"]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("_s"))
    return last.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in cols])
