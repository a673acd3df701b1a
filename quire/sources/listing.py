"""Listings of folder trees, and file contents, by Spark tasks.

``binaryFile`` gathers the names of all files on the driver and then plans a task for every few files, as each counts as
``openCostInBytes`` at least: a tree of small files becomes tasks by the hundred thousand.  ``list_files`` lists a tree level by level
instead: a level's folders are rows, each task lists the folders dealt to it, and what they hold is written to the checkpoint
folder as the next level.  The driver sees no name but the root's.  ``add_content`` reads listed files the same way.

Both reach the storage through ``pyarrow.fs``, as the files sink does.  A root that is no folder there (a glob, a
single file, a store that only Spark's readers reach) is left to ``binaryFile``, with its partitions merged to few tasks.
"""
from __future__ import annotations

import os
import re
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quire.functions.paths import URI_PREFIX
from quire.session import materialize, ship_package

FOUND = "path string, modificationTime timestamp, length long, is_dir boolean"
_ARROW_FOUND = [("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("is_dir", pa.bool_())]
#: Entries, and bytes of content, that a task hands on at a time.
BATCH_ROWS = 10_000
BATCH_BYTES = 16 << 20


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def few_tasks(df: DataFrame) -> DataFrame:
    """A scan over many small files in a bounded number of tasks; rows stream through, so none holds more at a time."""
    return df.coalesce(_tasks(df.sparkSession))


def _folder(spark: SparkSession, root: str):
    """(URI for pyarrow, path inside its file system, what a listed path begins with), or None."""
    from pyarrow import fs

    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(root)
    whole = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()
    if whole.startswith("file:"):
        uri, base, prefix = "file:///", "/" + re.sub(URI_PREFIX, "", whole).strip("/"), "file:"
    else:
        try:
            base, uri = fs.FileSystem.from_uri(whole)[1], whole
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
            return None
        prefix = whole[:-len(base)] if whole.endswith(base) else re.match(URI_PREFIX, whole)[0]
    if fs.FileSystem.from_uri(uri)[0].get_file_info(base).type != fs.FileType.Directory:
        return None
    return uri, base, prefix


def _hidden(name: str) -> bool:
    """As Spark's sources hide files and folders."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(store, folder: str):
    """What a folder holds, ``BATCH_ROWS`` at a time.  Only a local one is not held whole: other stores hand it over at once."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as names:
            while part := [e.path for e in islice(names, BATCH_ROWS)]:
                yield store.get_file_info(part)
    else:
        held = store.get_file_info(fs.FileSelector(folder, recursive=False))
        yield from (held[i:i + BATCH_ROWS] for i in range(0, len(held), BATCH_ROWS))


def _lister(uri: str, name_pattern: str):
    def run(batches):
        from pyarrow import fs

        schema, named = pa.schema(_ARROW_FOUND), re.compile(name_pattern, re.S | re.A)
        store = fs.FileSystem.from_uri(uri)[0]
        for folder in (f for rb in batches for f in rb.column(0).to_pylist()):
            for held in _entries(store, folder):
                kept = [(x, x.type == fs.FileType.Directory) for x in held if x.type != fs.FileType.NotFound and not _hidden(x.base_name)]
                kept = [(x, d) for x, d in kept if d or named.fullmatch(x.base_name)]
                columns = ([x.path for x, _ in kept], [(x.mtime_ns or 0) // 1_000_000 * 1000 for x, _ in kept], [0 if d else x.size for x, d in kept], [d for _, d in kept])
                arrays = [pa.array(c, pa.int64()).cast(f.type) if pa.types.is_timestamp(f.type) else pa.array(c, f.type) for c, f in zip(columns, schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
    return run


def _reader(uri: str, prefix: str):
    def run(batches):
        from pyarrow import fs

        store = fs.FileSystem.from_uri(uri)[0]
        for rb in batches:
            held, size, first = [], 0, 0
            for i, path in enumerate(rb.column("path").to_pylist()):
                if path is None:
                    held.append(None)
                else:
                    with store.open_input_stream(path[len(prefix):]) as f:
                        held.append(f.read())
                    size += len(held[-1])
                if size >= BATCH_BYTES or i + 1 == rb.num_rows:
                    part = rb.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*rb.schema.names, "content"])
                    held, size, first = [], 0, i + 1
    return run


def list_files(spark: SparkSession, root: str, name_pattern: str = ".*", glob: str = "*", content: bool = False) -> DataFrame:
    """path, modificationTime, length (and content) of all files below ``root`` whose whole name matches ``name_pattern``.

    ``glob`` says the same for ``binaryFile``.  Names with a leading '.' or '_' are hidden, as in Spark's sources."""
    cols = ["path", "modificationTime", "length"]
    found = _folder(spark, root)
    if found is None:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        return few_tasks(df.select(*cols, *(["content"] if content else [])))
    uri, base, prefix = found
    ship_package(spark)
    level, levels = spark.createDataFrame([(base,)], "path string"), []
    while not level.isEmpty():  # as often as the tree is deep
        held = materialize(level.repartition(_tasks(spark)).mapInArrow(_lister(uri, name_pattern), FOUND), "listing")
        levels.append(held.filter("NOT is_dir"))
        level = held.filter("is_dir").select("path")
    files = reduce(DataFrame.unionByName, levels).select(F.concat(F.lit(prefix), "path").alias("path"), "modificationTime", "length")
    return add_content(files, root, glob) if content else files


def add_content(files: DataFrame, root: str, glob: str = "*") -> DataFrame:
    """``files`` with the ``content`` of the file that each ``path`` (as listed below ``root``) names, null where it is null.

    Join the names first and read after: a plan takes what tasks read for as small as its names, and would send it whole
    through the driver to all executors if it were joined."""
    spark = files.sparkSession
    found = _folder(spark, root)
    if found is None:
        held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        return files.join(few_tasks(held.select("path", "content")).hint("merge"), "path", "left").select(*files.columns, "content")
    uri, _, prefix = found
    ship_package(spark)
    schema = StructType([*files.schema.fields, StructField("content", BinaryType())])
    return files.repartition(_tasks(spark)).mapInArrow(_reader(uri, prefix), schema)
