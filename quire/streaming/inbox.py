"""An inbox of uploads as a stream (STR-4).

A file stream over the inbox itself keeps the status of every upload on the driver while it lists, the names of all it has
seen for as long as it runs, and plans its listing by thousands of tasks.  Here tasks list the inbox (``sources.listing``): a scan
appends the uploads that no earlier scan found to a Parquet table, and the stream reads the files of that table.  The driver
knows these, one per ``UPLOADS_PER_FILE`` at most and a few per scan, and no upload.

    scan_inbox(spark, inbox, found)        # before each availableNow run, or now and then beside a running query
    uploads = inbox_stream(spark, found)   # the query's checkpoint says which scans it has read
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.session import materialize
from quire.sources.listing import list_files

UPLOAD = "path string, modificationTime timestamp, length long"
UPLOADS_PER_FILE = 50_000


def scan_inbox(spark: SparkSession, inbox: str, found: str) -> None:
    """Append the files below ``inbox`` to ``found`` that it does not hold yet.

    As in a file stream a file is known by its path and taken once, also if it changes later, and ``found`` belongs to one
    scanner at a time.  A scan that ends halfway has appended some of its files; the next one appends the others."""
    files = list_files(spark, inbox)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        known = spark.read.schema(UPLOAD).parquet(found).select("path")
        files = materialize(files.join(known.hint("merge"), "path", "left_anti"), "uploads")
        if files.isEmpty():
            return  # no empty file for every scan
    files.write.mode("append").option("maxRecordsPerFile", UPLOADS_PER_FILE).parquet(found)


def inbox_stream(spark: SparkSession, found: str) -> DataFrame:
    """The stream of the uploads that scans append to ``found``."""
    return spark.readStream.schema(UPLOAD).parquet(found)
