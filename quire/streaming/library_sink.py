"""Library maintenance from the job stream (STR-6, STR-7).

Every micro-batch of job updates is folded into the library by a
``foreachBatch`` sink:

1. done jobs become library entries (``entries_from_done``) and are written to
   ``<root>/changes/batch=<id>`` (overwrite: a replayed batch rewrites its
   own folder);
2. the entries are committed to the bucketed snapshot under ``<root>/library``
   (``operators.buckets``): only the buckets that hold a touched id are
   rewritten, and a replayed batch, known by its tag, is committed once;
3. versions older than the newest two are removed (the change log keeps the
   history).

Readers take the newest manifest (``buckets.read_buckets``), which is
the authoritative state the event feed cannot replay (STR-7).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.time import micros_between
from quire.operators.buckets import commit_changes, read_buckets, vacuum
from quire.operators.library import LIBRARY_SCHEMA, entries_from_done

SNAPSHOT_SCHEMA = T.StructType([*LIBRARY_SCHEMA.fields, T.StructField("seq", T.LongType())])


def done_entries(updates: DataFrame, root: str | None = None) -> DataFrame:
    """Job updates -> library entries for the jobs that finished as done, from their done payloads."""
    done = updates.filter(F.col("status") == "done")
    run = micros_between(F.col("started_at"), F.col("finished_at")) / 1e6
    result = done.select(
        F.col("job_id").alias("doc_id"),
        # the name that the upload had, where the done event tells it
        F.coalesce(F.get_json_object("result", "$.original_name"), F.concat(F.col("job_id"), F.lit(".pdf"))).alias("original_name"),
        F.col("finished_at").cast("timestamp").alias("created"), run.alias("seconds"), "result")
    return entries_from_done(result, root=root)


def library_sink(root: str, data_root: str | None = None):
    base = root.rstrip("/")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entries = done_entries(batch, data_root).withColumn("seq", F.lit(batch_id).cast("long")).withColumn(
            "op", F.lit("upsert"))
        entries.write.mode("overwrite").parquet(f"{base}/changes/batch={batch_id:09d}")
        current = spark.read.parquet(f"{base}/changes/batch={batch_id:09d}")
        commit_changes(current.select(*SNAPSHOT_SCHEMA.names, "op"), f"{base}/library", writer="stream", tag=batch_id)
        vacuum(spark, f"{base}/library", keep=2)

    return sink


def read_stream_library(spark: SparkSession, root: str) -> DataFrame:
    """The library that ``library_sink`` keeps under ``root``."""
    return read_buckets(spark, f"{root.rstrip('/')}/library", SNAPSHOT_SCHEMA)
