"""Job lifecycle of a stream keyed by a given job id, with eviction (STR-1), and reconciliation after a gap (STR-7).

``fold_jobs`` keeps one small state per job.  A job that ends leaves a tombstone (its status and end) for as long as late events may
still come; a timer on the watermark then removes it, so the state holds the live jobs and those that ended within
``keep``, whatever the length of the stream.  Until then late and repeated events of a finished job change nothing, as
in the batch twin (``lifecycle.job_states``).

``publish_feed`` writes each micro-batch of updates to a feed folder and a snapshot; ``missed`` gives every consumer exactly the job
states that changed after the batch it saw last, from the feed while it holds all of them, else from the snapshot.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.time import epoch_micros, instant_from_micros
from quire.operators.library import _fs
from quire.operators.lifecycle import DIED_MESSAGE, TERMINAL_EVENTS
from quire.streaming.files import latest_per_key
from quire.streaming.keyed import fold_by_key
from quire.streaming.processors import _device, _ts

OUTPUT = ("job_id string, status string, error string, device string, progress string, "
          "queued_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, result string")
COLUMNS = ["job_id", "status", "error", "device", "progress", "queued_at", "started_at", "finished_at", "result"]
FINISHED = ("done", "failed", "cancelled")


def _first(mask: np.ndarray, start: int) -> int | None:
    """Position of the first true value from ``start`` on."""
    found = np.flatnonzero(mask[start:])
    return start + int(found[0]) if len(found) else None


def fold_jobs(keep_us: int, start_kinds: tuple[str, ...], progress_kinds: tuple[str, ...]):
    """The keyed state function: one job's events of a micro-batch, in order, are folded by the positions of a few first and last
    events, not event by event.  A job's value is (status, queued, started, progress)."""

    def entomb(state, status, finished):
        state.update((status, finished, None, None))
        # a timer must lie beyond the watermark; a job that ended long ago waits for the next one
        state.setTimeoutTimestamp(max((finished + keep_us) // 1000, state.getCurrentWatermarkMs() + 1))

    def fn(key, rows, state):
        us, kind, payload = rows["us"], rows["kind"], rows["payload"]
        status, queued, started, progress = state.get if state.exists else (None, None, None, None)
        if status in FINISHED:
            entomb(state, status, queued)  # absorbs; the timer has to be set anew
            return []
        changed, at = False, 0
        error = device = result = finished = None
        if status is None:
            i = _first(kind == "submit", 0)
            if i is None:
                return []  # events of unknown jobs are dropped
            status, queued, at, changed = "queued", int(us[i]), i + 1, True
        if status == "queued":
            begin, cancel = _first(np.isin(kind, start_kinds), at), _first(kind == "cancel", at)
            if cancel is not None and (begin is None or cancel < begin):
                status, finished, changed = "cancelled", int(us[cancel]), True
            elif begin is not None:
                status, started, at, changed = "running", int(us[begin]), begin + 1, True
        if status == "running":
            end = _first(np.isin(kind, TERMINAL_EVENTS), at)
            said = np.flatnonzero(np.isin(kind[at:end], progress_kinds))
            if len(said):
                progress, changed = payload[at + int(said[-1])], True
            if end is not None:
                finished, changed = int(us[end]), True
                if kind[end] == "done":
                    status, progress, device, result = "done", None, _device(payload[end]), payload[end]
                elif kind[end] == "cancel":
                    status, progress = "cancelled", None
                else:
                    status, error = "failed", payload[end] if kind[end] == "failed" else DIED_MESSAGE
        if status in FINISHED:
            entomb(state, status, finished)
        else:
            state.update((status, queued, started, progress))
        return [(key, status, error, device, progress, _ts(queued), _ts(started), _ts(finished), result)] if changed else []

    return fn


def _forget_job(key, state):
    state.remove()
    return []


def job_updates(events: DataFrame, keep: str = "7 days", late: str = "0 seconds", start_kinds=("start",), progress_kinds=("progress",)) -> DataFrame:
    """Stream of job states, one row per changed job and micro-batch, from a stream ``job_id, ts, seq, kind, payload``.

    ``late`` is the watermark's delay: how far behind events may come; a finished job is forgotten ``keep`` after its end by the
    watermark.  A submit of a forgotten id is a new job.  Events without an id or a time are dropped."""
    us = epoch_micros(F.col("ts"), events.schema["ts"].dataType)
    rows = events.filter(F.col("job_id").isNotNull() & F.col("ts").isNotNull()).select(
        F.col("job_id").cast("string").alias("job_id"), us.alias("us"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), "kind", "payload", instant_from_micros(us).alias("event_time"))
    keep_us = int(pd.Timedelta(keep).value // 1000)
    return fold_by_key(rows.withWatermark("event_time", late), "job_id", ["us", "seq"],
                       fold_jobs(keep_us, tuple(start_kinds), tuple(progress_kinds)), OUTPUT, "update", _forget_job)


# -- feed, snapshot and reconciliation (STR-7) -----------------------------------------------------
def publish_feed(root: str, keep_batches: int):
    """A ``foreachBatch`` sink: ``<root>/feed/batch=<id>`` holds each batch's updates, ``<root>/state/v=<id>`` the latest state of every
    job with the batch that changed it last.  Feed batches older than ``keep_batches`` are removed, after the state that covers
    them is written.  A replayed batch rewrites its own folders."""
    base = root.rstrip("/")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{base}/feed/batch={batch_id}")
        now = spark.read.parquet(f"{base}/feed/batch={batch_id}").withColumn("changed", F.lit(batch_id).cast("long"))
        last = max((v for v in _versions(spark, f"{base}/state", "v") if v < batch_id), default=None)
        if last is not None:
            now = now.unionByName(spark.read.parquet(f"{base}/state/v={last}"))
        latest_per_key(now.withColumn("batch_id", F.col("changed")), ["job_id"]).write.mode("overwrite").parquet(f"{base}/state/v={batch_id}")
        _forget(spark, f"{base}/state", "v", batch_id - 1)  # the one before stays for readers at work
        _forget(spark, f"{base}/feed", "batch", batch_id - keep_batches + 1)

    return sink


def _versions(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the complete ``<name>=<n>`` folders, ascending."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    found = []
    for st in fs.listStatus(p):
        key, _, number = st.getPath().getName().partition("=")
        if key == name and number.isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            found.append(int(number))
    return sorted(found)


def _forget(spark: SparkSession, folder: str, name: str, below: int) -> None:
    for n in _versions(spark, folder, name):
        if n < below:
            fs, p = _fs(spark, f"{folder}/{name}={n}")
            fs.delete(p, True)


def missed(spark: SparkSession, root: str, consumers: DataFrame) -> DataFrame:
    """What each consumer has not seen: ``consumer, source`` ('feed' or 'snapshot') and the job columns, the latest state per job.

    ``consumers``: ``consumer, version`` (the last batch seen; null or -1: none).  A consumer whose next batch the feed
    still holds reads the feed's batches after its version; another one reads the rows of the snapshot that changed after its
    version.  Both are joins on the batch number.  A consumer that is up to date gets no row."""
    base = root.rstrip("/")
    states = _versions(spark, f"{base}/state", "v")
    if not states:
        return spark.createDataFrame([], f"consumer {consumers.schema['consumer'].dataType.simpleString()}, source string, {OUTPUT}")
    head = states[-1]
    held = [n for n in _versions(spark, f"{base}/feed", "batch") if n <= head]
    oldest = held[0] if held else head + 1
    # a state's batch is one of few numbers: the consumers go to the states, or all states would meet in as many tasks
    seen = consumers.select("consumer", F.coalesce(F.col("version").cast("long"), F.lit(-1)).alias("version")).filter(F.col("version") < head)
    wanted = seen.select("consumer", (F.col("version") + 1 >= oldest).alias("_fed"), F.explode(F.sequence(F.col("version") + 1, F.lit(head).cast("long"))).alias("batch_id"))
    state = spark.read.parquet(f"{base}/state/v={head}")
    whole = state.withColumnRenamed("changed", "batch_id").join(F.broadcast(wanted.filter("NOT _fed")), "batch_id")
    out = whole.select("consumer", F.lit("snapshot").alias("source"), *COLUMNS)
    if held:
        feed = spark.read.parquet(f"{base}/feed").withColumn("batch_id", F.col("batch").cast("long"))
        rows = latest_per_key(feed.join(F.broadcast(wanted.filter("_fed")), "batch_id").select("consumer", "batch_id", *COLUMNS), ["consumer", "job_id"])
        out = out.unionByName(rows.withColumn("source", F.lit("feed")))
    return out
