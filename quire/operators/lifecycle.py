"""Job lifecycle as a fold of job events - the batch twin (STR-1, JON-3, AGG-6, WIN-6, DAT-1/2).

Events: ``(job_id, seq, ts, kind, payload)`` with kind in submit, start,
progress, done, failed, cancel, died.  State machine:

    none    --submit--> queued
    queued  --start---> running (started_at)      --cancel--> cancelled (finished_at)
    running --progress-> running (progress = payload)
    running --done----> done (device, progress cleared, finished_at)
    running --failed--> failed (error, progress kept, finished_at)
    running --cancel--> cancelled (progress cleared, finished_at)
    running --died----> failed (fixed message, progress kept, finished_at)

Terminal states absorb; events for unknown or non-running jobs are dropped.
Events are ordered by (ts, seq).

Closed form used here (no sequential fold): submit = first submit; start =
first start after it; a cancel before the start (or without any start)
cancels the job in the queue; otherwise the first terminal event after the
start ends it; progress = last progress between start and end.  Each step is
an aggregate per job (partial, map-side combined) joined back to the events,
so a job with a huge number of events is never gathered in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.time import epoch_micros, micros_between
from quire.operators.sequence import global_rank
from quire.session import materialize

# --- Fixed values (must equal the reference's) ---
STATUSES = ["queued", "running", "done", "failed", "cancelled"]
DIED_MESSAGE = ("Worker process died unexpectedly "
                "(possibly out of memory — try device=cpu or a smaller page range)")
# --- end of fixed values ---

TERMINAL_EVENTS = ["done", "failed", "cancel", "died"]


def _key(ts: str = "ts", seq: str = "seq") -> Column:
    return F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"))


def _first(cond: Column, value: Column = None) -> Column:
    """Earliest (ts, seq) among rows matching ``cond`` (or its ``value``)."""
    if value is None:
        return F.min(F.when(cond, _key()))
    return F.min_by(F.when(cond, value), F.when(cond, _key()))


def _phases(events: DataFrame, job_col: str, start_kinds) -> tuple[DataFrame, DataFrame]:
    """The written event table, and per submitted job ``_submit, _start, _cancel0, _end, _end_ev``."""
    kind = F.col("kind")
    # The event base is read once per phase; checkpointing it (and the small
    # per-job table after each phase) keeps the passes linear.
    base = materialize(events.select(job_col, "ts", "seq", "kind", "payload"))
    jobs = materialize(base.groupBy(job_col).agg(_first(kind == "submit").alias("_submit"))
                       .filter(F.col("_submit").isNotNull()))
    after_submit = base.join(jobs, job_col, "inner").filter(_key() >= F.col("_submit"))
    jobs = materialize(after_submit.groupBy(job_col).agg(
        F.first("_submit").alias("_submit"),
        _first(kind.isin(*start_kinds)).alias("_start"),
        _first(kind == "cancel").alias("_cancel0")))
    after_start = F.col("_start").isNotNull() & (_key() > F.col("_start"))
    term = kind.isin(*TERMINAL_EVENTS) & after_start
    ends = base.join(jobs.select(job_col, "_start"), job_col, "inner").groupBy(job_col).agg(
        _first(term).alias("_end"),
        _first(term, F.struct(kind.alias("kind"), F.col("payload").alias("payload"))).alias("_end_ev"))
    return base, materialize(jobs.join(ends, job_col, "left"))


def _running_progress(progress_kinds) -> Column:
    """Progress of a running job: after its start and before its end."""
    return (F.col("kind").isin(*progress_kinds) & F.col("_start").isNotNull() & (_key() > F.col("_start"))
            & (F.col("_end").isNull() | (_key() < F.col("_end"))))


def _cancelled_in_queue() -> Column:
    return F.col("_cancel0").isNotNull() & (F.col("_start").isNull() | (F.col("_cancel0") < F.col("_start")))


def accepted_progress(events: DataFrame, job_col: str = "job_id", start_kinds=("start",), progress_kinds=("progress",)) -> DataFrame:
    """The progress events that reach a running job; those of unknown, queued or finished jobs are dropped (JON-3)."""
    base, jobs = _phases(events, job_col, start_kinds)
    j = base.join(jobs.filter(~_cancelled_in_queue()).select(job_col, "_start", "_end"), job_col)
    return j.filter(_running_progress(progress_kinds)).select(*base.columns)


def running_events(events: DataFrame, job_col: str = "job_id", start_kinds=("start",), progress_kinds=("progress",)) -> DataFrame:
    """What is heard of each job while it runs: its start, its progress and the event that ends it."""
    base, jobs = _phases(events, job_col, start_kinds)
    j = base.join(jobs.filter(~_cancelled_in_queue() & F.col("_start").isNotNull()).select(job_col, "_start", "_end"), job_col)
    heard = (_key() == F.col("_start")) | (_key() == F.col("_end")) | _running_progress(progress_kinds)
    return j.filter(heard).select(*base.columns)


def job_states(events: DataFrame, job_col: str = "job_id", start_kinds=("start",),
               progress_kinds=("progress",)) -> DataFrame:
    """One row per submitted job: status, error, device, progress, queued_at,
    started_at, finished_at (the type of ``ts``).

    ``start_kinds`` / ``progress_kinds`` may share a kind (an event that starts
    a queued job and is progress for a running one): the first such event is
    the start, later ones are progress."""
    base, jobs = _phases(events, job_col, start_kinds)
    prog = _running_progress(progress_kinds)
    progress_last = base.join(jobs.select(job_col, "_start", "_end"), job_col, "inner").groupBy(job_col).agg(
        F.max_by(F.when(prog, F.col("payload")), F.when(prog, _key())).alias("_progress"))
    s = jobs.join(progress_last, job_col, "left")

    cancelled_in_queue = _cancelled_in_queue()
    end_kind = F.col("_end_ev.kind")
    status = (F.when(cancelled_in_queue, "cancelled")
              .when(F.col("_start").isNull(), "queued")
              .when(F.col("_end").isNull(), "running")
              .when(end_kind == "done", "done")
              .when(end_kind == "cancel", "cancelled")
              .otherwise("failed"))
    error = (F.when(cancelled_in_queue, F.lit(None))
             .when(end_kind == "failed", F.col("_end_ev.payload"))
             .when(end_kind == "died", F.lit(DIED_MESSAGE)))
    device = F.when(~cancelled_in_queue & (end_kind == "done"), F.get_json_object(F.col("_end_ev.payload"), "$.device"))
    progress = F.when(~cancelled_in_queue & (F.col("_end").isNull() | end_kind.isin("failed", "died")),
                      F.col("_progress"))
    started = F.when(~cancelled_in_queue, F.col("_start.ts"))
    finished = F.when(cancelled_in_queue, F.col("_cancel0.ts")).otherwise(F.col("_end.ts"))
    return s.select(job_col, status.alias("status"), error.alias("error"), device.alias("device"),
                    progress.alias("progress"), F.col("_submit.ts").alias("queued_at"),
                    started.alias("started_at"), finished.alias("finished_at"))


def last_device(states: DataFrame) -> DataFrame:
    """Device known after the first job: the device of the latest finished done job (AGG-6)."""
    done = F.col("status") == "done"
    return states.agg(F.max_by(F.when(done, F.col("device")), F.when(done, F.col("finished_at"))).alias("device"))


def queue_positions(states: DataFrame, job_col: str = "job_id") -> DataFrame:
    """FIFO position of each queued job by queued_at (WIN-6), without a
    single-partition window."""
    q = states.filter(F.col("status") == "queued").select(job_col, "queued_at")
    return global_rank(q, ["queued_at", job_col], "position")


def newest_jobs(states: DataFrame, events: DataFrame, job_col: str = "job_id") -> DataFrame:
    """All jobs, newest submission first, ties in the order of submission; ``position`` counts from 1 (SRT-2)."""
    first = events.filter(F.col("kind") == "submit").groupBy(job_col).agg(F.min(_key()).getField("seq").alias("_seq"))
    dtype = states.schema["queued_at"].dataType
    j = states.join(first, job_col).withColumn("_newest", -epoch_micros(F.col("queued_at"), dtype))
    return global_rank(j, ["_newest", "_seq"], "position").drop("_newest", "_seq")


def elapsed_seconds(start: Column, end: Column, now: Column = None) -> Column:
    """Seconds between start and end (or ``now`` while running); null without a start."""
    end_ = F.coalesce(end, now if now is not None else F.localtimestamp())
    return micros_between(start, end_) / 1e6


def elapsed_text(seconds: Column) -> Column:
    """``NmSSs`` from 60 s on, else ``Ns``; rounded half up, never negative;
    empty when there is no start (DAT-1)."""
    s = F.greatest(F.floor(seconds + F.lit(0.5)), F.lit(0)).cast("long")
    txt = F.when(s >= 60, F.format_string("%dm%02ds", (s / 60).cast("long"), s % 60)).otherwise(
        F.format_string("%ds", s))
    return F.when(seconds.isNull(), F.lit("")).otherwise(txt)
