"""Stall detection over ordered events (WIN-5, batch twin of STR-3).

A key is stalled when it stays quiet longer than the threshold (90 s for a
running job).  The batch form reports every closed gap: the previous event
of the same key (a skew-safe lag) and the event that ended the silence.
Minutes are rounded half up, as shown to the user.  ``running_stalls`` counts only the
silences of a job that runs; one that waits or has ended is not quiet.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.time import micros_between
from quire.operators.lifecycle import running_events
from quire.operators.sequence import previous_in_key

# --- Fixed values (must equal the reference's) ---
STALL_SECONDS = 90
# --- end of fixed values ---


def stalls(events: DataFrame, key: str, ts_col: str = "ts", seq_col: str = "seq",
           threshold_seconds: float = STALL_SECONDS) -> DataFrame:
    p = previous_in_key(events.select(key, ts_col, seq_col), [key], [ts_col, seq_col], [ts_col])
    gap_us = micros_between(F.col(f"prev_{ts_col}"), F.col(ts_col))
    return p.filter(gap_us > int(threshold_seconds * 1_000_000)).select(
        key, F.col(f"prev_{ts_col}").alias("gap_start"), F.col(ts_col).alias("gap_end"),
        F.floor(gap_us / 60_000_000 + 0.5).cast("bigint").alias("quiet_minutes"))


def running_stalls(events: DataFrame, job_col: str = "job_id", threshold_seconds: float = STALL_SECONDS,
                   start_kinds=("start",), progress_kinds=("progress",)) -> DataFrame:
    """Quiet gaps of running jobs, from job events ``job, ts, seq, kind, payload``: between their start, progress and end."""
    return stalls(running_events(events, job_col, start_kinds, progress_kinds), job_col, "ts", "seq", threshold_seconds)
