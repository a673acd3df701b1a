"""Time arithmetic that does not depend on the session time zone.

The fixture timestamps are TIMESTAMP_NTZ (wall-clock values).  Casting them
to TIMESTAMP interprets the wall clock in the session time zone, which shifts
values and breaks durations around daylight-saving changes.  ``epoch_micros``
reads an NTZ value as UTC wall time with ``timestamp_diff`` (no zone
involved); TIMESTAMP values are instants already.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_micros(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), col)
    return F.unix_micros(col.cast("timestamp"))


def micros_between(start: Column, end: Column) -> Column:
    """end - start in microseconds; both of the same timestamp type."""
    return F.timestamp_diff("MICROSECOND", start, end)


def instant_from_micros(us: Column) -> Column:
    """TIMESTAMP instant for epoch micros (for watermarks)."""
    return F.timestamp_micros(us)
