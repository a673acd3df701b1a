"""Keyed state for streams of many keys: one call of the state function per bucket of keys, not per key.

A call of ``applyInPandasWithState`` costs several milliseconds whatever its group holds (its rows are cut out and turned
into pandas, its state travels as a frame of one row), so a stream of many small keys spends its time on calls.  Here
keys are dealt by hash into ``buckets`` groups; a call orders a bucket's rows once and folds them key by key, and the
bucket's state holds one entry per live key, as JSON.  Keys keep their own value and their own timer: the bucket's timer is
the earliest of them, and a key whose timer has passed is expired whether or not other keys of its bucket had data.

The number of buckets belongs to a checkpoint like the number of shuffle partitions: a restart must keep it.  A micro-batch
rewrites the entries of the buckets that it touches.
"""
from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from quire.session import ship_package

BUCKETS = 2048
#: Stands for a null number, so that a column of a bucket stays integral; it sorts last.
NO_NUMBER = (1 << 63) - 1


class KeyState:
    """One key's value and timer, with the part of ``GroupState`` that the folds use."""

    __slots__ = ("value", "timer", "watermark")

    def __init__(self, value=None, watermark: int | None = None):
        self.value, self.timer, self.watermark = value, None, watermark

    @property
    def exists(self) -> bool:
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value) -> None:
        self.value = value

    def remove(self) -> None:
        self.value = self.timer = None

    def getCurrentWatermarkMs(self) -> int:  # noqa: N802 - as in GroupState
        return self.watermark

    def setTimeoutTimestamp(self, ms: int) -> None:  # noqa: N802 - as in GroupState
        self.timer = ms


def _plain(x):
    return x.item() if isinstance(x, np.generic) else x


def bucket_fn(fold: Callable, columns: list[str], order: list[str], names: list[str], key_type=str, expire: Callable | None = None):
    """The state function of a bucket.

    ``fold(key, rows, state)`` gets one key's rows as arrays by column, in order, and returns output rows (tuples of
    ``names``); ``expire(key, state)`` does so for a key whose timer has passed.  Without ``expire`` there are no timers."""

    def fn(_, pdfs, state):
        watermark = state.getCurrentWatermarkMs() if expire else None
        held = {k: (v, t) for k, v, t in json.loads(state.get[0])} if state.exists else {}
        out, seen = [], set()

        def take(key, st, rows):
            out.extend(rows)
            if st.exists:
                held[key] = (st.value, st.timer)
            else:
                held.pop(key, None)

        parts = [] if state.hasTimedOut else [p for p in pdfs if len(p)]
        if parts:
            pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
            codes, keys = pd.factorize(pdf["_key"], use_na_sentinel=False)
            arrays = {c: pdf[c].to_numpy() for c in columns}
            at = np.lexsort((*[arrays[c] for c in reversed(order)], codes))
            arrays, codes = {c: a[at] for c, a in arrays.items()}, codes[at]
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for lo, hi in zip(edges, edges[1:]):
                key = keys[codes[lo]]
                key = key_type(key) if isinstance(key, str) else None
                seen.add(key)
                st = KeyState(held[key][0] if key in held else None, watermark)
                take(key, st, fold(key, {c: a[lo:hi] for c, a in arrays.items()}, st))
        if expire:
            for key in [k for k, (_, t) in held.items() if t is not None and t < watermark and k not in seen]:
                st = KeyState(held[key][0], watermark)
                take(key, st, expire(key, st))
        if held:
            state.update((json.dumps([(k, v, t) for k, (v, t) in held.items()], default=_plain),))
            timers = [t for _, t in held.values() if t is not None]
            if timers:
                state.setTimeoutTimestamp(max(int(min(timers)), watermark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)  # a null beside whole numbers must not make them floats

    return fn


def fold_by_key(rows: DataFrame, key: str, order: list[str], fold: Callable, output: str, mode: str, expire: Callable | None = None,
                buckets: int = BUCKETS) -> DataFrame:
    """Stream of what ``fold`` returns for every key of ``rows`` (see ``bucket_fn``); a null key is a key like any other.

    ``order``: whole numbers; a null one comes last, as ``NO_NUMBER``."""
    ship_package(rows.sparkSession)
    whole = isinstance(rows.schema[key].dataType, T.IntegralType)
    columns = [c for c in rows.columns if c not in (key, "event_time")]
    # the watermark's column, where there is one, has to reach the stateful step
    kept = [_number(c) if c in order else F.col(c) for c in columns] + [F.col(c) for c in rows.columns if c == "event_time"]
    dealt = rows.select(F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).alias("_bucket"), F.col(key).cast("string").alias("_key"), *kept)
    names = T.StructType.fromDDL(output).fieldNames()
    fn = bucket_fn(fold, columns, order, names, int if whole else str, expire)
    return dealt.groupBy("_bucket").applyInPandasWithState(
        fn, output, "entries string", mode, GroupStateTimeout.EventTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(NO_NUMBER)).alias(c)
