"""Leading-edge throttle per key (WIN-3, WIN-4, STR-2 batch twin).

Rule: per key, in (ts, seq) order, emit the first event, then every event at
least ``interval`` after the last *emitted* one; others are dropped (never
coalesced).  This is a greedy recurrence - not a time bucket and not a
``lag`` test - and a key may hold a third of all events, so it runs on
order buckets (``sequence.bucketed``: hot keys are cut into buckets, cold
keys stay whole) in three steps, all inside Spark tasks:

1. hot keys only, per partition of (key, bucket) (numpy, vectorised): for each event
   ``next`` = first event of the same bucket at least ``interval`` later;
   chains are followed by pointer doubling.  A hot key's later bucket
   continues the bucket before it, so its exit state is tabulated for every
   possible entry: only events within ``interval`` of the bucket start can be
   its first emission, and of neighbours with one exit state only the last is kept.
2. per hot key: walk the buckets in order and fix the entry state of each continued bucket.
   The walk holds the key's tabulated breakpoints: few where chains merge, but as many as there are events
   where a bucket is shorter than the interval - an open limit, see the README.
3. per partition again: the entry states (one per hot bucket - bounded by
   the bucketing, so they are broadcast) seed the chains; every row gets
   ``emitted``.  Rows stream through in Arrow batches: all that is carried from batch to batch is
   the current segment and its last emission.  Cold keys start fresh and need no summary at all.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.time import epoch_micros
from quire.operators.sequence import MIN_HOT_ROWS, bucketed, join_keys
from quire.session import ship_package

_BIG = 1 << 62


def _segments(keys) -> np.ndarray:
    """Start index of every run of equal keys (rows sorted by key)."""
    k = keys if isinstance(keys, (pd.Series, pd.DataFrame)) else pd.Series(keys)
    change = (k != k.shift()) & ~(k.isna() & k.shift().isna())  # a null key is one key
    change = (change.any(axis=1) if isinstance(change, pd.DataFrame) else change).to_numpy().copy()
    change[0] = True
    return np.flatnonzero(change)


def _next_pointers(t: np.ndarray, starts: np.ndarray, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """nxt[i] = first index j in i's segment with t[j] >= t[i] + interval, or i
    itself when there is none (a self loop marks the chain end)."""
    m = len(t)
    ends = np.append(starts[1:], m)
    seg_of = np.repeat(np.arange(len(starts)), ends - starts)
    seg_end = ends[seg_of]
    nxt = np.empty(m, dtype=np.int64)
    # Lay segments out on one axis with gaps wider than the interval, so one
    # searchsorted serves all of them; groups keep the axis inside int64.
    g0 = 0
    while g0 < len(starts):
        base, g1 = 0, g0
        bases = []
        while g1 < len(starts):
            span = int(t[ends[g1] - 1] - t[starts[g1]])
            if bases and base + span + interval + 1 >= _BIG:
                break
            bases.append(base)
            base += span + interval + 1
            g1 += 1
        lo, hi = starts[g0], ends[g1 - 1]
        rel_seg = seg_of[lo:hi] - g0
        axis = (t[lo:hi] - t[starts[seg_of[lo:hi]]]) + np.asarray(bases, dtype=np.int64)[rel_seg]
        nxt[lo:hi] = np.searchsorted(axis, axis + interval, side="left") + lo
        g0 = g1
    idx = np.arange(m)
    nxt = np.where(nxt >= seg_end, idx, nxt)
    return nxt, seg_end


def _terminal(nxt: np.ndarray) -> np.ndarray:
    """Last element of the chain from every index (pointer doubling)."""
    jump = nxt.copy()
    while True:
        nj = jump[jump]
        if np.array_equal(nj, jump):
            return jump
        jump = nj


def _mark_chains(nxt: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Boolean mask of every index on the chains starting at ``firsts``."""
    m = len(nxt)
    mark = np.zeros(m, dtype=bool)
    if len(firsts) == 0:
        return mark
    mark[firsts] = True
    jump = nxt.copy()
    while True:
        new = mark.copy()
        new[jump[mark]] = True
        if np.array_equal(new, mark):  # closed under the jump: every chain has ended
            return mark
        mark, jump = new, jump[jump]


def _same_segment(a: pa.Table, b: pa.Table, key: str) -> bool:
    """Whether the last row of ``a`` and the first of ``b`` are of one (key, bucket)."""
    return all(a.column(c)[a.num_rows - 1].as_py() == b.column(c)[0].as_py() for c in (key, "_b"))


def _micros(df: DataFrame, ts_col: str):
    return epoch_micros(F.col(ts_col), df.schema[ts_col].dataType)


def throttle(df: DataFrame, key: str, ts_col: str, seq_col: str, interval_seconds: float,
             out: str = "emitted", min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Add boolean ``out``: whether the leading-edge throttle emits the row (never one without a time)."""
    ship_package(df.sparkSession)
    interval = int(round(interval_seconds * 1_000_000))
    key_type = df.schema[key].dataType
    timed = df.withColumn("_t", _micros(df, ts_col))
    untimed = timed.filter(F.col("_t").isNull()).drop("_t").withColumn(out, F.lit(False))
    b = bucketed(timed.filter(F.col("_t").isNotNull()), [key], ["_t", seq_col], min_hot_rows)
    parts = (b.df.repartition(_parts(df), key, "_b")
             .sortWithinPartitions(key, "_b", "_t", seq_col))

    summary_schema = T.StructType([
        T.StructField(key, key_type), T.StructField("_b", T.LongType()),
        T.StructField("cand_t", T.LongType()), T.StructField("exit_t", T.LongType())])

    def summarize(batches):
        """Per hot bucket, exit state for every possible first emission.  A bucket holds about
        total / (4 * shuffle partitions) rows at most; one is looked at at a time."""
        held: list[pa.Table] = []

        def rows_of(tbl: pa.Table):
            t = tbl.column("_t").to_numpy().astype(np.int64)
            nxt, _ = _next_pointers(t, np.array([0]), interval)
            exits = t[_terminal(nxt)]
            if tbl.column("_b")[0].as_py() == first_bucket(tbl):  # the key's first bucket starts fresh
                cand_t, exit_t = t[:1], exits[:1]
            else:  # continued: the first emission is within the interval of the start, or nothing
                c = int(np.searchsorted(t, t[0] + interval, side="left"))
                cand_t, exit_t = t[:c + 1], exits[:c + 1]
                last = np.append(exit_t[1:] != exit_t[:-1], True)
                cand_t, exit_t = cand_t[last], exit_t[last]
            n = len(cand_t)
            return pa.RecordBatch.from_arrays(
                [tbl.column(key).combine_chunks().take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, tbl.column("_b")[0].as_py())), pa.array(cand_t), pa.array(exit_t)],
                [key, "_b", "cand_t", "exit_t"])

        def first_bucket(tbl):
            return tbl.column("_first")[0].as_py()

        for batch in batches:
            tbl = pa.Table.from_batches([batch])
            if not tbl.num_rows:
                continue
            cut = [*_segments(pd.DataFrame({"k": tbl.column(key).to_pandas(), "b": tbl.column("_b").to_numpy()})), tbl.num_rows]
            for i, (s, e) in enumerate(zip(cut, cut[1:])):
                part = tbl.slice(s, e - s)
                if i == 0 and held and not _same_segment(held[-1], part, key):
                    yield rows_of(pa.concat_tables(held))
                    held = []
                held.append(part)
                if i < len(cut) - 2:
                    yield rows_of(pa.concat_tables(held))
                    held = []
        if held:
            yield rows_of(pa.concat_tables(held))

    entry_schema = T.StructType([T.StructField(key, key_type), T.StructField("_b", T.LongType()),
                                 T.StructField("_entry", T.LongType())])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        """Walk one hot key's buckets in order and fix each continued bucket's entry."""
        pdf = pdf.sort_values(["_b", "cand_t"], kind="stable")
        bucket, cand, exits = (pdf[c].to_numpy(np.int64) for c in ("_b", "cand_t", "exit_t"))
        cut = np.append(_segments(pd.Series(bucket)), len(bucket))
        out_rows, last = [], None
        for s, e in zip(cut, cut[1:]):
            if last is None:
                last = int(exits[s])
                continue
            out_rows.append((pdf[key].iloc[0], int(bucket[s]), last))
            at = s + int(np.searchsorted(cand[s:e], last + interval, side="left"))
            last = int(exits[at]) if at < e else last
        return pd.DataFrame(out_rows, columns=[key, "_b", "_entry"])

    if b.split:
        # One entry per bucket of a hot key; hot buckets are bounded by the
        # bucketing (see sequence.bucketed), so the entries are computed once,
        # eagerly, and broadcast as a literal table.
        hot = parts.filter("_hot")
        starts = hot.groupBy(key).agg(F.min("_b").alias("_first"))
        tagged = join_keys(hot.select(key, "_b", "_t", seq_col), starts, [key]).sortWithinPartitions(key, "_b", "_t", seq_col)
        rows = tagged.mapInArrow(summarize, summary_schema).groupBy(key).applyInPandas(compose, entry_schema).collect()
        entries = df.sparkSession.createDataFrame([tuple(r) for r in rows], entry_schema)
        seeded = join_keys(parts, entries, [key, "_b"])
    else:
        seeded = parts.withColumn("_entry", F.lit(None).cast("long"))
    seeded = seeded.sortWithinPartitions(key, "_b", "_t", seq_col)
    out_schema = T.StructType([f for f in seeded.schema.fields if f.name != "_entry"]
                              + [T.StructField(out, T.BooleanType())])

    def mark(batches):
        before, last = None, None  # the segment that the previous batch ended in, and its last emission
        for batch in batches:
            tbl = pa.Table.from_batches([batch])
            if not tbl.num_rows:
                continue
            t = tbl.column("_t").to_numpy().astype(np.int64)
            entry = tbl.column("_entry").to_pylist()
            starts = _segments(pd.DataFrame({"k": tbl.column(key).to_pandas(), "b": tbl.column("_b").to_numpy()}))
            nxt, seg_end = _next_pointers(t, starts, interval)
            firsts = []
            carried = before is not None and _same_segment(before, tbl, key)
            for st in starts:
                e = last if st == 0 and carried else entry[st]
                if e is None:
                    firsts.append(int(st))
                else:
                    j = int(np.searchsorted(t[st:seg_end[st]], int(e) + interval, side="left")) + int(st)
                    if j < seg_end[st]:
                        firsts.append(j)
            flags = _mark_chains(nxt, np.asarray(firsts, dtype=np.int64))
            emitted = np.flatnonzero(flags[starts[-1]:])
            if len(emitted):
                last = int(t[starts[-1] + emitted[-1]])
            elif not (len(starts) == 1 and carried):
                last = entry[starts[-1]]
            before = tbl.slice(tbl.num_rows - 1)
            yield from tbl.drop(["_entry"]).append_column(out, pa.array(flags, type=pa.bool_())).to_batches()

    return seeded.mapInArrow(mark, out_schema).drop("_t", "_b", "_hot").unionByName(untimed)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _arrow(dt):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(dt)
