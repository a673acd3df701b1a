"""Order-dependent operators that stay balanced when one key holds most rows.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, so a
key holding a third of the data becomes a third of the job in one task.  The
helpers here first give every row an order-preserving *bucket* inside its
key, work per (key, bucket), and carry offsets across buckets.

Buckets are a pure function of the data, never of the physical plan: any
recomputation (another branch, or a task retried after an executor loss)
gets the same answer.  They come from exact, order-independent statistics:

* per key: count, min and max of the first order column (partial aggregates);
* a key is *hot* when it holds more than H = max(total / (4 * P), 100k) rows
  (P = shuffle partitions), so at most 4 * P keys are hot;
* a hot key's order range is cut into ``ceil(n / H)`` equal-width buckets,
  and each bucket still holding more than H rows is cut again the same way.
  Strings are cut by their bytes after the prefix that the range's least and
  greatest value share (all values between them share it too).
  Cold keys stay whole (bucket 0): at most H rows in one task.

A null key is a key like any other, and may be hot (joins on keys are null-safe).
Null order values come first, as in an ascending sort: bucket -1 of a hot key.  So
the answer never depends on whether a key is split.

Planning runs as a small eager job whose results are bounded by construction
(at most 4 * P hot keys; at most about 8 * P hot buckets), so they are
collected and broadcast as literal tables.  When no key is hot - the common
case - the operators reduce to one plain window over the key.

Only a burst of more than H rows inside 1/(nb1*nb2) of a key's order range,
or more than H rows sharing one order value, can still land in one task.
"""
from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.time import epoch_micros

FINE = 1 << 24          # bucket id = coarse * FINE + fine; both are at most 4 * P
MIN_HOT_ROWS = 100_000  # keys smaller than this are never split
PREFIX_BYTES = 6        # bytes of a string that one cut looks at


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_rk{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_rk{i}")) for i, k in enumerate(keys)]
    return left.join(F.broadcast(renamed), cond, how).drop(*[f"_rk{i}" for i in range(len(keys))])


def order_value(df: DataFrame, col) -> tuple[Column, bool]:
    """Order-preserving view of an ascending order column, and whether it is text.

    The column is given by name; express a descending order as a negated number.  A type that
    cannot be cut raises, so that splitting is never switched off unseen."""
    if not isinstance(col, str):
        raise TypeError("the first order column is passed by name, ascending")
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return epoch_micros(c, dt).cast("double"), False
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("double"), False
    if isinstance(dt, (T.FloatType, T.DoubleType)):  # NaN sorts last; infinities would leave no width to cut
        top = F.lit(sys.float_info.max)
        return F.when(F.isnan(c), top).when(c.isNotNull(), F.greatest(F.least(c.cast("double"), top), -top)), False
    if isinstance(dt, (T.NumericType, T.BooleanType)):
        return c.cast("double"), False
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return c.cast("binary"), True
    raise TypeError(f"rows cannot be cut by an order column of type {dt.simpleString()}")


def _text_number(value: Column, skip: Column) -> Column:
    """The PREFIX_BYTES bytes after the first ``skip`` ones as a number that keeps their order."""
    part = value.substr(skip + 1, F.lit(PREFIX_BYTES))
    return F.conv(F.rpad(F.hex(part), 2 * PREFIX_BYTES, "0"), 16, 10).cast("double")


def _shared_prefix(a: bytes | None, b: bytes | None) -> int:
    n = 0
    for x, y in zip(a or b"", b or b""):
        if x != y:
            break
        n += 1
    return n


def _text_range(lo: bytes, hi: bytes) -> tuple[int, float, float]:
    """(shared prefix, numbers of the least and the greatest value after it)."""
    skip = _shared_prefix(lo, hi)

    def number(v):
        return float(int.from_bytes(bytes(v)[skip:skip + PREFIX_BYTES].ljust(PREFIX_BYTES, b"\0"), "big"))

    return skip, number(lo), number(hi)


@dataclass
class Buckets:
    df: DataFrame        # input with ``_b`` (and ``_hot``)
    split: bool          # whether any key was cut
    keys: list[str]


def _ranges(rows, n_keys: int, text: bool):
    """Collected (keys..., least, greatest, H, buckets) -> (keys..., skip, low, high, H, buckets)."""
    for r in rows:
        keys, (lo, hi, h, nb) = tuple(r[:n_keys]), tuple(r[n_keys:])
        if lo is None:  # every order value is null
            lo, hi = (b"", b"") if text else (0.0, 0.0)
        skip, low, high = _text_range(bytes(lo), bytes(hi)) if text else (0, float(lo), float(hi))
        yield (*keys, skip, low, high, float(h), float(nb))


def bucketed(df: DataFrame, keys: list[str], order: list, min_hot_rows: int = MIN_HOT_ROWS) -> Buckets:
    """Give every row ``_b`` (bigint), an order-preserving bucket inside its key,
    and ``_hot`` (whether its key was cut)."""
    spark = df.sparkSession
    value, text = order_value(df, order[0])
    d = df.withColumn("_x", value)
    stats = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    total = stats.agg(F.sum("_n")).scalar()  # scalar subquery, evaluated with the job below
    limit = F.greatest(total / F.lit(4 * _parts(df)), F.lit(float(min_hot_rows)))
    # Each hot key holds more than total / (4 * P) rows: at most 4 * P rows come back, with at most 4 * P buckets each.
    hot_rows = (stats.filter(F.col("_n") > limit)
                .select(*keys, "_mn", "_mx", limit.alias("_h"), F.ceil(F.col("_n") / limit).cast("double").alias("_nb"))
                .collect())
    if not hot_rows:
        return Buckets(df.withColumn("_b", F.lit(0).cast("bigint")).withColumn("_hot", F.lit(False)), False, keys)
    key_fields = [df.schema[k] for k in keys]

    def cut(skip, lo, hi, nb):
        x = _text_number(F.col("_x"), F.col(skip)) if text else F.col("_x")
        width = (F.col(hi) - F.col(lo) + 1) / F.col(nb)
        return F.when(F.col("_x").isNull(), F.lit(-1)).otherwise(F.least(F.floor((x - F.col(lo)) / width), F.col(nb) - 1)).cast("bigint")

    def table(rows, extra, names):
        return spark.createDataFrame(list(rows), T.StructType(
            key_fields + extra + [T.StructField(names[0], T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in names[1:]]))

    hot = table(_ranges(hot_rows, len(keys), text), [], ["_sk", "_mn", "_mx", "_h", "_nb"])
    d1 = join_keys(d, hot, keys).withColumn(
        "_b1", F.when(F.col("_nb").isNull(), F.lit(0).cast("bigint")).otherwise(cut("_sk", "_mn", "_mx", "_nb")))
    # Heavy buckets hold more than H rows each: at most total / H = 4 * P of them.
    heavy_rows = (d1.filter(F.col("_nb").isNotNull() & (F.col("_b1") >= 0))
                  .groupBy(*keys, "_b1").agg(F.count(F.lit(1)).alias("_n2"), F.min("_x").alias("_mn2"),
                                              F.max("_x").alias("_mx2"), F.max("_h").alias("_h2"))
                  .filter(F.col("_n2") > F.col("_h2"))
                  .select(*keys, "_b1", "_mn2", "_mx2", "_h2", F.ceil(F.col("_n2") / F.col("_h2")).cast("double").alias("_nb2"))
                  .collect())
    if heavy_rows:
        heavy = table(_ranges(heavy_rows, len(keys) + 1, text), [T.StructField("_b1", T.LongType())], ["_sk2", "_mn2", "_mx2", "_h2", "_nb2"])
        d2 = join_keys(d1, heavy, [*keys, "_b1"])
        b2 = F.when(F.col("_nb2").isNull(), F.lit(0).cast("bigint")).otherwise(cut("_sk2", "_mn2", "_mx2", "_nb2"))
    else:
        d2 = d1
        b2 = F.lit(0).cast("bigint")
    out = (d2.withColumn("_b", F.col("_b1") * FINE + b2).withColumn("_hot", F.col("_nb").isNotNull())
           .drop("_x", "_sk", "_mn", "_mx", "_h", "_nb", "_b1", "_sk2", "_mn2", "_mx2", "_h2", "_nb2"))
    return Buckets(out, True, keys)


def _hot_bucket_table(b: Buckets, aggs: list[Column], names: list[str]) -> DataFrame:
    """Per (hot key, bucket) aggregates, computed eagerly: bounded by the number
    of hot buckets (about 8 * P), so the result is collected and broadcast."""
    rows = b.df.filter("_hot").groupBy(*b.keys, "_b").agg(*aggs).collect()
    agg_schema = b.df.filter("_hot").groupBy(*b.keys, "_b").agg(*aggs).schema
    return b.df.sparkSession.createDataFrame([tuple(r) for r in rows], agg_schema).select(*b.keys, "_b", *names)


def _hot_offsets(b: Buckets, agg: Column) -> DataFrame:
    """Per (hot key, bucket): ``_off`` of the buckets before it, and ``_key_sum`` of the key's buckets."""
    t = _hot_bucket_table(b, [agg.alias("_cnt")], ["_cnt"])
    w = Window.partitionBy(*b.keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return t.select(*b.keys, "_b", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"), F.sum("_cnt").over(Window.partitionBy(*b.keys)).alias("_key_sum"))


def rank_within_key(df: DataFrame, keys: list[str], order: list, out: str = "rn",
                    min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """1-based row number of each row within its key by ``order`` (callers make
    the order total, e.g. by ending it with a unique sequence number)."""
    b = bucketed(df, keys, order, min_hot_rows)
    local = b.df.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*_cols(order))))
    if not b.split:
        return local.withColumn(out, F.col(out).cast("bigint")).drop("_b", "_hot")
    off = _hot_offsets(b, F.count(F.lit(1)))
    joined = join_keys(local, off.drop("_key_sum"), [*keys, "_b"])
    return joined.withColumn(out, (F.col(out) + F.coalesce(F.col("_off"), F.lit(0))).cast("bigint")).drop(
        "_off", "_b", "_hot")


def global_rank(df: DataFrame, order: list, out: str = "rn", min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """1-based position in a total order without a single-task window: the
    whole frame is one key, cut into order buckets once it is large."""
    tagged = df.withColumn("_all", F.lit(0))
    return rank_within_key(tagged, ["_all"], order, out, min_hot_rows).drop("_all")


def previous_in_key(df: DataFrame, keys: list[str], order: list, cols: list[str],
                    prefix: str = "prev_", min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Values of the previous row of the same key (``lag``), skew-safe.

    Inside a bucket ``lag`` works directly; the first row of a hot bucket takes
    the last row of the key's previous bucket from a small eager table."""
    b = bucketed(df, keys, order, min_hot_rows)
    w = Window.partitionBy(*keys, "_b").orderBy(*_cols(order))
    local = b.df
    for c in cols:
        local = local.withColumn(prefix + c, F.lag(c).over(w))
    if not b.split:
        return local.drop("_b", "_hot")
    local = local.withColumn("_first", F.row_number().over(w) == 1)
    lasts = _hot_bucket_table(
        b, [F.max_by(F.struct(*[F.col(c).alias(c) for c in cols]), F.struct(*_cols(order))).alias("_last")],
        ["_last"])
    carry = lasts.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b"))).select(
        *keys, "_b", "_carry")
    joined = join_keys(local, carry, [*keys, "_b"])
    for c in cols:
        joined = joined.withColumn(prefix + c, F.when(F.col("_first") & F.col("_carry").isNotNull(),
                                                      F.col(f"_carry.{c}")).otherwise(F.col(prefix + c)))
    return joined.drop("_first", "_carry", "_b", "_hot")


def running_count_within_key(df: DataFrame, keys: list[str], order: list, cond: Column,
                             out: str = "running", min_hot_rows: int = MIN_HOT_ROWS, total: str | None = None) -> DataFrame:
    """Number of rows with ``cond`` true up to and including this row, per key."""
    return running_sum_within_key(df, keys, order, F.when(cond, 1).otherwise(0), out, min_hot_rows, total)


def running_sum_within_key(df: DataFrame, keys: list[str], order: list, value: Column,
                           out: str = "running", min_hot_rows: int = MIN_HOT_ROWS, total: str | None = None) -> DataFrame:
    """Sum of the whole numbers ``value`` up to and including this row, per key; ``total`` names a column for the key's whole sum."""
    b = bucketed(df, keys, order, min_hot_rows)
    part = Window.partitionBy(*keys, "_b").orderBy(*_cols(order))
    local = b.df.withColumn(out, F.sum(value).over(part.rowsBetween(Window.unboundedPreceding, 0)))
    if total:
        local = local.withColumn(total, F.sum(value).over(part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    if not b.split:
        sums = local.withColumn(out, F.col(out).cast("bigint")).drop("_b", "_hot")
        return sums.withColumn(total, F.col(total).cast("bigint")) if total else sums
    joined = join_keys(local, _hot_offsets(b, F.sum(value)), [*keys, "_b"])
    sums = joined.withColumn(out, (F.col(out) + F.coalesce(F.col("_off"), F.lit(0))).cast("bigint"))
    if total:  # the rows of a cold key stand in one bucket
        sums = sums.withColumn(total, F.coalesce(F.col("_key_sum"), F.col(total)).cast("bigint"))
    return sums.drop("_off", "_key_sum", "_b", "_hot")
