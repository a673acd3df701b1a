"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ship_package

#: Rows per Arrow batch handed to Python workers (bounds a worker's memory with long texts).
ARROW_ROWS = 500
#: Text bytes that one numpy step works on.
SLICE_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors and bound the Arrow batches of the session."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))


def crc_remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus`` (a null id counts as the empty text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def string_bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; a null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut a batch into runs of whole rows of about ``limit`` text bytes; a longer row stands alone."""
    n = batch.num_rows
    if n == 0:
        return
    _, off = string_bytes(batch.column(column))
    start = 0
    while start < n:
        end = int(np.searchsorted(off, off[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i+1]]`` along axis 0; an empty segment gives 0."""
    n = len(bounds) - 1
    out = np.zeros((n,) + values.shape[1:], np.float64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return out


#: Bytes that separate words: space and the control range from tab to carriage return.
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in concatenated rows, and n+1 offsets of each row's words.

    Words never cross row borders."""
    inside = ~SPACE_BYTES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = off[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = off[1:-1]
    ends = ends[ends > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, off)


_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of a 64-bit hash."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0xD6E8FEB86659FD93)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal spans wherever they stand.

    One wrapping prefix sum of byte * base**position serves all spans."""
    n = len(data)
    pre = np.empty(n + 1, np.uint64)
    pre[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=pre[1:])
    inv = powers(_INV, n + 1)
    return mix64((pre[stops] - pre[starts]) * inv[starts])


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """``big`` joined with ``small`` (one row per key) on ``key``: a key's rows go to up to ``salts`` tasks, by the columns ``spread``."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str,
                    keep: Column, per_class: int, max_chars: int, seed: int) -> list[tuple[int, str]]:
    """A bounded sample of labelled texts, as (label, text) rows on the driver.

    ``keep`` (over ``_id``) says which ids may be learnt from.  About ``per_class`` rows of
    each class are taken by a hash of the id, fewer if their texts exceed ``max_chars``
    in all; both bounds hold whatever the size of the tables.  Several labels of one id
    count as their maximum; null ids, null labels and null texts teach nothing."""
    lab = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
           .filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).filter(keep)
           .groupBy("_id").agg(F.max("_y").alias("_y")))
    counts = {r["_y"]: r["n"] for r in lab.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    u = F.pmod(F.xxhash64(F.col("_id"), F.lit(seed)), F.lit(1 << 30))
    share = {y: min(1.0, per_class / n) for y, n in counts.items()}

    def take(scale: float) -> DataFrame:
        limit = {y: F.lit(int(s * scale * (1 << 30))) for y, s in share.items()}
        chosen = lab.filter(F.when(F.col("_y") == 1, u < limit.get(1, F.lit(0))).otherwise(u < limit.get(0, F.lit(0))))
        wide = F.lit(int(max(share.values()) * scale * (1 << 30)))
        texts = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
                 .filter(F.col("_text").isNotNull()).filter(u < wide))
        return texts.join(chosen, "_id")

    chars = take(1.0).agg(F.sum(F.length("_text"))).first()[0] or 0
    rows = take(min(1.0, max_chars / chars) if chars else 1.0).select("_id", "_y", "_text").collect()
    rows.sort(key=lambda r: (r["_id"], r["_text"]))
    return [(r["_y"], r["_text"]) for r in rows]
