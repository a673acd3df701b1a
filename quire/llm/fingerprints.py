"""Document fingerprints from prefix polynomial hashes.

``PrefixHashes`` holds modular prefix arrays of a text: the hash of any span is a difference
of two prefix values, so spans are compared in constant time and the longest common extension of
two positions is found by binary search.  Two bases modulo 2**31 - 1 give about 62 bits.

A fingerprint is the text's length, its whole hash and a sketch: the smallest hash of the text's
spans of ``SPAN`` code points in each of ``SLOTS`` classes.  Equal texts have equal fingerprints;
the share of equal slots estimates how much of their spans two texts share, wherever they stand.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import prepare

P = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_017)
#: Code points of a sketched span, sketch classes, and the value of a class without a span.
SPAN, SLOTS, EMPTY = 16, 32, 0xFFFF
#: Code points worked on at a time.
BLOCK = 1 << 20
_TABLES: dict[int, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    p = np.uint64(P)
    x = (x & p) + (x >> np.uint64(31))
    x = (x & p) + (x >> np.uint64(31))
    return x - p * (x >= p)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo P; kept, and doubled when a longer text comes."""
    have = _TABLES.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, _fold(have * np.uint64(pow(base, len(have), P)))])
    _TABLES[base] = have
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHashes:
    """Prefix arrays of one text (a string or its code points) under each base."""

    def __init__(self, text, bases=BASES):
        code = text if isinstance(text, np.ndarray) else code_points(text)
        self.n, self.bases, self.prefix = len(code), bases, []
        value = code.astype(np.uint64) + np.uint64(1)
        for base in bases:
            pre = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_fold(value * _powers(base, self.n)), out=pre[1:])
            self.prefix.append(_fold(pre))

    def span(self, start, stop, k: int = 0):
        """Hash of the span [start, stop) under base ``k``, the same wherever the span stands."""
        d = _fold(self.prefix[k][stop] + np.uint64(P) - self.prefix[k][start])
        return _fold(d * _powers(pow(self.bases[k], -1, P), self.n + 1)[start])


def spans_equal(a: PrefixHashes, i, b: PrefixHashes, j, length):
    """Whether a[i:i+length] equals b[j:j+length]; positions and lengths may be arrays."""
    i, j = np.asarray(i), np.asarray(j)
    return np.logical_and.reduce([a.span(i, i + length, k) == b.span(j, j + length, k) for k in range(len(a.bases))])


def longest_common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:], by binary search over span equality."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if spans_equal(a, i, b, j, mid) else (low, mid - 1)
    return low


def _windows(codes: np.ndarray):
    """(starts, slots, values) of all spans of SPAN code points, block by block."""
    for s in range(0, max(len(codes) - SPAN + 1, 0), BLOCK):
        h = PrefixHashes(codes[s:s + BLOCK + SPAN - 1], BASES[:1])
        at = np.arange(h.n - SPAN + 1)
        v = h.span(at, at + SPAN) * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        yield at + s, (v >> np.uint64(59)).astype(np.int64), (v >> np.uint64(16)).astype(np.uint16) & np.uint16(0x7FFF)


def _whole(codes: np.ndarray, off: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Hashes (rows x bases) of the first ``take[i]`` code points of each row."""
    out = np.zeros((len(take), len(BASES)), np.uint64)
    stop = off[:-1] + take
    for s in range(0, len(codes), BLOCK):
        e = min(s + BLOCK, len(codes))
        rows = np.flatnonzero((off[:-1] < e) & (stop > s))
        if not len(rows):
            continue
        h = PrefixHashes(codes[s:e])
        a, b = np.maximum(off[:-1][rows], s), np.minimum(stop[rows], e)
        for k, base in enumerate(BASES):
            part = h.span(a - s, b - s, k)
            lead = a - off[:-1][rows]
            for r in np.flatnonzero(lead):  # the few rows that an earlier block began
                part[r] = int(part[r]) * pow(base, int(lead[r]), P) % P
            out[rows, k] = (out[rows, k] + part) % np.uint64(P)
    return out


def _spell(n: int, whole, sketch) -> str:
    return f"{n:x}-{int(whole[0]):08x}{int(whole[1]):08x}-" + sketch.astype(">u2").tobytes().hex()


def fingerprint(text: str | None) -> str:
    """Fingerprint of one text; null counts as empty."""
    codes = code_points(text or "")
    sketch = np.full(SLOTS, EMPTY, np.uint16)
    for _, slot, low in _windows(codes):
        np.minimum.at(sketch, slot, low)
    n = np.array([len(codes)])
    return _spell(len(codes), _whole(codes, np.array([0, len(codes)]), n)[0], sketch)


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans (Dice) of the texts behind two fingerprints, 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition("-")[2]), ">u2") for f in (a, b))
    return float(_like(x[None], y[None], np.array([False]))[0])


def _like(x: np.ndarray, y: np.ndarray, equal: np.ndarray) -> np.ndarray:
    any_ = ((x != EMPTY) | (y != EMPTY)).sum(1)
    same = ((x == y) & (x != EMPTY)).sum(1)
    return np.where(equal, 1.0, 2 * same / np.maximum(any_ + same, 1))


def compare_edited(texts: list[str]) -> list[tuple]:
    """For all but the last text: (n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text keeps all but the last floor(n/2) code points and goes on with the first as many
    (or all) of the next text.  Its hash and sketch come from the prefix arrays of the two texts
    and the few spans across the joint."""
    n = np.array([len(t) for t in texts])
    off = np.concatenate([[0], np.cumsum(n)])
    codes = code_points("".join(texts))
    rows = len(texts) - 1
    keep = n[:-1] - n[:-1] // 2
    add = np.minimum(n[:-1] // 2, n[1:])
    sketch = np.full((rows + 1) * SLOTS, EMPTY, np.uint16)
    edited = np.full(rows * SLOTS, EMPTY, np.uint16)
    for at, slot, low in _windows(codes):
        own = np.searchsorted(off, at, "right") - 1
        stop = at + SPAN
        inside = stop <= off[own + 1]
        own, slot, low, stop = own[inside], slot[inside], low[inside], stop[inside]
        np.minimum.at(sketch, own * SLOTS + slot, low)
        head = np.append(keep, -1)[own] >= stop - off[own]
        np.minimum.at(edited, own[head] * SLOTS + slot[head], low[head])
        lead = np.append(-1, add)[own] >= stop - off[own]
        np.minimum.at(edited, (own[lead] - 1) * SLOTS + slot[lead], low[lead])
    joints = [codes[off[i] + max(keep[i] - SPAN + 1, 0):off[i] + keep[i]] for i in range(rows)]
    tails = [codes[off[i + 1]:off[i + 1] + min(add[i], SPAN - 1)] for i in range(rows)]
    strip = np.concatenate([x for pair in zip(joints, tails) for x in pair]) if rows else codes[:0]
    cut = np.concatenate([[0], np.cumsum([len(a) + len(b) for a, b in zip(joints, tails)])]).astype(np.int64)
    for at, slot, low in _windows(strip):
        own = np.searchsorted(cut, at, "right") - 1
        inside = at + SPAN <= cut[own + 1]
        np.minimum.at(edited, own[inside] * SLOTS + slot[inside], low[inside])
    sketch, edited = sketch.reshape(-1, SLOTS), edited.reshape(-1, SLOTS)
    whole = _whole(codes, off, n)
    kept = _whole(codes, off, np.append(keep, 0))[:-1]
    added = _whole(codes, off, np.append(0, add))[1:]
    out = []
    near_next = _like(sketch[:-1], sketch[1:], (n[:-1] == n[1:]) & (whole[:-1] == whole[1:]).all(1))
    prints = []
    for i in range(rows):
        joined = [(int(kept[i, k]) + int(added[i, k]) * pow(b, int(keep[i]), P)) % P for k, b in enumerate(BASES)]
        prints.append((_spell(int(n[i]), whole[i], sketch[i]), _spell(int(keep[i] + add[i]), joined, edited[i])))
    near_edited = _like(sketch[:-1], edited, np.array([a == b for a, b in prints], bool))
    for i in range(rows):
        text = texts[i][:keep[i]] + texts[i + 1][:add[i]]
        out.append((int(n[i]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), *prints[i], float(near_edited[i]), float(near_next[i])))
    return out


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``_id, _text, _halo``, dealt so that each partition holds a run of the order by id
    descending (ties by text, null ids last), sorted, and after it, marked ``_halo``, what follows the run.

    The runs are cut at quantiles of the ids, one per shuffle partition; the text of each row
    moves once, but for the first id of each run, which also goes to the run before."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    cuts = src.agg(F.percentile_approx("_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))
    last = len(cuts) + 1  # runs count from the highest ids; null ids form the last

    def run_of(ids: pd.Series) -> np.ndarray:
        known = ids.notna().to_numpy()
        at = np.full(len(ids), last)
        at[known] = len(cuts) - np.searchsorted(cuts, ids[known].to_numpy(np.int64), "right")
        return at

    @F.pandas_udf("int")
    def own_run(ids: pd.Series) -> pd.Series:
        return pd.Series(run_of(ids))

    heads = {r["run"]: r["top"] for r in src.select(own_run("_id").alias("run"), "_id").groupBy("run").agg(F.max("_id").alias("top")).collect()}
    order = sorted(heads)
    before = {run: order[i - 1] for i, run in enumerate(order)}

    @F.pandas_udf("array<struct<run:int,halo:boolean>>")
    def places(ids: pd.Series) -> pd.Series:
        def of(run, i):
            top = heads.get(run)
            first = pd.isna(i) if top is None else i == top
            return [{"run": int(run), "halo": False}] + [{"run": int(before[run]), "halo": True}] * bool(first)

        return pd.Series([of(run, i) for run, i in zip(run_of(ids), ids)])

    dealt = src.select("_id", "_text", F.explode(places("_id")).alias("_at")).select("_id", "_text", F.col("_at.run").alias("_run"), F.col("_at.halo").alias("_halo"))
    return dealt.repartitionById(last + 1, F.col("_run")).sortWithinPartitions("_halo", F.desc_nulls_last("_id"), "_text").select("_id", "_text", "_halo")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty; the row after the last is the first (a single row follows itself);
    whole texts are read in blocks, whatever their length; other columns are not read."""
    prepare(docs.sparkSession)
    names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def done(ids, texts):
        got = compare_edited(texts)
        return pa.RecordBatch.from_arrays([pa.array(ids, types[0])] + [pa.array([g[i] for g in got], t) for i, t in enumerate(types[1:])], names)

    def run(batches):
        ids, texts, size, ended = [], [], 0, False
        for batch in batches:
            for i, text, halo in zip(*(c.to_pylist() for c in batch.columns)):
                if ended:
                    continue
                if halo:
                    yield done(ids, [*texts, text])
                    ended = True
                    continue
                if size >= BLOCK:
                    yield done(ids, [*texts, text])
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)

    out = with_next(docs, id_col, text_col).mapInArrow(run, "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("_id", id_col)
