"""SimHash near-duplicates by a segment-popcount grid.

A fingerprint is mapped to the bit counts of its 2-bit segments.  The Manhattan distance
of two such vectors never exceeds the fingerprints' Hamming distance, so links are found by a range
join on the grid of count vectors and then verified exactly.  The segments are cut into parts so
that a pair within ``max_bits`` differs by at most one count in some part: there the cells are
equal, or one unit step apart.  Two cells one step apart have counts of unlike parity, so only
fingerprints of odd parity send copies to neighbouring cells.

Distinct fingerprints are joined, never documents: copies stand behind one row.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_slices, prepare
from quire.llm.components import connected_components
from quire.session import materialize

SEED = 42
_SEGMENTS = 32
_LOW = 0x5555555555555555


def simhash(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' hashes.

    A-Z are lower-cased; words end at space, tab, newline, vertical tab, form feed and return; a
    text of fewer than ``shingle`` words is one shingle; without words (or null) it is 0."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    join = b" ".join
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for s in range(0, n, 1 << 16):  # a long text in pieces
        piece = words[s:min(s + (1 << 16), n) + shingle - 1]
        h = np.array([digest(join(w), SEED) for w in zip(*[piece[k:] for k in range(shingle)])], ">u8")
        total += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None, shingle: int = 3, out_col: str = "fp") -> DataFrame:
    """Columns ``carry`` (default ``doc_id``) and ``out_col`` (the fingerprint's bits as a signed long) for each row."""
    prepare(docs.sparkSession)
    carry = ["doc_id"] if carry is None else carry
    src = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("_text"))
    schema = "".join(f"c{i} {src.schema[i].dataType.simpleString()}, " for i in range(len(carry)))

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, "_text"):
                fp = np.array([simhash(t, shingle) for t in part.column("_text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp)], [*part.schema.names[:-1], "fp"])

    out = src.mapInArrow(run, f"{schema}fp long")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], F.col("fp").alias(out_col))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _bits(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(_signed(mask)).cast("long"))


def _counts(bits: Column) -> Column:
    """Bit counts of the 32 two-bit segments, packed in the segments' own places."""
    high, low = _bits(F.shiftrightunsigned(bits, 1), _LOW), _bits(bits, _LOW)
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseXOR(low))


def _steps(cell: Column, first: int, last: int) -> Column:
    """The cells one unit step away in segments first..last-1."""
    out = []
    for i in range(first, last):
        field = _bits(F.shiftrightunsigned(cell, 2 * i), 3)
        rest = _bits(cell, ~(3 << 2 * i) & (1 << 64) - 1)
        one = rest.bitwiseOR(F.lit(_signed(1 << 2 * i)).cast("long"))
        two = rest.bitwiseOR(F.lit(_signed(2 << 2 * i)).cast("long"))
        out += [F.when(field == 1, rest).otherwise(one), F.when(field == 1, two)]
    return F.array_compact(F.array(*out))


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs ``a``, ``b`` of different fingerprints in ``fps`` (distinct, column ``fp``) at most ``max_bits`` apart.

    A pair may come more than once."""
    if not 0 <= max_bits < _SEGMENTS:
        raise ValueError("max_bits out of range")
    parts = (max_bits + 2) // 2
    edges = [_SEGMENTS * i // parts for i in range(parts + 1)]
    centres, sent = [], []
    for i, (first, last) in enumerate(zip(edges, edges[1:])):
        mask = (1 << 2 * last) - (1 << 2 * first)
        cell = fps.select("fp", F.lit(i).alias("part"), _counts(_bits(F.col("fp"), mask)).alias("cell"), (F.bit_count(_bits(F.col("fp"), mask)) % 2).alias("odd"))
        centres.append(cell.select("part", "cell", F.col("fp").alias("a"), F.lit(False).alias("step")))
        if max_bits:
            sent.append(cell.filter("odd = 1").select("part", F.explode(_steps(F.col("cell"), first, last)).alias("cell"), F.col("fp").alias("a"), F.lit(True).alias("step")))
    all_centres = centres[0]
    for c in centres[1:]:
        all_centres = all_centres.union(c)
    left = all_centres
    for s in sent:
        left = left.union(s)
    right = all_centres.select(F.col("part").alias("p"), F.col("cell").alias("c"), F.col("a").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return left.join(right, (F.col("part") == F.col("p")) & (F.col("cell") == F.col("c")) & (F.col("step") | (F.col("a") < F.col("b"))) & near).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """Columns id, ``fp``, ``component_id`` (the smallest id that links reach) and ``root`` (the component's
    least fingerprint) for each row of ``docs``.

    Rows with equal fingerprints are linked, also those without words (fingerprint 0).  Null ids
    take part, and count as no id; a component without any id has the id null.  Whole texts are
    read; repeated rows give repeated results; other columns are not read."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marked = materialize(fingerprints(src, text_col="_text", carry=["_id"], shingle=shingle), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("_id").alias("first")), "simhash-distinct")
    classes = connected_components(links(distinct.select("fp"), max_bits), "a", "b")
    rooted = distinct.join(classes, distinct["fp"] == classes["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(rooted.join(roots, "root").select("fp", "component_id", "root"), "simhash-classes")
    return marked.join(named, "fp").select(F.col("_id").alias(id_col), "fp", "component_id", "root")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` with one document left of each component: the one with the smallest id.

    Where ids are null or repeated, rows are told apart by their fingerprints as well, and one of several
    rows that agree in both stays."""
    near = materialize(near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, max_bits=max_bits).withColumnRenamed(id_col, "_id"), "simhash-rows")
    stay = near.filter(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("_id", "fp")).alias("s")).select("root", "s._id", "s.fp")
    unclear = near.groupBy("_id").agg(F.count("*").alias("n")).filter("n > 1 or _id is null").limit(1).count()
    if not unclear:
        return docs.join(stay.select(F.col("_id").alias(id_col)), id_col, "left_semi")
    marked = fingerprints(docs, text_col=text_col, carry=docs.columns, shingle=shingle, out_col="_quire_fp")
    stay = stay.select(F.col("root").alias("_quire_root"), F.col("_id").alias("_quire_id"), F.col("fp").alias("_quire_stay"))
    hit = marked["_quire_fp"].eqNullSafe(stay["_quire_stay"]) & marked[id_col].eqNullSafe(stay["_quire_id"])
    return marked.join(stay, hit).dropDuplicates(["_quire_root"]).select(*docs.columns)
