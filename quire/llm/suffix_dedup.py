"""Removal of repeated byte strings by a distributed difference-cover sort of bounded suffixes.

Whether two suffixes agree in their first ``length`` bytes is all that is asked, so the
difference-cover algorithm is run to that depth, on fixed-size names:

1. Sample.  Positions whose offset in their document is in a difference cover modulo ``period`` are
   sampled.  For any two positions p, q some step d < period makes p + d and q + d both samples.
   A sample's tuple is its next ``length - period + 1`` bytes.
2. Name.  Tuples are dealt out by the leading bits of their 64-bit names, sorted and
   compared with their neighbours in the order.  A name that occurs once is discarded: its
   suffix has no partner.  With names of fixed depth one round replaces the recursion.
3. Merge.  The remaining suffixes, sampled or not, are those with a repeated sample among their next
   ``period`` positions.  They get names of the full ``length`` bytes, which are dealt out, sorted
   and compared with their neighbours in the same way.  Equal neighbours are repeated strings.

Documents are held in chunks of some megabytes, written once as a bucketed table in the
warehouse, so that answers come back to their chunk without moving texts.  A chunk sends each of its
names once, however often it holds it; the answer is one bit per name.  Each sorting task holds one
range of names, whose number grows with the input.  Documents with an exact copy are found first
by a 128-bit hash; one of each group stands for all.

Names are 64 bits: two different strings share one with a probability of about 5e-20.

The unit of a string is a byte or a word: with ``unit="words"`` the symbols that are sampled, named and compared are the
64-bit hashes of the words, and a repeated string is removed from the start of its first word to the end of its last.
"""
from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import _BASE, _INV, mix64, powers, prepare, salted_join, span_hashes, string_bytes, word_bounds
from quire.session import materialize

#: Bytes of a chunk, positions hashed at a time, names sorted by one task on average.
CHUNK, BLOCK, NAMES_PER_TASK = 4 << 20, 1 << 19, 1 << 20


def difference_cover(limit: int) -> tuple[int, np.ndarray]:
    """(period, cover) of the largest Colbourn-Ling difference cover with a period up to ``limit``.

    Every residue is a difference of two members; periods below 13 use all positions."""
    if limit < 13:
        return 1, np.zeros(1, np.int64)
    r = 0
    while 24 * (r + 1) ** 2 + 36 * (r + 1) + 13 <= limit:
        r += 1
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0] + steps)


class Plan:
    """Sampling constants for a string length, in units."""

    def __init__(self, length: int, unit: str = "bytes"):
        if unit not in ("bytes", "words"):
            raise ValueError(f"unknown unit: {unit}")
        self.length, self.unit = length, unit
        self.period, cover = difference_cover(length // 2)
        self.depth = length - self.period + 1
        self.sampled = np.zeros(self.period, bool)
        self.sampled[cover % self.period] = True


def name_spans(data: np.ndarray, pos: np.ndarray, size: int) -> np.ndarray:
    """64-bit names of data[p:p+size] for ascending positions, block by block."""
    out = np.empty(len(pos), np.uint64)
    up, down = powers(_BASE, BLOCK + size), powers(_INV, BLOCK)
    for s in range(0, len(data), BLOCK):
        a, b = np.searchsorted(pos, (s, s + BLOCK))
        if a == b:
            continue
        part = data[s:s + BLOCK + size]
        pre = np.empty(len(part) + 1, np.uint64)
        pre[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=pre[1:])
        at = pos[a:b] - s
        out[a:b] = mix64((pre[at + size] - pre[at]) * down[at])
    return out


def sample_positions(plan: Plan, off: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Sampled positions with a whole tuple after them, in the documents marked by ``use``."""
    found = []
    for i in np.flatnonzero(use & (np.diff(off) >= plan.length)):
        n = int(off[i + 1] - off[i]) - plan.depth + 1
        found.append(off[i] + np.flatnonzero(np.resize(plan.sampled, n)))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def window_positions(plan: Plan, off: np.ndarray, use: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Positions with ``length`` bytes after them and a repeated sample among their next ``period`` positions."""
    n = int(off[-1])
    change = np.zeros(n + 1, np.int32)
    start = off[np.searchsorted(off, repeated, "right") - 1]
    np.add.at(change, np.maximum(repeated - plan.period + 1, start), 1)
    np.add.at(change, repeated + 1, -1)
    near = np.cumsum(change[:-1]) > 0
    whole = np.zeros(n + 1, np.int32)
    for i in np.flatnonzero(use & (np.diff(off) >= plan.length)):
        whole[off[i]] += 1
        whole[off[i + 1] - plan.length + 1] -= 1
    return np.flatnonzero(near & (np.cumsum(whole[:-1]) > 0))


def _ranges(names: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the 2**bits name ranges in ascending names."""
    tops = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(names, tops), [len(names)]])


def _bits(names_total: float) -> int:
    return max(0, int(np.ceil(np.log2(max(names_total, 1) / NAMES_PER_TASK))))


def _sent(chunk: int, names: np.ndarray, bits: int) -> pa.RecordBatch:
    cut = _ranges(names, bits)
    full = np.flatnonzero(np.diff(cut))
    blobs = [names[cut[b]:cut[b + 1]].tobytes() for b in full]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([chunk] * len(full), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "names"])


def _answer(table: pa.Table) -> pa.Table:
    """For one range of names: a bit per sent name, 1 where another chunk sent it too."""
    blobs = [np.frombuffer(b, np.uint64) for b in table.column("names").to_pylist()]
    every = np.sort(np.concatenate(blobs))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    bits = []
    for b in blobs:
        at = np.searchsorted(again, b)
        at[at == len(again)] = 0
        bits.append(np.packbits(again[at] == b if len(again) else np.zeros(len(b), bool)).tobytes())
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _repeated(names: np.ndarray, bits: int, answers: list[dict] | None) -> np.ndarray:
    """Whether each name (in any order) occurs twice in its chunk or, by the answers, in another one."""
    unique, back, count = np.unique(names, return_inverse=True, return_counts=True)
    known = count > 1
    cut = _ranges(unique, bits)
    for a in answers or ():
        s, e = cut[a["bucket"]], cut[a["bucket"] + 1]
        known[s:e] |= np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=e - s).astype(bool)
    return known[back]


def _chunk(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and roles of a chunk's documents: 0 alone, 1 stands for copies, 2 copy of another."""
    off = np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))]).astype(np.int64)
    role = np.zeros(len(off) - 1, np.int8)
    for c in row["copies"] or ():
        role[c["idx"]] = 1 if c["first"] else 2
    return np.frombuffer(row["data"], np.uint8), off, role


def symbols(plan: Plan, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a chunk, the n+1 offsets of its documents among them, and the bytes where each starts and stops."""
    if plan.unit == "bytes":
        at = np.arange(len(data))
        return data, off, at, at + 1
    starts, stops, bounds = word_bounds(data, off)
    return span_hashes(data, starts, stops), bounds, starts, stops


def make_chunks(docs: DataFrame, carry: list[str], text_col: str) -> DataFrame:
    """Written table of chunks: id, carried columns and byte sizes of their documents, 128-bit text hashes, bytes."""
    spark = docs.sparkSession
    src = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))
    fields = T.StructType(src.schema.fields[:-1])
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rows", T.ArrayType(fields)), T.StructField("sizes", T.ArrayType(T.LongType())),
                           T.StructField("hashes", T.ArrayType(T.BinaryType())), T.StructField("data", T.BinaryType())])

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            whole = pa.Table.from_batches(held).combine_chunks()
            data, off = string_bytes(whole.column("_text"))
            raw = data.tobytes()
            hashes = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(off[:-1], off[1:])]
            rows = pa.StructArray.from_arrays([c.chunk(0) if c.num_chunks else c.combine_chunks() for c in whole.columns[:-1]], fields=[whole.schema.field(i) for i in range(len(carry))])
            one = pa.array([0, len(rows)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq], pa.int64()), pa.ListArray.from_arrays(one, rows), pa.array([np.diff(off)], pa.list_(pa.int64())),
                 pa.array([hashes], pa.list_(pa.binary())), pa.array([raw], pa.binary())], ["chunk", "rows", "sizes", "hashes", "data"])

        for batch in batches:
            start, lengths = 0, np.cumsum(np.concatenate([[size], np.diff(string_bytes(batch.column("_text"))[1])]))
            for i in range(batch.num_rows):
                if lengths[i + 1] - lengths[start] + (size if start == 0 else 0) >= CHUNK or i - start >= 5000:
                    held.append(batch.slice(start, i + 1 - start))
                    yield close()
                    seq, held, size, start = seq + 1, [], 0, i + 1
                    lengths = lengths - (lengths[start] if start < len(lengths) else 0)
            if start < batch.num_rows:
                held.append(batch.slice(start))
                size = int(lengths[-1] - lengths[start] + (size if start == 0 else 0))
        if held:
            yield close()

    name = f"quire_chunks_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (src.mapInArrow(run, schema).write.option("compression", "zstd").option("parquet.block.size", 32 << 20).bucketBy(buckets, "chunk").saveAsTable(name))
    return spark.table(name)


def _copies(chunks: DataFrame) -> DataFrame:
    """Per chunk: ``copies``, the documents whose whole text occurs again; one of each group is ``first``."""
    one = chunks.select("chunk", F.posexplode("hashes").alias("idx", "h"))
    groups = one.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("chunk", "idx")).alias("f")).filter("n > 1")
    hit = salted_join(one, groups, "h", ["chunk", "idx"]).select("chunk", F.struct("idx", ((F.col("f.chunk") == F.col("chunk")) & (F.col("f.idx") == F.col("idx"))).alias("first")).alias("c"))
    return materialize(hit.groupBy("chunk").agg(F.collect_list("c").alias("copies")), "copies")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, length: int = 400,
                   unit: str = "bytes", as_text: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else.

    With ``unit="words"`` strings are of ``length`` words (runs without ASCII white space), whatever stands between the words.

    Columns ``carry`` (default: the id), ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs, in bytes
    of the UTF-8 text) and ``kept`` (binary: the remaining bytes, which may cut a character; with
    ``as_text`` a string without the bytes of cut characters).  Occurrences in
    the same document count, overlapping ones too; strings never cross documents and are judged
    on the input.  Null texts are empty; shorter texts stay whole; repeated rows are copies of
    each other; other columns, also ones named like the results, are not read unless carried."""
    spark = docs.sparkSession
    prepare(spark)
    plan = Plan(length, unit)
    carry = carry or [id_col]
    chunks = make_chunks(docs, carry, text_col)
    copies = _copies(chunks)
    total = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    total = total if unit == "bytes" else total / 2  # a word and its separator
    sample_bits, window_bits = _bits(total * plan.sampled.mean()), _bits(total / 2)
    sent = "bucket int, chunk long, names binary"

    def sample_names(row):
        data, off, role = _chunk(row)
        data, off, *_ = symbols(plan, data, off)
        pos = sample_positions(plan, off, role < 2)
        return data, off, role, pos, name_spans(data, pos, plan.depth)

    def window_names(row):
        data, off, role, pos, names = sample_names(row)
        pos = window_positions(plan, off, role < 2, pos[_repeated(names, sample_bits, row["samples"])])
        return data, off, role, pos, name_spans(data, pos, length)

    def send(find, bits):
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    yield _sent(row["chunk"], np.unique(find(row)[-1]), bits)
        return run

    def answers(frame, name):
        back = frame.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, bits binary")
        return materialize(back.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name)), name)

    work = chunks.select("chunk", "sizes", "data").join(copies, "chunk", "left")
    samples = answers(work.mapInArrow(send(sample_names, sample_bits), sent), "samples")
    work = work.join(samples, "chunk", "left")
    windows = answers(work.mapInArrow(send(window_names, window_bits), sent), "windows")
    kind = chunks.schema["rows"].dataType.elementType
    schema = T.StructType([*kind.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])

    def finish(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).drop_columns(["rows"]).to_pylist()[0]
                data, off, role, pos, names = window_names(row)
                gone = np.zeros(len(data) + 1, np.int32)
                hit = pos[_repeated(names, window_bits, row["windows"])]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + length, -1)
                gone = np.cumsum(gone[:-1]) > 0
                for d in np.flatnonzero((role > 0) & (np.diff(off) >= length)):
                    gone[off[d]:off[d + 1]] = True
                raw, bounds, _ = _chunk(row)
                _, _, starts, stops = symbols(plan, raw, bounds)
                n_removed, spans, kept = [], [], []
                for i_doc, (a, b) in enumerate(zip(off[:-1], off[1:])):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]]))) + a
                    cuts = list(zip(starts[edge[::2]].tolist(), stops[edge[1::2] - 1].tolist()))
                    first, last = int(bounds[i_doc]), int(bounds[i_doc + 1])
                    spans.append([{"start": s - first, "stop": e - first} for s, e in cuts])
                    n_removed.append(sum(e - s for s, e in cuts))
                    edges = [first, *[x for c in cuts for x in c], last]
                    kept.append(b"".join(raw[s:e].tobytes() for s, e in zip(edges[::2], edges[1::2])))
                if as_text:
                    kept = [k.decode("utf-8", "ignore") for k in kept]
                rows = batch.column("rows").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [*rows.flatten(), pa.array(np.diff(bounds)), pa.array(n_removed, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string() if as_text else pa.binary())], schema.names)

    done = chunks.select("chunk", "sizes", "data", "rows").join(copies, "chunk", "left").join(samples, "chunk", "left").join(windows, "chunk", "left").mapInArrow(finish, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_bytes", "n_removed", "spans", "kept")
