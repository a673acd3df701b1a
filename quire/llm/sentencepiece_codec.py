"""SentencePiece encoding and decoding through a table of distinct marked words.

A text is the sequence of its chunks: a run of whitespace markers and the characters up to
the next marker.  When no piece of the model crosses from another character into a marker,
no merge does either, so a chunk's ids do not depend on its neighbours: each worker
segments every distinct chunk once, keeps the result in a table of bounded size and joins
ids, counts and decoded strings back by position.  Models for which that does not hold
(see ``chunkable``) are applied to whole texts.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_slices, prepare

MARK = "▁"
#: Entries of a worker's chunk table, and the longest chunk that it keeps.
TABLE_ENTRIES, TABLE_CHUNK = 400_000, 100
_CHUNK = re.compile(" +[^ ]*")


def chunkable(path: str) -> bool:
    """Whether chunks can be segmented on their own: plain text in, one marker put before it, and no
    piece with a marker after another character."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    norm = model.normalizer_spec
    plain = (not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces
             and not norm.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix)
    kinds = {p.type for p in model.pieces}
    return (plain and model.trainer_spec.model_type == pb.TrainerSpec.BPE and pb.ModelProto.SentencePiece.USER_DEFINED not in kinds
            and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces))


def split_chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " not in text and text[0] != " ":
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(" " + text)]


class Codec:
    """Encodes and decodes texts; one per Python worker."""

    def __init__(self, path: str, by_chunk: bool):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_chunk = by_chunk
        self.table: dict[str, tuple[int, str, str]] = {}
        self.names = [str(i) for i in range(self.sp.get_piece_size())]
        self.pieces = [self.sp.id_to_piece(i).replace(MARK, " ") for i in range(self.sp.get_piece_size())]
        self.plain = [not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i)) for i in range(self.sp.get_piece_size())]

    def _segment(self, chunks: list[str]) -> dict[str, tuple[int, str, str]]:
        # an empty chunk is a marker alone, which the library makes only out of a space that something precedes
        lone = [self.sp.piece_to_id(MARK)]
        names, pieces, plain = self.names.__getitem__, self.pieces.__getitem__, self.plain.__getitem__
        out = {}
        for c, ids in zip(chunks, self.sp.encode(chunks, num_threads=1)):
            ids = ids if c else lone
            # ordinary pieces decode to their characters, less the first marker; the library decodes the others
            back = "".join(map(pieces, ids))[1:] if all(map(plain, ids)) else self.sp.decode(ids)
            out[c] = (len(ids), " ".join(map(names, ids)), c if back == c else back)
        return out

    def encode_decode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, decimal ids joined by a space, decoded text) of each text; an end id closes the ids."""
        eos = self.sp.eos_id()
        if not self.by_chunk:
            ids = self.sp.encode(texts, add_eos=True, num_threads=1)
            return [(len(i), " ".join(map(str, i)), d) for i, d in zip(ids, self.sp.decode(ids, num_threads=1))]
        parts = [split_chunks(t) for t in texts]
        wanted = set().union(*parts)
        missing = [c for c in wanted if c not in self.table]
        if len(self.table) + len(missing) > TABLE_ENTRIES:
            self.table.clear()
            missing = list(wanted)
        fresh = self._segment(missing) if missing else {}
        table = self.table
        table.update((c, v) for c, v in fresh.items() if len(c) <= TABLE_CHUNK)
        long = {c: v for c, v in fresh.items() if len(c) > TABLE_CHUNK}
        out = []
        for chunks in parts:
            try:
                found = [table[c] for c in chunks]
            except KeyError:
                found = [table[c] if c in table else self._long(c, long) for c in chunks]
            n, ids, back = zip(*found) if found else ((), (), ())
            out.append((sum(n) + 1, " ".join([*ids, str(eos)]), " ".join(back)))
        return out

    def _long(self, chunk: str, long: dict) -> tuple[int, str, str]:
        return long[chunk] if chunk in long else self._segment([chunk])[chunk]


def encode_decode(docs: DataFrame, model_path: str, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default ``doc_id``), ``n_tokens`` long, ``ids`` string (decimal ids joined by one
    space, the end id last) and ``decoded`` string for each row.

    A null text counts as empty and gives the end id alone.  Whole texts are encoded, whatever
    their length; repeated rows give repeated results; other columns, also ones named like the
    results, are not read unless carried.  ``model_path`` must exist on every worker."""
    prepare(docs.sparkSession)
    carry = ["doc_id"] if carry is None else carry
    by_chunk = chunkable(model_path)
    src = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = "".join(f"c{i} {src.schema[i].dataType.simpleString()}, " for i in range(len(carry)))

    def run(batches):
        codec = Codec(model_path, by_chunk)
        for batch in batches:
            for part in byte_slices(batch, "_text", 1 << 20):
                got = codec.encode_decode(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())],
                    [*part.schema.names[:-1], "n_tokens", "ids", "decoded"])

    out = src.mapInArrow(run, f"{schema}n_tokens long, ids string, decoded string")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_tokens", "ids", "decoded")
