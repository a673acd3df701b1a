"""Chat formatting by columnar byte assembly.

Every turn becomes ``<s>[ROLE]role[/ROLE]text</s>``.  For a batch of turns the lengths of all
segments (headers, roles, texts, footers) give cumulative offsets; one gather through scatter
indices copies them into a preallocated Arrow buffer.  Turns are dealt out by ranges of
(conversation, turn), so one long conversation is formatted by many tasks; a conversation is
the sequence of its segments, ordered by (``part``, ``seq``).

Control strings inside roles and texts are escaped reversibly: a backslash is put after the
first character of each control string, also of one that already holds backslashes there.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import prepare, string_bytes

CONTROL = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]")
_TAIL = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)({_TAIL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_TAIL})")
_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>", re.S)
_PARTS = (b"<s>[ROLE]", b"[/ROLE]", b"</s>")

SEGMENT = "conv_id {id}, part long, seq long, n_turns long, formatted string, loss array<struct<start:long,stop:long>>"


def escape(text: str) -> str:
    """Put one backslash into every control string, so that none is left."""
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _UNESCAPE.sub(r"\1\2\3", text)


def _escaped(arr) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes and offsets of a string column; only rows that hold an opening character are looked at."""
    data, off = string_bytes(arr)
    opening = np.flatnonzero((data == 60) | (data == 91))
    rows = np.unique(np.searchsorted(off, opening, "right") - 1)
    if not len(rows):
        return data, off
    values = arr.to_pylist()
    changed = False
    for i in rows:
        new = escape(values[i])
        changed |= new != values[i]
        values[i] = new
    return string_bytes(pa.array(values, pa.string())) if changed else (data, off)


def assemble(roles, texts, assistant: str) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """One buffer with all formatted turns, the n+1 byte offsets of the turns, and the byte span
    (start, stop) of each turn's text, or -1 where the role is not ``assistant``."""
    role, role_off = _escaped(roles)
    text, text_off = _escaped(texts)
    n = len(roles)
    fixed = np.frombuffer(b"".join(_PARTS), np.uint8)
    source = np.concatenate([fixed, role, text])
    at = np.cumsum([0] + [len(p) for p in _PARTS])
    start = np.empty((n, 5), np.int64)
    size = np.empty((n, 5), np.int64)
    for k, piece in zip((0, 2, 4), range(3)):
        start[:, k], size[:, k] = at[piece], len(_PARTS[piece])
    start[:, 1], size[:, 1] = at[3] + role_off[:-1], np.diff(role_off)
    start[:, 3], size[:, 3] = at[3] + len(role) + text_off[:-1], np.diff(text_off)
    ends = np.cumsum(size.reshape(-1))
    dest = np.concatenate([[0], ends])
    total = int(dest[-1])
    buffer = pa.allocate_buffer(total)
    index = np.repeat(start.reshape(-1) - dest[:-1], size.reshape(-1)) + np.arange(total)
    np.take(source, index, out=np.frombuffer(buffer, np.uint8))
    turns = np.concatenate([[0], ends[4::5]])
    span = np.stack([ends[2::5], ends[3::5]], 1)
    span[[r != assistant for r in roles.to_pylist()]] = -1
    return buffer, turns, span


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", assistant: str = "assistant") -> DataFrame:
    """Segments of formatted conversations: ``conv_id, part, seq, n_turns, formatted, loss``.

    ``loss`` lists the byte spans of the segment whose tokens are learnt: the texts of
    ``assistant`` turns.  Turns are ordered by (turn, role, text), nulls first; a null role or
    text counts as empty, a null conversation id is a conversation of its own; repeated rows
    are repeated turns.  Other columns are not read."""
    prepare(turns.sparkSession)
    src = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                       F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["conv"].dataType.simpleString()
    dealt = (src.withColumn("head", F.substring("text", 1, 32)).repartitionByRange("conv", "turn", "role", "head")
             .sortWithinPartitions("conv", "turn", "role", "text")
             .select("conv", "role", "text", F.spark_partition_id().cast("long").alias("part")))

    def run(batches):
        seq = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv")
            buffer, off, span = assemble(batch.column("role"), batch.column("text"), assistant)
            values = conv.to_pylist()
            cut = [0] + [i for i in range(1, len(values)) if values[i] != values[i - 1]] + [len(values)]
            first, stop = np.array(cut[:-1]), np.array(cut[1:])
            size = off[first]
            formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(size, off[-1]).astype(np.int64)), buffer)
            spans = [[{"start": int(a - off[i]), "stop": int(b - off[i])} for a, b in span[i:j] if a >= 0] for i, j in zip(first, stop)]
            yield pa.RecordBatch.from_arrays(
                [conv.take(pa.array(first)), pa.array([batch.column("part")[0].as_py()] * len(first), pa.int64()),
                 pa.array(np.arange(seq, seq + len(first))), pa.array(stop - first), formatted.cast(pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                ["conv_id", "part", "seq", "n_turns", "formatted", "loss"])
            seq += len(first)

    return dealt.mapInArrow(run, SEGMENT.format(id=kind))


def digests(segments: DataFrame) -> DataFrame:
    """Read conversations back from their segments: one row each with turn count and digests.

    Segments are streamed in order through one hash per conversation; no conversation is held whole."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    ordered = (segments.select("conv_id", "part", "seq", "formatted", "loss").repartition("conv_id")
               .sortWithinPartitions("conv_id", "part", "seq"))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(
            [id_type[0], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names)

    id_type: list = [None]

    def run(batches):
        current, state, done = None, None, []

        def close():
            n, turn_hash, chars, loss_hash, size = state
            done.append((current, n, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), size))

        for batch in batches:
            id_type[0] = batch.schema.field("conv_id").type
            for conv, text, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                if state is None or conv != current:
                    if state is not None:
                        close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in _TURN.findall(text):
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                raw = text.encode()
                for span in loss:
                    said = unescape(raw[span["start"]:span["stop"]].decode())
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield rows(done)
                done.clear()
        if state is not None:
            close()
            yield rows(done)

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
