"""Chunked logs against framing of the whole log."""
import random
import re

import pytest

from quire.operators.log_frames import frame_chunks


def whole(data: bytes) -> list[str]:
    lines = [re.sub(r"\x1b\[[0-9;]*[A-Za-z]", "", x.decode("utf-8", "replace")).strip() for x in re.split(rb"[\r\n]", data)[:-1]]
    return [x for x in lines if x]


def chunks_of(logs: dict, rng: random.Random, most: int = 7):
    rows = []
    for log, data in logs.items():
        at, pos = 0, 0
        while at < len(data):
            n = rng.randint(0, most)
            rows.append((log, pos, bytearray(data[at:at + n]) if n or rng.random() < 0.5 else None, "x", 3))
            at, pos = at + n, pos + rng.randint(1, 3)
    rng.shuffle(rows)
    return rows


# columns named like the operator's own results and helpers
SCHEMA = "doc_id long, pos long, chunk binary, line string, line_idx int"


@pytest.mark.parametrize("hot", [10, 100_000])
def test_chunked_logs_equal_whole_logs(spark, hot):
    rng = random.Random(hot)
    pieces = ["é", "漢字", "a", " ", "\n", "\r", "\r\n", "\x1b[31m", "x" * 30, "　"]
    logs = {i: b"".join(rng.choice([p.encode() for p in pieces] + [b"\xff", b"\xe4\xb8", b"\xf0\x9f"]) for _ in range(rng.randint(0, 60))) for i in range(20)}
    logs[None] = b"null id\nkept\nnot ended"
    logs[50] = b"no break at all " * 20
    logs[51] = "\n".join(f"line {i}" for i in range(400)).encode()
    logs[52] = b"\n\r\n  \n"
    df = spark.createDataFrame(chunks_of(logs, rng), SCHEMA)
    got: dict = {}
    for r in sorted(frame_chunks(df, min_hot_rows=hot).collect(), key=lambda r: r.line_idx):
        got.setdefault(r.doc_id, []).append((r.line_idx, r.line))
    assert got == {k: list(enumerate(whole(v))) for k, v in logs.items() if whole(v)}


def test_one_line_over_many_chunks(spark):
    data = ("ä" * 5000 + "\nrest").encode()
    rows = [(1, i, bytearray(data[i:i + 3]), "", 0) for i in range(0, len(data), 3)]
    assert [tuple(r) for r in frame_chunks(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 0, "ä" * 5000)]


def test_no_chunks(spark):
    assert frame_chunks(spark.createDataFrame([], SCHEMA)).count() == 0
