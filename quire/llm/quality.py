"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Words are hashed from one prefix sum over the bytes of a batch; a text's features are the
hashed single words and word pairs of two streams: the words themselves, and their shapes
(letter case, trailing symbols, whether the word repeats the one before).  Scores are sparse
dot products of those counts with the learned weights.  Training runs on the driver over a
sample whose rows and characters are bounded by parameters; the weight vector that is
broadcast has ``2**bits`` entries.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_slices, labelled_sample, mix64, prepare, segment_sums, span_hashes, string_bytes, word_bounds


@dataclass
class LinearModel:
    weights: np.ndarray
    bias: float
    bits: int


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.full(256, 3, np.uint8)  # 0 lower case, 1 upper case, 2 digit, 3 symbol; bytes of other letters count as lower case
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 0


def features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of concatenated UTF-8 rows and the n+1 offsets of each row's features."""
    starts, stops, words = word_bounds(data, off)
    n = len(words) - 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    h = span_hashes(_LOWER[data], starts, stops)
    row = np.repeat(np.arange(n), np.diff(words))
    same_row = np.zeros(len(h), bool)
    same_row[1:] = row[1:] == row[:-1]
    repeat = np.zeros(len(h), bool)
    repeat[1:] = same_row[1:] & (h[1:] == h[:-1])
    kind = _KIND[data]
    upper = np.concatenate([[0], np.cumsum(kind == 1)])
    symbol = np.concatenate([[0], np.cumsum(kind == 3)])
    size = stops - starts
    n_upper, n_symbol = upper[stops] - upper[starts], symbol[stops] - symbol[starts]
    shape = (np.minimum(n_symbol, 3) + 4 * (kind[starts] == 1) + 8 * (2 * n_upper > size) + 16 * (n_symbol == size)
             + 32 * repeat + 64 * np.where(n_symbol > 0, data[stops - 1], 0).astype(np.int64)).astype(np.uint64)
    shape = mix64(shape + np.uint64(0x51ED27))
    before = np.zeros(len(h), np.uint64)
    mult = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - bits)
    streams = []
    for s, one in ((h, 0xA1), (shape, 0xA2)):
        before[1:] = np.where(same_row[1:], s[:-1], np.uint64(0))
        streams.append(mix64(s + np.uint64(one)) >> shift)
        streams.append(mix64(s * mult + before + np.uint64(one << 8)) >> shift)
    return np.stack(streams, 1).reshape(-1).astype(np.int64), words * len(streams)


def _norm(n: np.ndarray) -> np.ndarray:
    return 1 / np.maximum(n, 1)


def train(sample: list[tuple[int, str]], *, bits: int = 18, epochs: int = 6, alpha: float = 2.0, beta: float = 1.0,
          l1: float = 0.002, l2: float = 0.002, seed: int = 10) -> LinearModel:
    """Follow-the-regularised-leader logistic regression with per-coordinate rates; classes weigh alike.

    Without rows of both classes every score is the share of the one class, or 0.5."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    ys = np.array([y for y, _ in sample], float)
    if not len(ys) or ys.min() == ys.max():
        return LinearModel(z, 0.0 if not len(ys) else (8.0 if ys[0] else -8.0), bits)
    cases = []
    for _, text in sample:
        data = np.frombuffer(text.encode(), np.uint8)
        f, _ = features(data, np.array([0, len(data)]), bits)
        at, c = np.unique(f, return_counts=True)
        cases.append((at, SCALE * c * _norm(np.array(len(f)))))
    weight = np.where(ys == 1, 0.5 / ys.mean(), 0.5 / (1 - ys.mean()))
    bias_z = bias_n = 0.0
    rng = np.random.default_rng(seed)

    def settle(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(cases)):
            at, x = cases[i]
            w = settle(z[at], n[at])
            b = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ x + b, -30, 30)))
            g0 = (p - ys[i]) * weight[i]
            g = g0 * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            bias_z += g0 - (np.sqrt(bias_n + g0 * g0) - np.sqrt(bias_n)) / alpha * b
            bias_n += g0 * g0
    return LinearModel(settle(z, n), float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha)), bits)


#: Factor on the relative frequencies that serve as feature values.
SCALE = 8.0


def score_rows(model: LinearModel, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probability of label 1 for concatenated rows; a row without words has the score of the bias."""
    f, bounds = features(data, off, model.bits)
    dot = segment_sums(model.weights[f], bounds) * SCALE * _norm(np.diff(bounds))
    return 1 / (1 + np.exp(-np.clip(dot + model.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        per_class: int = 2500, max_chars: int = 16_000_000, seed: int = 10) -> LinearModel:
    """Learn from labelled rows whose ids satisfy ``keep`` (over ``_id``); see ``labelled_sample`` for the bounds."""
    return train(labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, keep=keep,
                                 per_class=per_class, max_chars=max_chars, seed=seed), seed=seed)


def score(docs: DataFrame, model: LinearModel, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default ``doc_id``), ``score`` (0 to 1) and ``predicted`` (score >= 0.5) for each row.

    Null and empty texts score as the bias alone; whole texts are read, whatever their length;
    repeated rows give repeated results; no other column is read."""
    spark = docs.sparkSession
    prepare(spark)
    carry = ["doc_id"] if carry is None else carry
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("_text"))
    schema = "".join(f"c{i} {src.schema[i].dataType.simpleString()}, " for i in range(len(carry)))

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, "_text", 2 << 20):
                p = score_rows(shared.value, *string_bytes(part.column("_text")))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p)], [*part.schema.names[:-1], "score"])

    out = src.mapInArrow(run, f"{schema}score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
