"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of 1 to 3 characters per language in Spark tasks (map-side
``bincount``, then one sum per (language, bucket)); the driver receives at most
languages x buckets counts.  The log-probability matrix is broadcast: its size is fixed
by ``buckets`` and the number of languages, and checked against ``MAX_MODEL_BYTES``.
Scoring gathers matrix rows for all n-grams of a batch and sums them per document.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_slices, prepare

MAX_MODEL_BYTES = 64 << 20
ORDERS = (1, 2, 3)
#: n-grams whose matrix rows are gathered at a time.
GATHER = 1 << 16
#: Log-probabilities are held in whole 1/SCALE, so that sums are exact in any order.
SCALE = 4096
_LETTER = regex.compile(r"\p{L}")
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass
class LanguageModel:
    """Learned languages (sorted), their n-gram log-probabilities (languages x buckets, in 1/SCALE) and log-priors."""

    langs: list[str]
    logp: np.ndarray
    prior: np.ndarray
    bits: int


def ngram_buckets(texts: list[str | None], bits: int):
    """For each order: hashed n-grams of all texts (null: empty), and the n+1 offsets of each text's n-grams.

    A text is lower-cased; runs of characters that are no letters count as one space."""
    low = [" " + t.lower() + " " if t else "" for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(low), dtype=np.int64), [len(t) for t in low])
    code, own = _squeeze(code, own)
    shift = np.uint32(32 - bits)
    for k in ORDERS:
        m = len(code) - k + 1
        if m <= 0:
            yield np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
            continue
        h = np.full(m, np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF), np.uint32)
        for j in range(k):
            h = (h ^ code[j:j + m]) * _MULT[j]
            h ^= h >> np.uint32(15)
        whole = own[:m] == own[k - 1:]
        yield (h * np.uint32(0x9E3779B1) >> shift)[whole], np.searchsorted(own[:m][whole], np.arange(len(texts) + 1))


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000:
            table[i] = chr(i).isalpha()
    return table


_TABLE: list[np.ndarray] = []


def _squeeze(code: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLE:
        _TABLE.append(_letters())
    letter = _TABLE[0][code]
    code = np.where(letter, code, np.uint32(32))
    keep = letter.copy()
    keep[0:1] = True
    keep[1:] |= letter[:-1] | (own[1:] != own[:-1])
    return code[keep], own[keep]


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", keep: Column | None = None,
        id_col: str = "doc_id", per_lang: int = 1500, bits: int = 15, smoothing: float = 0.1,
        seed: int = 7) -> LanguageModel:
    """Learn from rows with a language and a text; about ``per_lang`` of each, taken by a hash of the id.

    ``keep`` narrows the rows that may be learnt from.  No such row: a model without languages."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs if keep is None else docs.filter(keep)
    rows = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if len(langs) * (8 << bits) > MAX_MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages x {1 << bits} buckets exceed the model's bound of {MAX_MODEL_BYTES} bytes")
    if not langs:
        return LanguageModel([], np.zeros((0, 1 << bits), np.int64), np.zeros(0), bits)
    limit = F.create_map(*[x for g, n in counts.items() for x in (F.lit(g), F.lit(int(min(1.0, per_lang / n) * (1 << 30))))])
    chosen = rows.filter(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) < limit[F.col("_lang")])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in byte_slices(batch, "_text"):
                names = part.column("_lang").to_pylist()
                kinds = {g: i for i, g in enumerate(sorted(set(names)))}
                code = np.array([kinds[g] for g in names])
                for bucket, off in ngram_buckets(part.column("_text").to_pylist(), bits):
                    kind = np.repeat(code, np.diff(off))
                    for g, i in kinds.items():
                        c = np.bincount(bucket[kind == i], minlength=1 << bits)
                        sums[g] = sums[g] + c if g in sums else c
        for g, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["lang", "bucket", "n"])

    total = (chosen.select("_text", "_lang").mapInArrow(count, "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    table = np.zeros((1 << bits, len(langs)))
    at = {g: i for i, g in enumerate(langs)}
    table[total["bucket"].to_numpy(int), total["lang"].map(at).to_numpy(int)] = total["n"]
    table += smoothing
    n = np.array([counts[g] for g in langs], float)
    return LanguageModel(langs, np.ascontiguousarray(np.rint(np.log(table / table.sum(0)).T * SCALE).astype(np.int64)), np.log(n / n.sum()), bits)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for each text.

    ``und`` with score 0 where the text is null or holds no letter, or no language was learnt;
    equal posteriors go to the language that sorts first."""
    known = np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool)
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    sums = np.zeros((len(texts), len(model.langs)), np.int64)
    for bucket, off in ngram_buckets(texts, model.bits):
        for i in range(0, len(bucket), GATHER):  # a very long text is summed in pieces
            piece, cut = bucket[i:i + GATHER], np.clip(off, i, min(i + GATHER, len(bucket))) - i
            full = np.flatnonzero(cut[1:] > cut[:-1])
            if len(full):
                for g in range(len(model.langs)):
                    sums[full, g] += np.add.reduceat(model.logp[g][piece], cut[:-1][full])
    logs = sums / SCALE + model.prior
    best = logs.argmax(1)
    p = np.exp(logs - logs.max(1, keepdims=True))
    p = p[np.arange(len(texts)), best] / p.sum(1)
    return [model.langs[b] if k else "und" for b, k in zip(best, known)], np.where(known, p, 0.0)


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text",
             carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: the id), ``lang_pred`` and ``score`` (0 to 1) for each row of ``docs``.

    Repeated rows are scored each on their own; an empty table gives an empty result; other
    columns of ``docs``, also ones named like the results, are not read unless carried."""
    spark = docs.sparkSession
    prepare(spark)
    carry = carry or [id_col]
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("_text"))
    schema = ", ".join(f"c{i} {src.schema[i].dataType.simpleString()}" for i in range(len(carry)))

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, "_text"):
                pred, p = score_texts(shared.value, part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred, pa.string()), pa.array(p, pa.float64())], [*part.schema.names[:-1], "lang_pred", "score"])

    out = src.mapInArrow(run, f"{schema}, lang_pred string, score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "lang_pred", "score")
