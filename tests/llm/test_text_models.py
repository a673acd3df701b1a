"""Language ID, toxicity and quality: held-out accuracy, gradients and odd inputs."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import langid, quality, queries, toxicity
from quire.llm.common import crc_remainder, string_bytes, word_bounds
from tests.conftest import SF_ORACLE

SF_BIG = "/root/testdata/sf0.1"
ODD = "doc_id long, text string, lang string, score double, predicted int"


def odd_rows(spark):
    """Null, empty, letterless, very long and repeated texts, null ids, and columns named like results."""
    rows = [(1, None, "en", 0.1, 9), (2, "", "en", 0.1, 9), (3, "12 !! 34", "en", 0.1, 9), (4, "the thing " * 60_000, "en", 0.1, 9),
            (5, "the same", None, 0.1, 9), (5, "the same", None, 0.1, 9), (None, "und der die das", "de", 0.1, 9)]
    return spark.createDataFrame(rows, ODD)


def test_crc_remainder_is_of_the_decimal_text(spark):
    got = spark.createDataFrame([(5,), (-7,), (123456,)], "doc_id long").select("doc_id", crc_remainder("doc_id", 4).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 4 for r in got)


def test_words_end_at_the_six_space_bytes_and_never_cross_rows():
    texts = ["a b", "", " c d\x0b", "e", "\t"]
    enc = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(enc), np.uint8), np.cumsum([0] + [len(e) for e in enc])
    starts, stops, words = word_bounds(data, off)
    got = [[data[s:e].tobytes().decode() for s, e in zip(starts[a:b], stops[a:b])] for a, b in zip(words, words[1:])]
    assert got == [["a", "b"], [], ["c d"], ["e"], []]


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    out = queries.op7_language_id(spark, SF_ORACLE).join(docs.select("doc_id", "lang"), "doc_id")
    r = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a > 0.97 and 0 <= r.lo and r.hi <= 1
    assert out.count() == docs.count()


def test_language_scores_match_a_plain_count():
    model = langid.LanguageModel(["x", "y"], np.random.default_rng(0).integers(-9000, 0, (2, 1 << 10)), np.log([0.3, 0.7]), 10)
    for text in ["hello world", "é à ü", "a1b"]:
        sums = np.zeros(2)
        for buckets, _ in langid.ngram_buckets([text], 10):
            for b in buckets:
                sums += model.logp[:, b]
        logs = sums / langid.SCALE + model.prior
        p = np.exp(logs - logs.max())
        pred, score = langid.score_texts(model, ["other text", text])
        assert pred[1] == model.langs[logs.argmax()] and score[1] == pytest.approx(p.max() / p.sum())


def test_language_id_odd_inputs(spark):
    df = odd_rows(spark)
    model = langid.fit(df)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(df, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de")} <= got
    assert langid.identify(df, model).count() == 7
    empty = df.limit(0)
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.fit(empty)).collect()} == {"und"}


@pytest.mark.parametrize("query, label, modulus, held, found, wrong", [(queries.op2_toxicity, "toxic", 5, 0, 0.88, 0.05), (queries.op10_quality, "quality", 3, 1, 0.95, 0.05)])
def test_classifiers_held_out_accuracy(spark, query, label, modulus, held, found, wrong):
    labels = spark.read.parquet(f"{SF_BIG}/labels.parquet")
    out = query(spark, SF_BIG)
    assert out.count() == spark.read.parquet(f"{SF_BIG}/documents.parquet").count()
    r = out.join(labels, "doc_id").filter("held_out").groupBy(label).agg(F.avg("predicted").alias("p"), F.count("*").alias("n")).collect()
    share = {x[label]: x.p for x in r}
    assert share[1] > found and share[0] < wrong, share
    assert all(zlib.crc32(str(x.doc_id).encode()) % modulus == held for x in out.filter("held_out").limit(50).collect())


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_odd_inputs(spark, module):
    df = odd_rows(spark)
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (5, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    model = module.fit(df, labels, keep=F.lit(True))
    got = module.score(df, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[5]) == 1 and by_id[1] == by_id[2]
    nothing = module.fit(df, labels.limit(0), keep=F.lit(True))
    assert {r.score for r in module.score(df, nothing).collect()} == {0.5}
    assert module.score(df.limit(0), model).count() == 0


def test_gated_network_gradients():
    rng = np.random.default_rng(0)
    p = toxicity.new_parameters(rng)
    x = rng.normal(size=(3, 5, toxicity.EMBED))
    valid = np.array([[1] * 5, [1, 1, 0, 0, 0], [1] * 4 + [0]], bool)
    y = np.array([1.0, 0, 1])

    def gates(t, d):
        return x[:, t] @ p["wx" + d] + p["b" + d]

    def loss():
        z = toxicity.forward(p, gates, 5, valid)
        return np.sum(np.log1p(np.exp(z)) - y * z)

    keep = []
    z = toxicity.forward(p, gates, 5, valid, keep)
    g, dx = toxicity.backward(p, x, keep, 1 / (1 + np.exp(-z)) - y)
    for name, grad in [*g.items(), ("x", dx)]:
        values = x if name == "x" else p[name]
        at = tuple(rng.integers(0, s) for s in values.shape)
        old = values[at]
        values[at] = old + 1e-5
        up = loss()
        values[at] = old - 1e-5
        down = loss()
        values[at] = old
        assert (up - down) / 2e-5 == pytest.approx(grad[at], abs=1e-6)


def test_windows_overlap_and_cover_every_word():
    words = np.array([0, 0, 5, 37, 37 + 100])
    start, stop, text = toxicity.windows(words)
    assert set(text) == {1, 2, 3}
    for i in range(4):
        covered = set()
        for s, e in zip(start[text == i], stop[text == i]):
            assert e - s <= toxicity.WINDOW
            covered |= set(range(s, e))
        assert covered == set(range(words[i], words[i + 1]))
    assert (np.diff(start[text == 3]) == toxicity.STRIDE).all()


def small_toxicity_model():
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("aeiounrstlm"), rng.integers(2, 9))) for _ in range(300)]
    sample = []
    for i in range(400):
        words = list(rng.choice(plain, 40))
        if i % 2:
            words[rng.integers(40)] = "vileword"
        sample.append((i % 2, " ".join(words)))
    return toxicity.train(sample, steps=200), plain


def scores(model, texts):
    enc = [t.encode() for t in texts]
    return toxicity.score_rows(model, np.frombuffer(b"".join(enc), np.uint8), np.cumsum([0] + [len(e) for e in enc]))


def test_a_word_hidden_anywhere_is_found():
    model, plain = small_toxicity_model()
    rng = np.random.default_rng(4)
    body = " ".join(rng.choice(plain, 4000))
    run = "".join(rng.choice(plain, 200))
    assert len(body) > 20_000
    clean = [body, run, "漢字仮名" * 300, body.replace(" ", "\u00a0")]
    toxic = [body[:10_500] + " Vileword " + body[10_500:], body + " x.vileword.y", run[:500] + "vileword" + run[500:],
             "漢字仮名" * 150 + "vileword" + "漢字仮名" * 150, (body[:10_500] + " vileword " + body[10_500:]).replace(" ", "\u00a0"),
             body[:900] + " qqvilewordqq " + body[900:]]
    assert (scores(model, clean) < 0.5).all() and (scores(model, toxic) > 0.5).all()


def scalar_hash(piece):
    """Value of the bytes as digits to a base, modulo 2**64, finished like the library's hash."""
    def finish(h):
        for _ in range(2):
            h ^= h >> 32
            h = h * 0xD6E8FEB86659FD93 % 2**64
        return h
    return finish, finish(sum((x + 1) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, x in enumerate(piece)) % 2**64)


def scalar_score(model, text):
    """The network over one text, unit by unit and number by number."""
    import math
    import re

    found = []
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode().translate(bytes(x + 32 if 65 <= x <= 90 else x for x in range(256)))):
        runs = re.findall(rb"[0-9a-z\x80-\xff]+", m[0])
        for r in runs or [m[0]]:
            if runs and len(r) > toxicity.LONG:
                found += [(r[i:i + toxicity.LONG], 1) for i in range(len(r) - 2) if r[i] & 0xC0 != 0x80]
            else:
                found.append((r, toxicity.MOST))
    rest = {k: np.asarray(v, float) for k, v in model.rest.items()}
    H = toxicity.HIDDEN

    def row(k, h):
        i = np.searchsorted(model.known[k], np.uint64(h))
        return model.tables[k][i + 1 if i < len(model.known[k]) and model.known[k][i] == h else 0].astype(float)

    gate = []
    for u, most in found:
        g = row(0, scalar_hash(u)[1])
        for k, n in enumerate(toxicity.PIECES, 1):
            finish, h = scalar_hash(u[:n] if n > 0 else u[n:])
            g = g + row(k, finish((h + k + 1000 * (len(u) <= abs(n))) % 2**64))
        for i in range(max(0, min(most, len(u) - toxicity.GRAM + 1))):
            if u[i] & 0xC0 != 0x80:
                g = g + row(toxicity.INPUTS, scalar_hash(u[i:i + toxicity.GRAM])[1])
        gate.append(g)

    def sig(x):
        return 1 / (1 + np.exp(-x))

    best = None if gate else rest["bo"][0]
    for s in range(0, max(1, len(gate) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if gate else ():
        part = gate[s:s + toxicity.WINDOW]
        sides = []
        for side, u in enumerate((rest["uf"], rest["ub"])):
            h, out = np.zeros(H), []
            for g in (part if side == 0 else part[::-1]):
                a, b = g[3 * H * side:3 * H * (side + 1)], h @ u
                z, r = sig(a[:H] + b[:H]), sig(a[H:2 * H] + b[H:2 * H])
                h = (1 - z) * np.tanh(a[2 * H:] + r * b[2 * H:]) + z * h
                out.append(h)
            sides.append(out if side == 0 else out[::-1])
        states = [np.concatenate(x) for x in zip(*sides)]
        weights = [math.exp(np.tanh(x @ rest["wa"] + rest["ba"]) @ rest["va"]) for x in states]
        logit = sum(w * x for w, x in zip(weights, states)) / sum(weights) @ rest["wo"] + rest["bo"][0]
        best = logit if best is None else max(best, logit)
    return 1 / (1 + math.exp(-(model.scale * best + model.shift)))


def test_scores_equal_a_scalar_network():
    model, plain = small_toxicity_model()
    rng = np.random.default_rng(5)
    texts = ["", " \n", "vileword", "|| -- |", "x.vileword.y, Tan", " ".join(rng.choice(plain, 33)), " ".join(rng.choice(plain, 90)) + " vileword",
             "".join(rng.choice(plain, 12)) + "vileword" + "漢字é" * 9, "é" * 40, "a" * 17 + " " + "b" * 16]
    got = scores(model, texts)
    assert got == pytest.approx([scalar_score(model, t) for t in texts], abs=2e-4)


def test_units_cover_every_letter_and_never_cross_rows():
    texts = ["ab-cd", "漢" * 10, "", "x" * 17, "|| a", "é" * 8 + "z"]
    enc = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(enc), np.uint8), np.cumsum([0] + [len(e) for e in enc])
    starts, stops, cut, words = toxicity.units(data, off)
    got = [[data[s:e].tobytes().decode(errors="replace") for s, e in zip(starts[a:b], stops[a:b])] for a, b in zip(words, words[1:])]
    assert got[0] == ["ab", "cd"] and got[2] == [] and got[4] == ["||", "a"]
    assert len(got[1]) == 10 and got[1][-1] == "漢" and got[3] == ["x" * 16, *("x" * n for n in range(16, 2, -1))]
    assert (starts >= np.repeat(off[:-1], np.diff(words))).all() and (stops <= np.repeat(off[1:], np.diff(words))).all()
    assert cut.tolist() == [False] * 2 + [True] * 25 + [False] * 2 + [True] * len(got[5])


def test_sliced_string_columns_keep_their_offsets():
    import pyarrow as pa

    arr = pa.array(["ab", None, "é", ""]).slice(1)
    data, off = string_bytes(arr)
    assert data.tobytes() == "é".encode() and off.tolist() == [0, 0, 2, 2]
