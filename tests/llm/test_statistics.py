"""Quality rules, whitening and the Merkle manifest against plain versions."""
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import merkle, quality_rules, queries, whitening
from tests.conftest import SF_SMALL

# quality rules


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    n, again = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), again, n < 50 or 100 * again > 50 * n)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_rule_counts_on_edge_texts(spark):
    rnd = random.Random(5)
    texts = [None, "", " \t\n\x0b", "one", "a b", "a b c", "a a a a", "a a a", "a b c a b c", "a b c x a b c y c x a", "é é z", "x\n\nx\n x\nx", "#*$%&|<> $$", "x" * 100_000]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 40))) + rnd.choice(["", "\n", "\na b\na b"]) for _ in range(200)]
    texts += [" ".join(rnd.choice(["w%d" % i for i in range(2000)]) for _ in range(20_000))]
    df = spark.createDataFrame([(i, t, "x", 1.0, True) for i, t in enumerate(texts)] + [(None, "a b c a b c", "x", 1.0, True)] * 2,
                               "doc_id long, text string, n_words string, quality double, kept boolean").repartition(4)
    out = quality_rules.judge(df)
    got = [(r.doc_id, *[r[c] for c in BASE]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(i, *plain_base(t)) for i, t in enumerate(texts)] + [(None, *plain_base("a b c a b c"))] * 2, key=str)
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_quality_rules_on_the_documents(spark):
    out = queries.op11_quality_rules(spark, SF_SMALL)
    rows = {r.doc_id: r for r in out.collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall()
    assert len(rows) == len(docs)
    for i, t in docs:
        assert tuple(rows[i][c] for c in BASE) == plain_base(t)
        assert not (rows[i].kept and rows[i].base_failed)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op11_quality_rules(spark, sf).select("doc_id", "kept", "base_failed")
    lab = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("y"))
    rows = out.join(lab, "doc_id").filter("NOT base_failed").collect()
    assert sum(r.kept for r in rows if r.y == 1) == sum(r.y == 1 for r in rows) > 100
    assert not any(r.kept for r in rows if r.y == 0) and any(r.y == 0 for r in rows)


def plain_estimate(votes, n):
    """Expectation-maximisation in floating point, vote vectors as rows."""
    good = np.where((votes == -1).any(1), quality_rules.START_BAD, quality_rules.START_GOOD)
    k = quality_rules.PRIOR_VOTES
    for _ in range(quality_rules.MAX_STEPS):
        g, b = good * n, (1 - good) * n
        bad, said = votes == -1, votes != 0
        fa = np.minimum(quality_rules.MAX_FALSE_ALARM, (g @ bad + k * quality_rules.FALSE_ALARM) / (g @ said + k))
        catch = np.maximum(fa, (b @ bad + k * quality_rules.CATCH) / (b @ said + k))
        prior = (g.sum() + k * quality_rules.PRIOR) / (n.sum() + k)
        odds = np.log(prior / (1 - prior)) + np.where(bad, np.log(fa / catch), np.where(said, np.log((1 - fa) / (1 - catch)), 0)).sum(1)
        good = 1 / (1 + np.exp(-odds))
    return prior, fa, catch, good


def test_estimation_is_plain_expectation_maximisation(spark):
    rnd = np.random.default_rng(3)
    rules = quality_rules.RULES
    truth = rnd.random(4000) < 0.7
    bad = np.where(truth[:, None], 0.001, np.linspace(0.1, 0.6, len(rules)))
    votes = np.where(rnd.random((4000, len(rules))) < 0.2, 0, np.where(rnd.random((4000, len(rules))) < bad, -1, 1))
    rows, n = np.unique(votes, axis=0, return_counts=True)
    df = spark.createDataFrame([(*map(int, r), int(c)) for r, c in zip(rows, n)], ", ".join(f"v_{r.name} tinyint" for r in rules) + ", _n long")
    trust = quality_rules.estimate(df)
    prior, fa, catch, good = plain_estimate(rows, n)
    assert abs(trust.prior - prior) < 1e-3 and abs(trust.prior - truth.mean()) < 0.08
    assert np.abs(np.array(trust.catch) - catch).max() < 2e-3 and np.abs(np.array(trust.false_alarm) - fa).max() < 1e-4
    got = df.select("_n", quality_rules.posterior(trust).alias("q"), *[f"v_{r.name}" for r in rules]).collect()
    want = {tuple(r): q for r, q in zip(rows.tolist(), good)}
    assert all(abs(r.q - want[tuple(r[2:])]) < 5e-3 for r in got)
    assert quality_rules.estimate(df.limit(0)).prior == quality_rules.PRIOR  # no rows: the smoothing alone


# whitening

def plain_whiten(rows, k=16, offset=1_000_000):
    """(n, deviations by id, whitened up to signs by id, explained) by an eigendecomposition of the covariance."""
    x = {i: np.array([int(np.floor(64 * c)) + offset for c in v], object) for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, s = len(fit), fit.sum(0)
    centred = ((n * fit - s) / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-12 * e[0]).sum()))
    num = {i: n * r - s for i, r in x.items()}
    return n, {i: int((r ** 2).sum()) for i, r in num.items()}, {i: (r / n).astype(float) @ v[:, :k] / np.sqrt(e[:k]) for i, r in num.items()}, e[:k] / e.sum()


def same_whitening(out, rows, k=16):
    n, dev, white, explained = plain_whiten(rows, k)
    got = {}
    for r in out.collect():
        assert r.n == n and r.deviation == dev[r.vec_id] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        got.setdefault(r.vec_id, {})[r.component] = r.whitened
    ids = sorted(got)
    assert ids == sorted(white) and all(sorted(g) == list(range(1, len(explained) + 1)) for g in got.values())
    a, b = np.array([[got[i][c] for c in sorted(got[i])] for i in ids]), np.array([white[i] for i in ids])
    assert np.abs(a - b * np.sign((a * b).sum(0))).max() < 1e-8


def test_whitening_matches_eigenvectors(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF_SMALL}/embeddings.parquet'").fetchall()
    same_whitening(queries.op12_whitening(spark, SF_SMALL), rows)


def test_whitening_edge_rows(spark):
    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(300, 5)) * [1, 30, 0.5, 4, 9] + [0, 1e4, -7, 3, 2]
    full = np.column_stack([base, np.full(300, 2.5), base[:, 1]])  # a constant dimension and one that depends on another
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(full)] + [(1000 + i, [float(c) for c in full[i % 3]]) for i in range(200)]
    odd = [(5000, None), (5001, []), (5002, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0]), (5003, [float("nan")] * 7), (5004, [float("inf")] + [0.0] * 6), (5005, [1.0] * 8), (5006, [1e300] + [0.0] * 6)]
    make = lambda r: spark.createDataFrame([(i, v, "x", 3) for i, v in r], "vec_id long, embedding array<double>, component string, n int").repartition(6)
    same_whitening(whitening.whiten(make(rows + odd), scale=64, offset=1_000_000), rows)
    assert whitening.whiten(make(odd)).count() == 0 and whitening.whiten(make(rows[:1] * 9)).count() == 0 and whitening.whiten(make([])).count() == 0
    floats = make(rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert whitening.whiten(floats, components=2).count() == 2 * len(rows)


def test_deviations_stay_exact():
    x = np.array([[0, 0], [1 << 36, 3], [5, 1 << 36]], np.int64)
    n, s = 1 << 20, [((1 << 20) - 2) * 7 + (1 << 36), 12345]
    num = n * x.astype(object) - np.array(s, object)
    assert whitening.Centre(n, s).numerators(x).tolist() == num.tolist()
    assert whitening.Centre(n, s).deviations(x) == [v if v < 1 << 63 else None for v in (num ** 2).sum(1).tolist()]


def test_triangular_solves_and_ill_conditioned_rows():
    rnd = np.random.default_rng(1)
    q, _ = np.linalg.qr(rnd.normal(size=(2000, 8)))
    a = q @ np.diag(np.logspace(0, -7, 8)) @ np.linalg.qr(rnd.normal(size=(8, 8)))[0]
    r = whitening.cholesky_qr(lambda f: (lambda x: x.T @ x)(whitening.solve(a, f)), 2000, 8)
    assert np.allclose(np.linalg.svd(r)[1], np.logspace(0, -7, 8), rtol=1e-7)  # the covariance's own eigenvalues would keep no digit of the last


# Merkle manifest

def node(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([node(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        run = i - i % 16
        out.append((level[run:i], level[i + 1:run + 16]))
        i //= 16
    return out


def plain_leaf(row):
    return node(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_manifest(rows, found):
    """rows (doc_id, source, lang, n_chars, text) and their texts as found -> results as a list."""
    by = {}
    for r, f in zip(rows, found):
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r[0], plain_leaf((*r[:4], f))))
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        by[k].sort(key=lambda r: r[:3])
    trees = [plain_tree([r[2] for r in by[k]]) for k in keys]
    top = plain_tree([t[-1][0] for t in trees])
    root, out = top[-1][0] if keys else None, []
    for j, k in enumerate(keys):
        for i, r in enumerate(by[k]):
            path, folded = plain_path(trees[j], i) + plain_path(top, j), r[4]
            for before, after in path:
                folded = node(*before, folded, *after)
            out.append((r[3], r[2], trees[j][-1][0], root, node(*[x for b, a in path for x in b + a]), folded, folded == root))
    return out


def results(df):
    return sorted([tuple(r[:7]) for r in df.collect()], key=str)


@pytest.mark.parametrize("sizes", [[1], [16, 2, 1, 17, 256, 257], [4097, 33, 1, 300], [1] * 40 + [5000]])
def test_manifest_of_tree_shapes(spark, sizes):
    rows = [(s * 100_000 + i, None if s == 3 else f"s{s}é", None if i % 7 == 0 else "en", i if i % 5 else None, None if i % 11 == 0 else f"Text É {i}") for s, n in enumerate(sizes) for i in range(n)]
    random.Random(2).shuffle(rows)
    found = [r[4].lower().replace("é", "É") if r[4] and r[0] % 3 == 0 else r[4] for r in rows]
    df = spark.createDataFrame([(*r, f, "x") for r, f in zip(rows, found)], "doc_id long, source string, lang string, n_chars long, text string, found string, leaf string").repartition(5)
    out = merkle.manifest(df, seen={"text": F.col("found")}, min_hot_rows=1000)
    assert results(out) == sorted(plain_manifest(rows, found), key=str)


def test_many_sources_and_proofs(spark):
    rows = [(i, f"src{i % 700}", "en", 1, f"t{i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    out = merkle.manifest(df, with_proof=True).collect()
    assert sorted([tuple(r[:7]) for r in out], key=str) == sorted(plain_manifest(rows, [r[4] for r in rows]), key=str)
    assert all(node(*r.proof) == r.proof_sha256 and r.verified for r in out)


def test_manifest_of_null_and_repeated_ids(spark):
    rows = [(None, None, None, None, None)] * 3 + [(1, "a", "en", 1, "Same")] * 20 + [(1, "a", "en", 1, "other")] + [(2, "", "", 0, ""), (3, "a", "x", 2, "y" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    assert results(merkle.manifest(df)) == sorted(plain_manifest(rows, [r[4] for r in rows]), key=str)
    assert merkle.manifest(df.limit(0)).count() == 0


def test_manifest_query_finds_tampering(spark):
    out = queries.op13_merkle(spark, SF_SMALL)
    docs = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{SF_SMALL}/documents.parquet'").fetchall()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [r[4].translate(low) if r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4] for r in docs]
    assert results(out) == sorted(plain_manifest(docs, found), key=str)
    assert {r.verified for r in out.collect()} == {True, False}
