"""SimHash, repeated strings and embeddings against brute force."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quire.llm import components, embedding_dedup, queries, simhash, suffix_dedup
from tests.conftest import SF_SMALL


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_on_chains_stars_and_loops(spark):
    rnd = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (1, 2), (2, 1)]
    pairs += [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"), "a", "b").collect()}
    linked = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == {n: c for n, c in union_find(linked, [p for p in pairs if p[0] != p[1]]).items()}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_simhash(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bits", [0, 1, 3, 5])
def test_grid_join_finds_every_pair(spark, bits):
    rnd = random.Random(bits)
    fps = {0, (1 << 64) - 1, 1, 7, 1 << 63}
    for _ in range(40):
        base = rnd.getrandbits(64)
        fps |= {base} | {base ^ sum(1 << i for i in rnd.sample(range(64), k)) for k in range(1, 7) for _ in range(2)}
    signed = [simhash._signed(x) for x in fps]
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    assert got == want


def test_simhash_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    fp = {d: plain_simhash(t, 3) for d, t in texts.items()}
    ids = sorted(fp)
    root = union_find(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fp[a] ^ fp[b]).bit_count() <= 3])
    got = queries.op4_simhash(spark, SF_SMALL).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{fp[d]:016x}", root[d]) for d in ids} and len(got) == len(ids)


def test_simhash_odd_rows_and_keep_one(spark):
    rows = [(9, "a b c d e", "x"), (4, "A  b\tc d e", "x"), (6, "", "x"), (3, None, "x"), (8, "one", "x"), (None, "two words", "x"), (2, "q r s t", "x"), (2, "q r s t", "x"), (2, "long " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert len(got) == 9 and by[(6, 0)] == by[(3, 0)] == 3
    fp = simhash._signed(plain_simhash("a b c d e", 3))
    assert by[(9, fp)] == by[(4, fp)] == 4
    kept = sorted((str(r.doc_id), r.text, r.fp) for r in simhash.keep_one(df).collect())
    assert kept == sorted((str(d), t, "x") for d, t in [(4, "A  b\tc d e"), (3, None), (8, "one"), (None, "two words"), (2, "q r s t"), (2, "long " * 9000)])
    clear = df.filter("doc_id in (9, 4, 6, 3, 8)")
    assert {r.doc_id for r in simhash.keep_one(clear).collect()} == {4, 3, 8}
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def plain_repeats(texts, size):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + size] for t in raw for i in range(len(t) - size + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i:i + size]] > 1:
                gone[i:i + size] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def plain_word_repeats(texts, size):
    """(bytes, removed, runs, rest) with strings of ``size`` words."""
    found = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    seen = Counter(tuple(w[2] for w in f[i:i + size]) for f in found for i in range(len(f) - size + 1))
    out = []
    for t, f in zip(texts, found):
        raw = (t or "").encode()
        gone = np.zeros(len(f), bool)
        for i in range(len(f) - size + 1):
            if seen[tuple(w[2] for w in f[i:i + size])] > 1:
                gone[i:i + size] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        cuts = [(f[a][0], f[b - 1][1]) for a, b in zip(edge[::2], edge[1::2])]
        edges = [0, *[x for c in cuts for x in c], len(raw)]
        out.append((len(raw), sum(b - a for a, b in cuts), len(cuts), b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))))
    return out


@pytest.mark.parametrize("size,chunk", [(1, 300), (4, 300), (31, 4 << 20)])
def test_repeated_words_match_plain_search(spark, monkeypatch, size, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rnd = random.Random(size)
    passage = " ".join(f"p{i}é" for i in range(40))
    texts = [None, "", "  ", "one", passage, "x " + passage.replace(" ", "\n\t") + " y", passage, "z " * 60, " " + " ".join(f"q{i}" for i in range(60)) + "\n"]
    texts += [" ".join(rnd.choice([passage, *(f"w{rnd.randint(0, 400)}" for _ in range(6))]) for _ in range(rnd.randint(1, 30))) for _ in range(40)]
    texts += [" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(5000)) + " " + " ".join(passage.split()[:31])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, kept string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, length=size, unit="words").collect()}
    assert got == dict(enumerate(plain_word_repeats(texts, size)))


@pytest.mark.parametrize("limit", [5, 13, 72, 73, 181, 200, 500])
def test_difference_cover_has_every_residue(limit):
    period, cover = suffix_dedup.difference_cover(limit)
    assert period <= max(limit, 1) and {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("size, chunk", [(4, 1 << 20), (30, 300), (60, 2000), (400, 5000)])
def test_repeats_match_brute_force(spark, monkeypatch, size, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 256)
    monkeypatch.setattr(suffix_dedup, "NAMES_PER_TASK", 200)
    rnd = random.Random(size)
    word = lambda n: "".join(rnd.choice("abcdefghij é") for _ in range(n))
    passages = [word(size + rnd.randint(-2, size)) for _ in range(5)]
    texts = [None, "", "x" * (size * 3), "x" * (size - 1), "ab" * size]
    texts += [word(rnd.randint(0, 2 * size)) + rnd.choice(passages) * rnd.choice([0, 1, 1, 2]) + word(rnd.randint(0, size)) for _ in range(40)]
    texts += [texts[10], texts[11], texts[11], texts[12][:size + 1]]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, length=size).collect()}
    assert got == dict(enumerate(plain_repeats(texts, size)))


def test_repeats_query(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (n, gone, runs, hashlib.sha256(kept).hexdigest()) for r, (n, gone, runs, kept) in zip(rows, plain_repeats([r.text for r in rows], 400))}
    got = queries.op6_suffix_dedup(spark, SF_SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(rows)


def test_repeats_odd_rows(spark):
    same = "same text " * 50
    df = spark.createDataFrame([(1, same), (1, same), (None, "é" * 10), (2, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed, r.kept) for r in suffix_dedup.remove_repeats(df, length=40, as_text=True).collect())
    assert got == [("1", 500, ""), ("1", 500, ""), ("2", 0, ""), ("None", 0, "é" * 10)]
    assert suffix_dedup.remove_repeats(df.limit(0), length=40).count() == 0
    cut = spark.createDataFrame([(1, "aéaéaébbbb"), (2, "éaéaé")], "doc_id long, text string")
    assert all("�" not in r.kept for r in suffix_dedup.remove_repeats(cut, length=3, as_text=True).collect())


def embedding_rows(seed=0, dim=16, groups=30, hot=150):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for g in range(groups):
        base = rng.normal(size=dim)
        for _ in range(hot if g == 0 else rng.integers(1, 5)):
            rows.append((i, (base + rng.normal(size=dim) * 0.05).astype(np.float32).tolist(), g % 3))
            i += 1
    rows += [(i + k, rng.normal(size=dim).astype(np.float32).tolist(), k % 3) for k in range(300)]
    return rows


def plain_links(rows, threshold):
    pairs = []
    for i, (a, x, g) in enumerate(rows):
        for b, y, h in rows[:i]:
            if g == h and np.dot(x, y) >= threshold * np.linalg.norm(x) * np.linalg.norm(y):
                pairs.append((a, b))
    return pairs


def test_embedding_links_match_brute_force(spark):
    rows = embedding_rows()
    rows64 = [(i, np.array(x, np.float64), g) for i, x, g in rows]
    pairs = plain_links(rows64, 0.93)
    root = union_find([r[0] for r in rows], pairs)
    degree = Counter(n for p in pairs for n in p)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = embedding_dedup.near_duplicates(df, threshold=0.93, window=8, block=64).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (degree[i], root[i], root[i] == i) for i in root} and len(got) == len(rows)


def test_embedding_odd_rows(spark):
    one, nan = [1.0, 2.0], float("nan")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [None, 1.0], 1), (5, one, None), (6, one, None), (7, one, 1), (8, one, 1), (8, one, 1),
            (9, one, 2), (10, [], 1), (11, [1.0, 2.0, 0.0], 1), (12, [float("inf"), 1.0], 1), (None, [-2.0, 1.0], 3)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    linked = {"7": 2, "8": 2}
    assert got == sorted((str(r[0]), linked.get(str(r[0]), 0), "7" if str(r[0]) in linked else str(r[0]), str(r[0]) != "8") for r in rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_passes_grow_with_the_logarithm():
    few, many = embedding_dedup.passes_for(10**4, 32, 0.93, 0.005), embedding_dedup.passes_for(10**8, 32, 0.93, 0.005)
    assert 2 < few < many < 40 * few


def near(rng, base, cos, n):
    """n unit vectors at the given cosine to ``base``, in random directions."""
    base = base / np.linalg.norm(base)
    side = rng.normal(size=(n, len(base)))
    side -= np.outer(side @ base, base)
    side /= np.linalg.norm(side, axis=1)[:, None]
    return cos * base + np.sqrt(1 - cos * cos) * side


def test_links_of_groups_wider_than_a_window(spark, monkeypatch):
    """Loose groups, two copy groups in one component, and one vector beside a copy group."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 40 * 64 * 8, raising=False)
    rng = np.random.default_rng(3)
    loose = near(rng, rng.normal(size=64), 0.978, 300)
    b, lone = rng.normal(size=(2, 64))
    c, beside = near(rng, b, 0.95, 1)[0], near(rng, lone, 0.95, 1)[0]
    x = [*loose, *[b] * 150, *[c] * 120, *[lone] * 100, beside, *rng.normal(size=(50, 64))]
    order = rng.permutation(len(x))
    rows = [(i, x[j].tolist(), 1) for i, j in enumerate(order)]
    pairs = plain_links([(i, np.array(v), g) for i, v, g in rows], 0.93)
    root = union_find(range(len(rows)), pairs)
    degree = Counter(n for p in pairs for n in p)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = embedding_dedup.near_duplicates(df, threshold=0.93, window=8).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (degree[i], root[i]) for i in root} and len(got) == len(rows)
    assert max(degree.values()) > 250


def test_links_among_crowded_groups_are_found(spark):
    """Many copy groups round one centre, and beside each one vector that is linked with it alone."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(2):
        centres = near(rng, rng.normal(size=64), 0.922, 60)
        for c in centres:
            rows += [(len(rows) + k, c.tolist(), g) for k in range(40)]
            rows.append((len(rows), near(rng, c, 0.935, 1)[0].tolist(), g))
    label = np.array([r[2] for r in rows])
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = (x @ x.T >= 0.93) & (label[:, None] == label)
    root = union_find(range(len(rows)), [(int(a), int(b)) for a, b in zip(*np.nonzero(hit)) if a < b])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = embedding_dedup.near_duplicates(df, threshold=0.93).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(hit[i].sum()) - 1, root[i]) for i in root}
