"""Chat formatting, fingerprints, mixing and the pipeline against plain versions."""
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import chat_format, fingerprints, langid, mixing, queries
from scripts.check_oracle import TABLES, digest
from tests.conftest import SF_SMALL
from tests.llm.test_dedup import plain_simhash, plain_word_repeats, union_find


# chat formatting

def test_escaping_is_reversible():
    rnd = random.Random(1)
    parts = [*chat_format.CONTROL, "[", "\\", "<", "/s>", "s>", "[\\INST]", "[\\\\INST]", "<\\s>", "é"]
    for _ in range(3000):
        s = "".join(rnd.choice(parts) for _ in range(7))
        e = chat_format.escape(s)
        assert chat_format.unescape(e) == s and not any(c in e for c in chat_format.CONTROL)


def plain_digest(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
    said = [r[3] or "" for r in rows if r[2] == "assistant"]
    return (len(rows), hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows).encode()).hexdigest(),
            sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())


def test_conversations_read_back(spark):
    rnd = random.Random(2)
    text = lambda: rnd.choice([None, "", "plain", "</s>[INST] ok [/INST]", "é😀[ROLE]", "x" * 50_000, "a\\<s>"])
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "<s>"]), text()) for c in [1, 2, None, -9] for t in range(6)]
    rows += [(7, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)]
    rows += [(8, 0, "user", "same"), (8, 0, "user", "same"), (8, None, "assistant", "first"), (8, 0, "assistant", "tie")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    segments = chat_format.format_conversations(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(segments).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert got == {c: plain_digest(v) for c, v in by.items()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert segments.filter("conv_id = 7").select("part").distinct().count() > 1  # a long conversation is spread
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


def test_segments_hold_the_template(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi <s>"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    rows = chat_format.format_conversations(df).orderBy("part", "seq").collect()
    assert "".join(r.formatted for r in rows) == "<s>[ROLE]user[/ROLE]hi <\\s></s><s>[ROLE]assistant[/ROLE]yo</s>"
    assert [r.formatted.encode()[s.start:s.stop] for r in rows for s in r.loss] == [b"yo"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF_SMALL)
    res = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(got.columns)
    assert digest(got.columns, [tuple(r) for r in got.collect()])[0] == digest(cols, res.fetchall())[0]


# fingerprints

def test_prefix_hashes_answer_spans_and_extensions():
    rnd = random.Random(3)
    a, b = ("".join(rnd.choice("ab") for _ in range(200)) for _ in range(2))
    ha, hb = fingerprints.PrefixHashes(a), fingerprints.PrefixHashes(b)
    for _ in range(500):
        i, j, n = rnd.randrange(190), rnd.randrange(190), rnd.randrange(10)
        assert bool(fingerprints.spans_equal(ha, i, hb, j, n)) == (a[i:i + n] == b[j:j + n])
        want = next((k for k in range(min(200 - i, 200 - j)) if a[i + k] != b[j + k]), min(200 - i, 200 - j))
        assert fingerprints.longest_common_extension(ha, i, hb, j) == want


def test_powers_and_folds_are_exact():
    p = fingerprints._powers(fingerprints.BASES[0], 1000)
    assert [int(x) for x in p[::97]] == [pow(fingerprints.BASES[0], i, fingerprints.P) for i in range(0, 1000, 97)]
    x = np.array([0, 1, fingerprints.P - 1, fingerprints.P, (1 << 62) - 1], np.uint64)
    assert fingerprints._fold(x).tolist() == [int(v) % fingerprints.P for v in x]


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_edited_fingerprints_match_the_edited_text(monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab é😀") for _ in range(rnd.choice([0, 1, 5, 15, 16, 17, 40, 100]))) for _ in range(120)]
    for t, nxt, got in zip(texts, texts[1:], fingerprints.compare_edited(texts)):
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        n, sha, own, other, near, near_next = got
        assert (n, sha) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert own == fingerprints.fingerprint(t) and other == fingerprints.fingerprint(edited)
        assert near == pytest.approx(fingerprints.likeness(own, other)) and near_next == pytest.approx(fingerprints.likeness(own, fingerprints.fingerprint(nxt)))


def plain_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        out.append((str(i), len(t), hashlib.sha256((t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]).encode()).hexdigest(), fingerprints.fingerprint(t)))
    return sorted(out)


def test_next_document_in_order(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(-50, 200), "".join(rnd.choice("abc ") for _ in range(rnd.randrange(60)))) for _ in range(300)]
    rows += [(None, "no id"), (None, None), (5, "tie b"), (5, "tie a"), (9999, "x" * 30_000)]
    for part in (rows, rows[:1], rows[:2]):
        df = spark.createDataFrame([(*r, 1) for r in part], "doc_id long, text string, n_chars int").repartition(3)
        got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint) for r in fingerprints.fingerprints(df).collect())
        assert got == plain_edits(part)
    assert fingerprints.fingerprints(df.limit(0)).count() == 0


def test_fingerprint_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op5_fingerprints(spark, SF_SMALL)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint) for r in got.collect()) == plain_edits(docs)
    r = got.agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert 0.4 < r.e < 0.65 and r.n < 0.1


# mixing

def plain_targets(totals, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(totals, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, share * sum(totals.values()), set(order)
    while free:
        level = left / sum(w[s] for s in free)
        above = {s for s in free if level * w[s] > cap * totals[s]}
        if not above:
            return out | {s: level * w[s] for s in free}
        for s in above:
            out[s] = cap * totals[s]
            left -= out[s]
        free -= above
    return out


def check_mix(rows, got):
    sizes = {}
    for d, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes.setdefault(s, []).append(n)
    totals = {s: sum(v) for s, v in sizes.items()}
    want = plain_targets(totals)
    source = {d: s for d, _, s in rows}
    taken = dict.fromkeys(totals, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == totals[s] and r.target == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    assert len(got) == len(rows)
    return totals, want, taken, sizes


def test_mixing_meets_targets(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    first, again = (queries.op8_mixing(spark, SF_SMALL).collect() for _ in range(2))
    totals, want, taken, sizes = check_mix(rows, first)
    assert sorted(first) == sorted(again)
    for s in totals:
        assert abs(taken[s] - want[s]) <= max(sorted(sizes[s])[len(sizes[s]) // 2], 0.05 * want[s]), (s, taken[s], want[s], sorted(sizes[s]))


def test_mixing_hot_null_and_empty_sources(spark):
    rnd = random.Random(6)
    words = lambda n: " ".join("w" * rnd.randint(1, 5) for _ in range(n))
    rows = [(i, words(rnd.randint(1, 60)), "hot") for i in range(400)]
    rows += [(1000 + i, words(rnd.randint(0, 40)), rnd.choice(["a", "é", "Z", None, ""])) for i in range(200)]
    rows += [(2000, None, "void"), (2001, " \t", "void"), (2002, words(3000), "a"), (2003, None, None)]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, source string, target double, size int").repartition(4)
    got = mixing.mix(df).collect()
    totals, want, taken, sizes = check_mix(rows, got)
    for s in totals:
        assert abs(taken[s] - want[s]) <= max([1, *sorted(sizes[s])[:-1]]), (s, taken[s], want[s])
    # rates are tilted by size: one exponent for a source
    hot = [r for r in got if r.doc_id < 400 and r.rate < 2]
    exponents = [np.log(r.rate) / r.size for r in hot]
    assert np.ptp(exponents) < 1e-9
    assert mixing.mix(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(df.filter("doc_id = 2000")).collect()] == [0]


def test_mixing_plan_has_no_python(spark):
    out = queries.op8_mixing(spark, SF_SMALL)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# pipeline

def test_pipeline_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", "src0", 0), (900_002, "12 34 !!", "en", "src0", 8), (900_003, "the thing", None, None, 9)], docs.schema)
    docs = docs.unionByName(odd)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    results, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF_SMALL)
        rows = out.collect()
        if len(results) < 4:
            assert out.columns == corpus_pipeline.COLUMNS
            now = spark.createDataFrame(rows, docs.schema)
        results.append(rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    letters = {d for d, t in text.items() if t is not None and any(c.isalpha() for c in t)}
    assert {r.doc_id for r in results[0]} == letters
    model = langid.fit(docs)
    pred, _ = langid.score_texts(model, [r.text for r in results[0]])
    assert [r.lang for r in results[0]] == pred
    ids = sorted(letters)
    fp = {d: plain_simhash(text[d], 3) for d in ids}
    root = union_find(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fp[a] ^ fp[b]).bit_count() <= 3])
    assert sorted(r.doc_id for r in results[1]) == sorted(set(root.values()))
    left = {r.doc_id: r for r in results[2]}
    for r, (_, _, _, kept) in zip(results[1], plain_word_repeats([r.text for r in results[1]], corpus_pipeline.PASSAGE_WORDS)):
        assert left[r.doc_id].text == kept.decode("utf-8", "ignore") and left[r.doc_id].n_chars == len(left[r.doc_id].text)
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(results[2], docs.schema)).collect()}
    assert sorted(r.doc_id for r in results[3]) == sorted(d for d, c in copies.items() for _ in range(c))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in results[4]:
        assert r.ids == " ".join(map(str, sp.encode(left[r.doc_id].text, add_eos=True)))
    assert len(results[4]) == len(results[3])


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 100
