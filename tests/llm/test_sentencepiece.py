"""The chunk table gives what the library gives."""
import hashlib
import random

import public_tokenizers
import sentencepiece

from quire.llm import queries
from quire.llm import sentencepiece_codec as S
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", S.MARK, "\n", "\t", "é", "😀", "日", "the", "ing", ".", "\x00", "<s>", "</s>", "<0x41>", "　", "�", "​"]


def test_random_texts_equal_the_library(monkeypatch):
    monkeypatch.setattr(S, "TABLE_ENTRIES", 500)
    monkeypatch.setattr(S, "TABLE_CHUNK", 12)
    rnd = random.Random(1)
    texts = ["", " ", "  ", " a ", "a" * 5000, "ab " * 5000] + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    codec = S.Codec(PATH, S.chunkable(PATH))
    assert codec.by_chunk
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for at in range(0, len(texts), 500):
        part = texts[at:at + 500]
        for t, (n, ids, back) in zip(part, codec.encode_decode(part)):
            want = sp.encode(t, add_eos=True)
            assert (n, ids, back) == (len(want), " ".join(map(str, want)), sp.decode(want)), repr(t)


def test_query_on_whole_table(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = queries.op3_sentencepiece(spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = sp.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (None, "a", None)], "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), r.n_tokens, r.decoded) for r in S.encode_decode(df, PATH).collect())
    assert got == [("1", 1, ""), ("2", 1, ""), ("3", 3, "a b"), ("3", 3, "a b"), ("None", 2, "a")]
    assert S.encode_decode(df.limit(0), PATH).count() == 0
