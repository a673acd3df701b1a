"""Registered queries over the driver tables.

Each ``opN_<name>`` reads its whole table and derives the contract's columns from its
operator's output.  ``ORACLE`` holds DuckDB twins; operators that SQL cannot express are
tested against brute force in ``tests/llm``.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat_format, embedding_dedup, fingerprints, langid, merkle, mixing, quality, quality_rules, sentencepiece_codec, simhash, suffix_dedup, toxicity, whitening
from quire.llm.common import crc_remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 4 = 2 are held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, keep=crc_remainder("doc_id", 4) != 2)
    out = langid.identify(docs, model)
    return out.select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with equal labels and a cosine of at least 0.93."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; rows with crc32(doc_id) mod 5 = 0 are held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), keep=crc_remainder("_id", 5) != 0)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with an end id, and decoded again."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint (3-word shingles) and component (3 bits) of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text edited with the next document's."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that start anywhere else too.

    Further columns: ``spans`` that were removed, and the passages of over 50 words that start anywhere else too, however
    few bytes they have: ``n_passages`` and ``passage_bytes``, which the 400 bytes do not decide."""
    docs = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), carry=["doc_id", "text"], length=51, unit="words")
    docs = docs.select("doc_id", "text", F.size("spans").cast("long").alias("n_passages"), F.col("n_removed").alias("passage_bytes"))
    out = suffix_dedup.remove_repeats(docs, carry=["doc_id", "n_passages", "passage_bytes"], length=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "spans", "n_passages", "passage_bytes")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document so that each source's words come near its target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(extra)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows with crc32(doc_id) mod 3 = 1 are held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), keep=crc_remainder("_id", 3) != 1)
    out = quality.score(docs, model)
    return out.select("doc_id", (crc_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, votes and verdict of the quality rules for every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector, as whole numbers of 1/64 before centring."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16, scale=64, offset=1_000_000)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proof of every document; a fifth of the rows is found with its capitals lower-cased."""
    tampered = crc_remainder("doc_id", 5) == 0
    found = F.when(tampered & F.col("doc_id").isNotNull(), merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), seen={"text": found})


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_sentencepiece": op3_sentencepiece,
    "op7_language_id": op7_language_id,
    "op4_simhash": op4_simhash,
    "op5_fingerprints": op5_fingerprints,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op8_mixing": op8_mixing,
    "op9_chat_format": op9_chat_format,
    "op10_quality": op10_quality,
    "op11_quality_rules": op11_quality_rules,
    "op12_whitening": op12_whitening,
    "op13_merkle": op13_merkle,
}

def merkle_sql(levels: int = 5) -> str:
    """DuckDB twin of ``op13_merkle`` for up to 16 ** levels rows a source and as many sources."""
    framed = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    step = "list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda b, z: CASE WHEN b % 2 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(str_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, x: {step}))"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS k, {leaf('text')} AS leaf,
                          CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS seen FROM documents)""",
             "a0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS j, leaf AS h, doc_id, seen FROM d)",
             "af0 AS (SELECT doc_id, k AS own, k, j, h AS leaf, seen AS f, '' AS sib FROM a0)"]

    def climb(t: str) -> None:
        for i in range(levels):
            side = f"string_agg(h, '') OVER (PARTITION BY k, j // 16 ORDER BY j ROWS BETWEEN"
            parts.append(f"""{t}w{i} AS (SELECT k, j, h, count(*) OVER (PARTITION BY k) AS n, coalesce({side} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
                             coalesce({side} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS e FROM {t}{i})""")
            parts.append(f"{t}{i + 1} AS (SELECT k, j // 16 AS j, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY j)) END AS h FROM {t}w{i} GROUP BY k, j // 16)")
            parts.append(f"""{t}f{i + 1} AS (SELECT doc_id, own, k, f.j // 16 AS j, leaf, CASE WHEN n = 1 THEN f ELSE sha256(b || f || e) END AS f, sib || b || e AS sib
                             FROM {t}f{i} f JOIN {t}w{i} w USING (k) WHERE w.j = f.j)""")

    climb("a")
    parts.append(f"b0 AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS j, h, k AS own FROM a{levels})")
    parts.append(f"bf0 AS (SELECT doc_id, a.own, '' AS k, b0.j, leaf, f, sib FROM af{levels} a JOIN b0 USING (own))")
    climb("b")
    return f"""WITH {', '.join(parts)}
        SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = r.h AS verified
        FROM bf{levels} x JOIN a{levels} s ON s.k = x.own JOIN b{levels} r ON true"""


ORACLE: dict[str, str] = {
    "op13_merkle": merkle_sql(),
    "op1_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
        deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN deg ON deg.a = vec_id
    """,
    "op9_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, len(regexp_extract_all(body, '[<\[]\\*(s>|/s>|ROLE\]|/ROLE\]|INST\]|/INST\])')) AS added,
                   len(regexp_extract_all(role, '[<\[]\\*(s>|/s>|ROLE\]|/ROLE\]|INST\]|/INST\])')) AS added_role FROM t)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
               coalesce(sum(length(body)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(body, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(body) + length(role) + added + added_role + length('<s>[ROLE]') + length('[/ROLE]') + length('</s>'))::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
}
