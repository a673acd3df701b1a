"""Corpus pipeline: from raw documents to encoded training texts.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, mixing, sentencepiece_codec, simhash, suffix_dedup
from quire.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of the shortest repeated passage that goes.
PASSAGE_WORDS = 51


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language; ``lang`` becomes the predicted one.

    Rejected: null texts and texts without a letter (``und``)."""
    model = langid.fit(docs)
    out = langid.identify(docs, model, carry=["doc_id", "text", "source", "n_chars"])
    return out.filter(F.col("lang_pred") != "und").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each SimHash component (3-word shingles, 3 bits)."""
    return simhash.keep_one(docs.select(*COLUMNS), shingle=3, max_bits=3)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out every passage of over 50 words that starts anywhere else too; all documents stay, also emptied ones.

    Counted in words, not in bytes: 51 words have some 300 bytes in prose and may have a third of that, and a byte length that
    short would also cut phrases that clean documents share."""
    out = suffix_dedup.remove_repeats(docs, carry=["doc_id", "lang", "source"], length=PASSAGE_WORDS, unit="words", as_text=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix says: no, one or two rows; documents without words are never taken."""
    out = mixing.mix(docs, carry=COLUMNS).filter("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text with an end id and decode it again."""
    import public_tokenizers

    out = sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_dedup),
    ("mixing", mix_sources),
    ("SentencePiece encoding", encode),
]

#: The stages hold learned models, byte-level matching and a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's result is written to the shared scratch folder."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
