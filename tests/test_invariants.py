from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_ORACLE


def test_stems_are_short_valid_and_nonempty(spark):
    s = E.queries()["sanitize_stem"](spark, SF_ORACLE)
    r = s.agg(F.max("stem_bytes").alias("mx"), F.count_if(~F.is_valid_utf8("stem")).alias("bad"),
              F.count_if(F.col("stem") == "").alias("empty")).first()
    assert r.mx <= 96 and r.bad == 0 and r.empty == 0


def test_admission_loses_no_row(spark):
    a = E.queries()["admission_split"](spark, SF_ORACLE)
    counts = {r.decision: r["count"] for r in a.groupBy("decision").count().collect()}
    n = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").count()
    assert sum(counts.values()) == n and set(counts) <= {"accepted", "skipped"}


def test_export_names_unique_case_insensitively(spark):
    f = E.queries()["flat_export"](spark, SF_ORACLE)
    md = f.filter(F.col("kind") == "markdown")
    assert md.select(F.lower("file_name")).distinct().count() == md.count()


def test_blocks_per_document_match_counts(spark):
    b = E.queries()["extract_text_blocks"](spark, SF_ORACLE).groupBy("doc_id").count()
    d = E.queries()["extract_text_documents"](spark, SF_ORACLE)
    j = d.join(b, "doc_id", "left")
    assert j.filter(F.coalesce(F.col("count"), F.lit(0)) != F.col("blocks")).count() == 0


def test_stream_replay_equals_batch_twin(spark):
    s = E.queries()["stream_lifecycle"](spark, SF_ORACLE)
    b = E.queries()["job_lifecycle"](spark, SF_ORACLE)
    assert s.exceptAll(b.select(*s.columns)).count() == 0 and b.count() == s.count()
