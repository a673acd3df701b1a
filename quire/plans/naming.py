"""Queries over file names: safe stems, kinds, display names, media types, admission."""
from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import names as N
from quire.operators.admission import admission_split, staged_dedup
from quire.plans import sqlfrag as Q
from quire.sources import fixtures as FX
from quire.sources.fixtures import FIXTURE_SUFFIXES

QUERIES = {}
ORACLE = {}


def _sql_first_line(x: str) -> str:
    return f"regexp_extract({x}, '^([^\\n]*)', 1)"


SQL_DOC_NAMES = f"SELECT doc_id, {_sql_first_line('text')} || '.pdf' AS original_name FROM documents"
_SQL_SFX = f"([{', '.join(Q.lit(s) for s in FIXTURE_SUFFIXES)}])[(doc_id % {len(FIXTURE_SUFFIXES)}) + 1]"
SQL_MIXED_NAMES = (f"SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN {_SQL_SFX} "
                   f"ELSE {_sql_first_line('text')} || {_SQL_SFX} END AS name, n_chars AS size FROM documents")


# -- sanitize_stem (STRG-1, SRC-3, LIM-1) -------------------------------------
def q_sanitize_stem(spark, sf_dir):
    names = FX.document_names(spark, sf_dir)
    stem = N.sanitize_stem("original_name")
    return names.select("doc_id", "original_name", stem.alias("stem"),
                        F.octet_length(stem).cast("bigint").alias("stem_bytes"))


QUERIES["sanitize_stem"] = q_sanitize_stem
ORACLE["sanitize_stem"] = Q.with_ctes(
    [f"n AS ({SQL_DOC_NAMES})"] + Q.sanitize_ctes("n", "original_name", "stem"),
    "SELECT doc_id, original_name, stem, CAST(strlen(stem) AS BIGINT) AS stem_bytes FROM ss5")


# -- file_kind (PRJ-1, STRG-2, SRC-3) -------------------------------------------
def q_file_kind(spark, sf_dir):
    f = FX.mixed_names(spark, sf_dir)
    return f.select("doc_id", "name", N.name_stem(N.base_name("name")).alias("stem"),
                    N.lower_suffix("name").alias("suffix"), N.file_kind("name").alias("kind"))


QUERIES["file_kind"] = q_file_kind
ORACLE["file_kind"] = (
    f"SELECT doc_id, name, {Q.stem(Q.base_name('name'))} AS stem, {Q.lower_suffix('name')} AS suffix, "
    f"{Q.file_kind('name')} AS kind FROM ({SQL_MIXED_NAMES})")


# -- display_name (STRG-3) ----------------------------------------------------------
def q_display_name(spark, sf_dir):
    f = FX.mixed_names(spark, sf_dir)
    return f.select("doc_id", "name", N.display_name("name").alias("display"))


QUERIES["display_name"] = q_display_name
ORACLE["display_name"] = (
    f"SELECT doc_id, name, regexp_replace(name, '\\.[^.]+\\z', '') AS display FROM ({SQL_MIXED_NAMES})")


# -- media_type (SRC-13) ------------------------------------------------------------
def q_media_type(spark, sf_dir):
    f = FX.mixed_names(spark, sf_dir)
    return f.select("doc_id", "name", N.media_type("name").alias("media_type"),
                    N.preview_class("name").alias("preview"))


_SQL_MIME = ("CASE " + " ".join(f"WHEN {Q.lower_suffix('name')} = {Q.lit(k)} THEN {Q.lit(v)}"
                                for k, v in N.MEDIA_TYPES.items())
             + f" ELSE {Q.lit(N.DEFAULT_MEDIA_TYPE)} END")
QUERIES["media_type"] = q_media_type
ORACLE["media_type"] = (
    f"SELECT doc_id, name, {_SQL_MIME} AS media_type, "
    f"CASE WHEN regexp_matches(name, {Q.lit(N.PDF_PREVIEW_PATTERN)}) THEN 'pdf' "
    f"WHEN regexp_matches(name, {Q.lit(N.IMAGE_PREVIEW_PATTERN)}) THEN 'image' ELSE 'other' END AS preview "
    f"FROM ({SQL_MIXED_NAMES})")


# -- admission_split (SRC-4, SRC-5, JON-4, AGG-5) -------------------------------------
def q_admission_split(spark, sf_dir):
    f = FX.mixed_names(spark, sf_dir)
    tagged = admission_split(f, "name")
    return tagged.select("doc_id", "name", "decision",
                         N.is_supported_client("name").alias("client_ok"))


QUERIES["admission_split"] = q_admission_split
ORACLE["admission_split"] = (
    f"SELECT doc_id, name, CASE WHEN {Q.is_supported('name')} THEN 'accepted' ELSE 'skipped' END AS decision, "
    f"{Q.is_supported_client('name')} AS client_ok FROM ({SQL_MIXED_NAMES})")


# -- staged_dedup (AGG-7) ---------------------------------------------------------------
def q_staged_dedup(spark, sf_dir):
    from quire.session import read_table

    d = read_table(spark, sf_dir, "documents")
    files = d.select(F.concat("lang", F.lit("-"), "source", F.lit(".pdf")).alias("name"),
                     F.col("n_chars").alias("size"), F.col("doc_id").alias("arrival"))
    return staged_dedup(files, "name", "size", "arrival")


QUERIES["staged_dedup"] = q_staged_dedup
ORACLE["staged_dedup"] = (
    "SELECT name, size, min(arrival) AS arrival FROM ("
    "SELECT lang || '-' || source || '.pdf' AS name, n_chars AS size, doc_id AS arrival FROM documents) "
    f"WHERE {Q.is_supported_client('name')} GROUP BY name, size")
