"""Queries over the blocks table (content lists from ``conversations``)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.blocks import PREVIEW_CHARS, TABLE_PLACEHOLDER
from quire.operators import blocks as B
from quire.sources import fixtures as FX

QUERIES = {}
ORACLE = {}

SQL_BLOCKS = ("SELECT conv_id AS doc_id, turn AS block_idx, turn AS page_idx, role AS type, text, "
              "CAST(NULL AS VARCHAR) AS latex, CAST(NULL AS VARCHAR[]) AS img_caption, "
              "CAST(NULL AS VARCHAR) AS img_path, CAST(NULL AS VARCHAR[]) AS table_caption FROM conversations")


def _blocks(spark, sf_dir):
    return FX.conversation_blocks(spark, sf_dir)


# -- block_filter (PRJ-2) -------------------------------------------------------------
def q_block_filter(spark, sf_dir):
    b = B.filter_type(_blocks(spark, sf_dir), "assistant")
    return b.select("doc_id", "block_idx", "type", "page_idx")


QUERIES["block_filter"] = q_block_filter
ORACLE["block_filter"] = (f"SELECT doc_id, block_idx, type, page_idx FROM ({SQL_BLOCKS}) "
                          "WHERE type = 'assistant'")


# -- block_preview (PRJ-3, ARR-1) ---------------------------------------------------------
def q_block_preview(spark, sf_dir):
    b = B.with_preview(_blocks(spark, sf_dir))
    return b.select("doc_id", "block_idx", "type", "page_idx", "preview")


def _nz(x):
    return f"nullif({x}, '')"


def _join_sql(arr):
    return f"array_to_string(list_transform({arr}, lambda c: coalesce(c, '')), ' ')"


SQL_PREVIEW = (
    f"substr(CASE WHEN type = 'image' THEN coalesce({_nz(_join_sql('img_caption'))}, {_nz('img_path')}, '') "
    f"WHEN type = 'table' THEN coalesce({_nz(_join_sql('table_caption'))}, '{TABLE_PLACEHOLDER}') "
    f"WHEN type = 'equation' THEN coalesce({_nz('text')}, {_nz('latex')}, '') "
    f"ELSE coalesce({_nz('text')}, '') END, 1, {PREVIEW_CHARS})")

QUERIES["block_preview"] = q_block_preview
ORACLE["block_preview"] = f"SELECT doc_id, block_idx, type, page_idx, {SQL_PREVIEW} AS preview FROM ({SQL_BLOCKS})"


# -- page_range (PRJ-4) with per-document options -------------------------------------------
def _page_opts(doc):
    start = (doc % 3)
    end = F.when(doc % 4 == 0, F.lit(None)).otherwise(start + doc % 4)
    return start.cast("int"), end.cast("int")


def q_page_range(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    s, e = _page_opts(F.col("doc_id"))
    b = b.withColumn("start_page", s).withColumn("end_page", e)
    return B.select_pages(b).select("doc_id", "block_idx", "page_idx", "start_page", "end_page")


QUERIES["page_range"] = q_page_range
ORACLE["page_range"] = (
    "SELECT doc_id, block_idx, page_idx, start_page, end_page FROM ("
    "SELECT *, CAST(doc_id % 3 AS INTEGER) AS start_page, "
    "CAST(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 3 + doc_id % 4 END AS INTEGER) AS end_page "
    f"FROM ({SQL_BLOCKS})) WHERE page_idx >= coalesce(start_page, 0) AND (end_page IS NULL OR page_idx <= end_page)")


# -- stage_toggles (PRJ-5): roles stand for types; per-document switches ------------------------
def q_stage_toggles(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    # content lists of conversations have no equation/table blocks; map roles
    # onto them so both switches are exercised.
    t = F.when(F.col("type") == "system", "equation").when(F.col("type") == "user", "table").otherwise("text")
    b = b.withColumn("type", t).withColumn("formula", F.col("doc_id") % 2 == 0) \
         .withColumn("table", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("doc_id") % 3 == 1))
    return B.apply_stage_toggles(b).select("doc_id", "block_idx", "type")


QUERIES["stage_toggles"] = q_stage_toggles
ORACLE["stage_toggles"] = (
    "SELECT doc_id, block_idx, type FROM (SELECT doc_id, block_idx, "
    "CASE WHEN type = 'system' THEN 'equation' WHEN type = 'user' THEN 'table' ELSE 'text' END AS type, "
    "doc_id % 2 = 0 AS formula, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 3 = 1 END AS tbl "
    f"FROM ({SQL_BLOCKS})) WHERE NOT ((type = 'equation' AND NOT coalesce(formula, true)) "
    "OR (type = 'table' AND NOT coalesce(tbl, true)))")


# -- block_types (AGG-3) -------------------------------------------------------------------
def q_block_types(spark, sf_dir):
    return B.block_types(_blocks(spark, sf_dir))


QUERIES["block_types"] = q_block_types
ORACLE["block_types"] = (
    "SELECT doc_id, array_to_string(list_sort(list_distinct(list(type))), ',') AS types, "
    "count(*) AS n_blocks, 'all (' || count(*) || ')' AS label "
    f"FROM ({SQL_BLOCKS}) GROUP BY doc_id")


# -- doc_summary (SNK-5, AGG-1, AGG-2) ---------------------------------------------------------
def q_doc_summary(spark, sf_dir):
    return B.doc_summary(_blocks(spark, sf_dir))


QUERIES["doc_summary"] = q_doc_summary
ORACLE["doc_summary"] = (
    "SELECT doc_id, count(*) AS blocks, "
    "CAST(coalesce(sum(length(coalesce(text, ''))), 0) + (count(*) - 1) * 2 AS BIGINT) AS markdown_chars "
    f"FROM ({SQL_BLOCKS}) GROUP BY doc_id")


# -- block_json (SNK-6, JSN-2) -------------------------------------------------------------------
def q_block_json(spark, sf_dir):
    return B.block_json(_blocks(spark, sf_dir))


QUERIES["block_json"] = q_block_json
ORACLE["block_json"] = (
    "SELECT doc_id, block_idx, CAST(to_json({'type': type, 'page_idx': page_idx, 'text': text}) AS VARCHAR) AS json "
    f"FROM ({SQL_BLOCKS})")
