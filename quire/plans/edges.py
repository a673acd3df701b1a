"""Queries that reach the branches other fixtures leave out: null keys and orders, null and
numbered names, dense throttles, failing documents, whole content lists, listing orders."""
from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import paths as P
from quire.operators import admission, blocks, library
from quire.operators import extract as X
from quire.operators import lifecycle as LC
from quire.operators.naming import unique_names
from quire.operators.sequence import global_rank, previous_in_key, rank_within_key
from quire.operators.throttle import throttle
from quire.plans import jobs as J
from quire.plans import library as L
from quire.plans import naming as N
from quire.plans.blocks import SQL_PREVIEW
from quire.session import read_table
from quire.sources import fixtures as FX

QUERIES = {}
ORACLE = {}


# -- rank_nulls: clicks have no user, every seventh event has no order value ---------------------
def q_rank_nulls(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "click", F.col("user_id")).alias("k"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"))
    r = rank_within_key(e, ["k"], ["x", "event_id"], "rn", min_hot_rows=500)
    p = previous_in_key(e, ["k"], ["x", "event_id"], ["event_id"], min_hot_rows=500)
    return r.join(p.select("event_id", "prev_event_id"), "event_id")


QUERIES["rank_nulls"] = q_rank_nulls
ORACLE["rank_nulls"] = """
SELECT event_id, k, x, row_number() OVER w AS rn, lag(event_id) OVER w AS prev_event_id
FROM (SELECT event_id, CASE WHEN event_type <> 'click' THEN user_id END AS k, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events)
WINDOW w AS (PARTITION BY k ORDER BY x NULLS FIRST, event_id)"""


# -- path_order (SRT-3): paths in component order, one global rank over text ---------------------
def q_path_order(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return global_rank(p.withColumn("_key", P.component_key("path")), ["_key", "page_id"], "position", min_hot_rows=100).drop("_key")


QUERIES["path_order"] = q_path_order
ORACLE["path_order"] = """
SELECT page_id, path, row_number() OVER (ORDER BY string_split(path, '/'), page_id) AS position
FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"""


# -- unique_names_nulls, unique_names_numbered (WIN-1) --------------------------------------------
def _walk_sql(stem_sql: str, used_sql: str) -> str:
    """The rule row by row, per family, as a recursive query over ``documents``."""
    return f"""WITH RECURSIVE
src AS (SELECT doc_id, stem, used, fam, row_number() OVER (PARTITION BY fam ORDER BY doc_id) AS rn FROM (
  SELECT *, regexp_replace(lower(used), '( \\([0-9]+\\))+$', '') AS fam FROM (SELECT *, {used_sql} AS used FROM (
    SELECT doc_id, {stem_sql} AS stem FROM documents)))),
walk(fam, rn, doc_id, stem, name, taken) AS (
  SELECT fam, rn, doc_id, stem, used, [lower(used)] FROM src WHERE rn = 1
  UNION ALL
  SELECT s.fam, s.rn, s.doc_id, s.stem, c.name, list_append(w.taken, lower(c.name))
  FROM walk w JOIN src s ON s.fam = w.fam AND s.rn = w.rn + 1,
  LATERAL (SELECT CASE WHEN k = 1 THEN s.used ELSE s.used || ' (' || k || ')' END AS name FROM (
     SELECT list_filter(range(1, len(w.taken) + 2),
        lambda k: NOT list_contains(w.taken, lower(CASE WHEN k = 1 THEN s.used ELSE s.used || ' (' || k || ')' END)))[1] AS k)) c)
SELECT doc_id, stem, name FROM walk"""


def q_unique_names_nulls(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(
        F.col("doc_id") % 5 == 1, F.lit("")).when(F.col("doc_id") % 40 == 2, F.lit("Document (3)")).otherwise(F.col("source")).alias("stem"))
    return unique_names(d, "stem", ["doc_id"], "name", min_hot_rows=50)


QUERIES["unique_names_nulls"] = q_unique_names_nulls
ORACLE["unique_names_nulls"] = _walk_sql(
    "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 40 = 2 THEN 'Document (3)' ELSE source END",
    "coalesce(nullif(stem, ''), 'document')")


def q_unique_names_numbered(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("scan")).otherwise(
        F.format_string("scan (%d)", F.col("doc_id") * 7 % 400)).alias("stem"))
    return unique_names(d, "stem", ["doc_id"], "name", min_hot_rows=50)


QUERIES["unique_names_numbered"] = q_unique_names_numbered
ORACLE["unique_names_numbered"] = _walk_sql("CASE WHEN doc_id % 3 = 0 THEN 'scan' ELSE 'scan (' || (doc_id * 7 % 400) || ')' END", "stem")


# -- throttle_dense (WIN-3): an interval longer than a bucket, a null key ---------------------------
def q_throttle_dense(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("key"), "event_id", "ts")
    return throttle(e, "key", "ts", "event_id", 30 * 86400.0, min_hot_rows=200).filter("emitted").drop("emitted")


QUERIES["throttle_dense"] = q_throttle_dense
ORACLE["throttle_dense"] = ("SELECT nullif(key, '-') AS key, event_id, ts FROM ("
                            + J._throttle_sql("CASE WHEN event_type = 'view' THEN '-' ELSE event_type END", "INTERVAL 30 DAY") + ")")


# -- jobs_newest (SRT-2): all jobs, newest first, ties in the order of submission --------------------
def q_jobs_newest(spark, sf_dir):
    events = FX.job_events(spark, sf_dir)
    return LC.newest_jobs(J.states(spark, sf_dir), events).select("job_id", "status", "queued_at", "position")


QUERIES["jobs_newest"] = q_jobs_newest
ORACLE["jobs_newest"] = f"""WITH {J.SQL_JOB_STATES}
SELECT job_id, status, queued_at, row_number() OVER (ORDER BY queued_at DESC, sub.s.seq) AS position FROM states JOIN sub USING (job_id)"""


# -- admission_counts (AGG-5) ------------------------------------------------------------------------
def q_admission_counts(spark, sf_dir):
    return admission.admission_summary(admission.admission_split(FX.mixed_names(spark, sf_dir), "name"))


QUERIES["admission_counts"] = q_admission_counts
ORACLE["admission_counts"] = f"""
SELECT count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'skipped') AS skipped,
       count(*) FILTER (decision = 'accepted') = 0 AND count(*) FILTER (decision = 'skipped') > 0 AS rejected
FROM ({N.ORACLE['admission_split']})"""


# -- library_removed (SNK-2): the folders that each delete takes with it ------------------------------
def q_library_removed(spark, sf_dir):
    return library.removed_folders(library.delete_report(L.change_log(spark, sf_dir)))


QUERIES["library_removed"] = q_library_removed
ORACLE["library_removed"] = f"""
SELECT id, seq, existed, unnest(['uploads/' || id, 'output/' || id]) AS folder FROM ({L.ORACLE['library_delete']})"""


# -- content_list_blocks (SRC-6, WIN-2, JSN-2, ARR-1, PRJ-3): JSON lists with every kind of block -----
def content_lists(spark, sf_dir):
    """Per document a JSON list: a title, an image, a table, an equation, a block with an unknown field; null for
    one source, malformed for another."""
    d = read_table(spark, sf_dir, "documents")
    line = FX.first_line(F.col("text"))
    none = F.lit(None).cast("string")
    some = F.when(F.col("doc_id") % 2 == 0, F.array(F.col("source"), none, F.col("lang")))

    def block(kind, page, **fields):
        names = ["text", "latex", "img_caption", "img_path", "table_caption", "text_level", "bbox"]
        typed = {"img_caption": "array<string>", "table_caption": "array<string>", "text_level": "int", "bbox": "array<bigint>"}
        return F.struct(F.lit(kind).alias("type"), F.lit(page).alias("page_idx"),
                        *[fields.get(n, F.lit(None)).cast(typed.get(n, "string")).alias(n) for n in names])

    items = F.array(block("text", 0, text=line, text_level=F.lit(1)), block("image", 0, img_caption=some, img_path=F.concat(F.lit("images/"), F.col("source"))),
                    block("table", 1, table_caption=some), block("equation", 1, latex=F.col("lang"), text=F.when(F.col("doc_id") % 3 == 0, "")),
                    block("footer", 2, text=F.col("lang"), bbox=F.array("doc_id", "n_chars")))
    json = F.when(F.col("source") == "src3", none).when(F.col("source") == "src4", F.lit("[{")).otherwise(F.to_json(items))
    return d.select("doc_id", json.alias("content_list_json"))


def q_content_list_blocks(spark, sf_dir):
    b = blocks.with_preview(blocks.blocks_from_content_list(content_lists(spark, sf_dir)))
    return b.select("doc_id", "block_idx", "type", "page_idx", "text_level", "preview",
                    F.try_variant_get("raw", "$.bbox[1]", "long").alias("bbox_1"))


QUERIES["content_list_blocks"] = q_content_list_blocks
ORACLE["content_list_blocks"] = f"""WITH
d AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN [source, NULL, lang] END AS cap FROM documents WHERE source NOT IN ('src3', 'src4')),
b AS (
  SELECT doc_id, 0 AS block_idx, 'text' AS type, 0 AS page_idx, 1 AS text_level, regexp_extract(text, '^([^\\n]*)', 1) AS text, NULL::VARCHAR AS latex,
         NULL::VARCHAR[] AS img_caption, NULL::VARCHAR AS img_path, NULL::VARCHAR[] AS table_caption, NULL::BIGINT AS bbox_1 FROM d
  UNION ALL SELECT doc_id, 1, 'image', 0, NULL, NULL, NULL, cap, 'images/' || source, NULL, NULL FROM d
  UNION ALL SELECT doc_id, 2, 'table', 1, NULL, NULL, NULL, NULL, NULL, cap, NULL FROM d
  UNION ALL SELECT doc_id, 3, 'equation', 1, NULL, CASE WHEN doc_id % 3 = 0 THEN '' END, lang, NULL, NULL, NULL, NULL FROM d
  UNION ALL SELECT doc_id, 4, 'footer', 2, NULL, lang, NULL, NULL, NULL, NULL, n_chars FROM d)
SELECT doc_id, block_idx::INTEGER AS block_idx, type, page_idx::INTEGER AS page_idx, text_level::INTEGER AS text_level, {SQL_PREVIEW} AS preview, bbox_1 FROM b"""


# -- extract_isolation (UDF-2, UDF-3, PRJ-8): documents that fail, empty ones, results that do not fit, options per document ----
class PageRangeParser:
    """Takes the words from ``start_page`` on; fails for one language, returns nothing for another's short texts.

    The number before the language picks what is wrong with the result."""

    def open(self) -> None:
        pass

    def parse(self, content, options):
        kind, lang, text = content.split("\n", 2)
        if lang == "fr":
            raise ValueError(f"no parser for {lang}")
        if lang == "es":
            return None, []
        words = text.split(" ")[options.get("start_page", 0):]
        blocks = [{"type": "text", "text": w, "page_idx": 0} for w in words[:2]]
        blocks = {"1": None, "2": "blocks", "3": [{"text_level": "big"}], "4": [*blocks, {"page_idx": 1 << 40}], "5": [7]}.get(kind, blocks)
        return ("" if lang == "de" else 5 if kind == "6" else " ".join(words)), blocks


def q_extract_isolation(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws("\n", (F.col("doc_id") % 11).cast("string"), "lang", "text").alias("content"),
        F.struct(F.when(F.col("doc_id") % 4 > 0, (F.col("doc_id") % 4).cast("int")).alias("start_page")).alias("options"))
    out = X.extract(d, PageRangeParser(), "doc_id", "content", options_col="options")
    return X.documents_of(out).select("doc_id", "markdown_chars", "blocks", "error")


QUERIES["extract_isolation"] = q_extract_isolation
ORACLE["extract_isolation"] = f"""WITH
w AS (SELECT doc_id, lang, string_split(text, ' ')[(doc_id % 4) + 1:] AS words FROM documents),
e AS (SELECT *, CASE WHEN lang = 'fr' THEN 'ValueError: no parser for fr' WHEN lang = 'es' THEN '{X.NO_MARKDOWN_ERROR}'
    WHEN doc_id % 11 = 6 AND lang <> 'de' THEN 'TypeError: markdown is int, not str'
    WHEN doc_id % 11 = 2 THEN 'TypeError: blocks are str, not list' WHEN doc_id % 11 = 3 THEN 'TypeError: block 0: text_level does not fit int'
    WHEN doc_id % 11 = 4 THEN 'TypeError: block ' || least(len(words), 2) || ': page_idx does not fit int'
    WHEN doc_id % 11 = 5 THEN 'TypeError: block 0 is int, not dict' END AS error FROM w)
SELECT doc_id,
  CASE WHEN error IS NOT NULL THEN NULL WHEN lang = 'de' THEN 0 ELSE length(array_to_string(words, ' ')) END::BIGINT AS markdown_chars,
  CASE WHEN error IS NOT NULL THEN NULL WHEN doc_id % 11 = 1 THEN 0 ELSE least(len(words), 2) END::BIGINT AS blocks, error FROM e"""


# -- extract_routed (UDF-5): text, OCR and automatic documents, two parsers, one pass -----------------
class LinesParser:
    """The text layer as it is: a block a line."""

    def open(self) -> None:
        self.ready = True

    def parse(self, content, options):
        return content, [{"type": "text", "text": x, "page_idx": 0} for x in content.split("\n")] if self.ready else None


class OcrStub:
    """Stands for a recogniser: says how much it saw, as one block."""

    def open(self) -> None:
        self.prefix = "[ocr] "

    def parse(self, content, options):
        return f"{self.prefix}{len(content)}", [{"type": "image", "text": options.get("lang"), "page_idx": 0}]


def q_extract_routed(spark, sf_dir):
    i = F.col("doc_id")
    method = F.when(i % 5 == 0, "txt").when(i % 5 == 1, "ocr").when(i % 5 == 2, "auto")
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.struct("lang").alias("options"), method.alias("method"),
                                                      F.when(i % 7 > 0, i % 7 > 3).alias("has_text_layer"))
    route = F.when(i % 97 > 0, X.extraction_route()).otherwise(F.lit("formula"))
    out = X.extract_routed(d, {"text": LinesParser(), "ocr": OcrStub()}, route, "doc_id", "content", options_col="options")
    return X.documents_of(out).select("doc_id", "route", "markdown_chars", "blocks", "error")


QUERIES["extract_routed"] = q_extract_routed
ORACLE["extract_routed"] = """WITH
r AS (SELECT doc_id, text, CASE WHEN doc_id % 97 = 0 THEN 'formula' WHEN doc_id % 5 = 0 THEN 'text' WHEN doc_id % 5 = 1 THEN 'ocr'
    WHEN doc_id % 7 > 3 THEN 'text' ELSE 'ocr' END AS route FROM documents)
SELECT doc_id, route,
  CASE route WHEN 'text' THEN length(text) WHEN 'ocr' THEN 6 + length(CAST(length(text) AS VARCHAR)) END::BIGINT AS markdown_chars,
  CASE route WHEN 'text' THEN len(string_split(text, chr(10))) WHEN 'ocr' THEN 1 END::BIGINT AS blocks,
  CASE WHEN route = 'formula' THEN 'LookupError: no parser for route formula' END AS error FROM r"""
