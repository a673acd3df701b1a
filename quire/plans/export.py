"""Export queries: collision-safe names, link rewriting, flat export."""
from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import names as N
from quire.functions.text import IMG_HTML_PATTERN, IMG_MD_PATTERN, rewrite_image_links
from quire.operators.export import export_count, export_files
from quire.operators.naming import FAMILY_SUFFIX, unique_names
from quire.plans import sqlfrag as Q
from quire.session import read_table
from quire.sources import fixtures as FX

QUERIES = {}
ORACLE = {}


def _sql_first_line(x):
    return f"regexp_extract({x}, '^([^\\n]*)', 1)"


# -- unique_names_window (WIN-1 fast path): colliding names from page URLs ----------------
def q_unique_names_window(spark, sf_dir):
    p = FX.page_names(spark, sf_dir).select("page_id", N.sanitize_stem("name").alias("stem"))
    return unique_names(p, "stem", ["page_id"], "name").select("page_id", "stem", "name")


QUERIES["unique_names_window"] = q_unique_names_window
ORACLE["unique_names_window"] = Q.with_ctes(
    ["p AS (SELECT page_id, regexp_extract(url, '^[^?#]*/([^/?#]*)', 1) AS nm FROM pages)"]
    + Q.sanitize_ctes("p", "nm", "stem"),
    "SELECT page_id, stem, CASE WHEN k = 1 THEN stem ELSE stem || ' (' || k || ')' END AS name FROM ("
    "SELECT page_id, stem, row_number() OVER (PARTITION BY lower(stem) ORDER BY page_id) AS k FROM ss5)")


# -- unique_names_mixed (WIN-1 sequential path): families mixing 's' and 's (2)' ------------
def q_unique_names_mixed(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    stems = d.select("doc_id", F.concat("source", F.when(F.col("doc_id") % 7 == 0, F.lit(" (2)"))
                                        .otherwise(F.lit(""))).alias("stem"))
    return unique_names(stems, "stem", ["doc_id"], "name").select("doc_id", "stem", "name")


QUERIES["unique_names_mixed"] = q_unique_names_mixed
# Sequential oracle: a recursive walk per family carrying the taken set.
ORACLE["unique_names_mixed"] = f"""WITH RECURSIVE
src AS (SELECT doc_id, stem, fam, row_number() OVER (PARTITION BY fam ORDER BY doc_id) AS rn FROM (
  SELECT doc_id, stem, regexp_replace(lower(stem), {Q.lit(FAMILY_SUFFIX)}, '') AS fam FROM (
    SELECT doc_id, source || CASE WHEN doc_id % 7 = 0 THEN ' (2)' ELSE '' END AS stem FROM documents))),
walk(fam, rn, doc_id, stem, name, taken) AS (
  SELECT fam, rn, doc_id, stem, stem, [lower(stem)] FROM src WHERE rn = 1
  UNION ALL
  SELECT s.fam, s.rn, s.doc_id, s.stem, c.name, list_append(w.taken, lower(c.name))
  FROM walk w JOIN src s ON s.fam = w.fam AND s.rn = w.rn + 1,
  LATERAL (SELECT CASE WHEN k = 1 THEN s.stem ELSE s.stem || ' (' || k || ')' END AS name FROM (
     SELECT list_filter(range(1, len(w.taken) + 2),
        lambda k: NOT list_contains(w.taken, lower(CASE WHEN k = 1 THEN s.stem ELSE s.stem || ' (' || k || ')' END)))[1] AS k)) c
)
SELECT doc_id, stem, name FROM walk"""


# -- rewrite_links (STRG-4) ------------------------------------------------------------------
def _markdown_with_images(text, doc_id):
    return F.concat(F.lit("![fig](images/"), doc_id.cast("string"), F.lit(".jpg)\n"), text,
                    F.lit("\n<img alt=\"x\" src='images/"), doc_id.cast("string"), F.lit(".png'>"))


SQL_MARKDOWN = ("'![fig](images/' || doc_id || '.jpg)' || chr(10) || text || chr(10) || "
                "'<img alt=\"x\" src=''images/' || doc_id || '.png''>'")


def q_rewrite_links(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    dirs = F.concat(N.sanitize_stem(F.concat(FX.first_line(F.col("text")), F.lit(".pdf"))), F.lit("_images"))
    return d.select("doc_id", dirs.alias("images_dir"),
                    rewrite_image_links(_markdown_with_images(F.col("text"), F.col("doc_id")), dirs).alias("markdown"))


def _sql_rewrite(md, d):
    rep = f"'\\1' || replace({d}, '\\', '\\\\') || '/'"
    return (f"regexp_replace(regexp_replace({md}, {Q.lit(IMG_MD_PATTERN)}, {rep}, 'g'), "
            f"{Q.lit(IMG_HTML_PATTERN)}, {rep}, 'g')")


QUERIES["rewrite_links"] = q_rewrite_links
ORACLE["rewrite_links"] = Q.with_ctes(
    [f"n AS (SELECT doc_id, text, {_sql_first_line('text')} || '.pdf' AS nm FROM documents)"]
    + Q.sanitize_ctes("n", "nm", "stem"),
    f"SELECT doc_id, stem || '_images' AS images_dir, {_sql_rewrite(SQL_MARKDOWN, "stem || '_images'")} AS markdown FROM ss5")


# -- flat_export (SNK-3/4, JON-1/2, PRJ-9, WIN-1, SET-1) -----------------------------------------
# Fixture library: every document is in the library; source 'src3' has no
# Markdown path, source 'src7' has a path but no file; French documents have
# two images.  The selection asks for every document newest id first, asks
# twice for sources src1/src2, and asks for ids that are not in the library
# (page ids shifted past all document ids).
UNKNOWN_ID_SHIFT = 10 ** 12


def export_inputs(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    p = read_table(spark, sf_dir, "pages")
    library = d.select(
        F.col("doc_id").alias("id"),
        F.concat(FX.first_line(F.col("text")), F.lit(".pdf")).alias("original_name"),
        F.lit(None).cast("string").alias("stem"),
        F.when(F.col("source") == "src3", F.lit(None)).otherwise(
            F.concat(F.lit("output/"), F.col("doc_id").cast("string"), F.lit("/doc.md"))).alias("markdown_path"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("output/"), F.col("doc_id").cast("string"), F.lit("/images")))
         .alias("images_dir"))
    markdown = d.filter(F.col("source") != "src7").select(
        F.col("doc_id").alias("id"), _markdown_with_images(F.col("text"), F.col("doc_id")).alias("markdown"))
    images = d.filter(F.col("lang") == "fr").select(
        F.col("doc_id").alias("id"),
        F.explode(F.array(
            F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image_name"),
                     F.encode("lang", "UTF-8").alias("content")),
            F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("image_name"),
                     F.encode("source", "UTF-8").alias("content")))).alias("im")
    ).select("id", "im.image_name", "im.content")
    selection = (d.select((-F.col("doc_id")).alias("ord"), F.col("doc_id").alias("id"))
                 .unionByName(d.filter(F.col("source").isin("src1", "src2"))
                              .select((F.lit(10 ** 9) + F.col("doc_id")).alias("ord"), F.col("doc_id").alias("id")))
                 .unionByName(p.select((F.lit(2 * 10 ** 9) + F.col("page_id")).alias("ord"),
                                       (F.lit(UNKNOWN_ID_SHIFT) + F.col("page_id")).alias("id"))))
    return selection, library, markdown, images


def q_flat_export(spark, sf_dir):
    sel, lib, md, img = export_inputs(spark, sf_dir)
    files = export_files(sel, lib, md, img, "md+images")
    return files.select("ord", "id", "file_name", "kind",
                        F.octet_length("content").cast("bigint").alias("n_bytes"),
                        F.sha2("content", 256).alias("sha256"))


def q_export_count(spark, sf_dir):
    sel, lib, md, img = export_inputs(spark, sf_dir)
    return export_count(export_files(sel, lib, md, img, "md+images"))


SQL_EXPORT_NAMES = [
    f"lib AS (SELECT doc_id AS id, {_sql_first_line('text')} || '.pdf' AS original_name, "
    "CASE WHEN source = 'src3' THEN NULL ELSE 'output/' || doc_id || '/doc.md' END AS markdown_path, "
    "CASE WHEN lang = 'fr' THEN 'output/' || doc_id || '/images' END AS images_dir FROM documents)",
    f"md AS (SELECT doc_id AS id, {SQL_MARKDOWN} AS markdown FROM documents WHERE source <> 'src7')",
    "img AS (SELECT doc_id AS id, doc_id || '.jpg' AS image_name, lang AS content FROM documents WHERE lang = 'fr' "
    "UNION ALL SELECT doc_id, doc_id || '.png', source FROM documents WHERE lang = 'fr')",
    "sel AS (SELECT -doc_id AS ord, doc_id AS id FROM documents "
    "UNION ALL SELECT 1000000000 + doc_id, doc_id FROM documents WHERE source IN ('src1', 'src2') "
    f"UNION ALL SELECT 2000000000 + page_id, {UNKNOWN_ID_SHIFT} + page_id FROM pages)",
    "el AS (SELECT sel.ord, sel.id, lib.original_name, lib.images_dir FROM sel JOIN lib USING (id) "
    "WHERE lib.markdown_path IS NOT NULL AND id IN (SELECT id FROM md))",
] + Q.sanitize_ctes("el", "original_name", "_stem") + [
    "nm AS (SELECT *, CASE WHEN k = 1 THEN _stem ELSE _stem || ' (' || k || ')' END AS name FROM ("
    "SELECT *, row_number() OVER (PARTITION BY lower(_stem) ORDER BY ord) AS k FROM ss5))"]
_SQL_EXPORT_BASE = SQL_EXPORT_NAMES + [
    "hi AS (SELECT id, count(*) AS n FROM img GROUP BY id)",
    "docs AS (SELECT nm.ord, nm.id, nm.name, nm.images_dir IS NOT NULL AND coalesce(hi.n, 0) > 0 AS has_img, "
    "md.markdown FROM nm JOIN md USING (id) LEFT JOIN hi USING (id))",
    "files AS (SELECT ord, id, name || '.md' AS file_name, 'markdown' AS kind, "
    f"CASE WHEN has_img THEN {_sql_rewrite('markdown', "name || '_images'")} ELSE markdown END AS content FROM docs "
    "UNION ALL SELECT docs.ord, docs.id, docs.name || '_images/' || img.image_name, 'image', img.content "
    "FROM docs JOIN img USING (id) WHERE docs.has_img)",
]

QUERIES["flat_export"] = q_flat_export
ORACLE["flat_export"] = Q.with_ctes(
    _SQL_EXPORT_BASE,
    "SELECT ord, id, file_name, kind, CAST(strlen(content) AS BIGINT) AS n_bytes, sha256(content) AS sha256 FROM files")
QUERIES["export_count"] = q_export_count
ORACLE["export_count"] = Q.with_ctes(
    _SQL_EXPORT_BASE,
    "SELECT CAST(count(*) FILTER (WHERE kind = 'markdown') AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS files, "
    "count(*) FILTER (WHERE kind = 'markdown') = 0 AS empty FROM files")
