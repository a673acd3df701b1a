"""Queries over files: each writes the files it reads, one or more per row of its table, with the
one-file-per-row sink into the shared scratch folder, and reads them back through the storage readers."""
from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.paths import below
from quire.operators import artifacts, blocks, export
from quire.plans import edges as E
from quire.plans import export as PX
from quire.plans import extraction as X
from quire.plans import sqlfrag as Q
from quire.plans.blocks import SQL_PREVIEW
from quire.session import read_table, scratch_path
from quire.sources import artifacts_io as IO
from quire.sources import fixtures as FX
from quire.sources.files_sink import write_files

QUERIES = {}
ORACLE = {}

_SQL_SFX = f"([{', '.join(Q.lit(s) for s in FX.FIXTURE_SUFFIXES)}])[(doc_id % {len(FX.FIXTURE_SUFFIXES)}) + 1]"


def _written(files, spark, name):
    root = scratch_path(spark, name)
    write_files(files, root)
    return root


# -- the user's folder: <source>/<id><suffix>, the text as content -------------------------------
def input_files(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), FX.suffix_for("doc_id"))
    return d.select(name.alias("file_name"), F.encode("text", "UTF-8").alias("content"))


_SQL_INPUT = f"SELECT source || '/' || doc_id || {_SQL_SFX} AS rel_path, text FROM documents"


# -- scan_documents (SRC-1): only supported suffixes, whatever their case, in all folders --------
def q_scan_documents(spark, sf_dir):
    root = _written(input_files(spark, sf_dir), spark, "inputs")
    return artifacts.scan_documents(spark, [root]).select(below("path", root).alias("rel_path"), "name", "length")


QUERIES["scan_documents"] = q_scan_documents
ORACLE["scan_documents"] = f"""SELECT rel_path, string_split(rel_path, '/')[-1] AS name, CAST(strlen(text) AS BIGINT) AS length
FROM ({_SQL_INPUT}) WHERE {Q.is_supported('rel_path')}"""


# -- scan_explicit (SRC-2): files named by the caller are taken without a look at their suffix ----
def q_scan_explicit(spark, sf_dir):
    root = _written(input_files(spark, sf_dir), spark, "inputs")
    return artifacts.scan_files(spark, [f"{root}/*/*.txt", f"{root}/*/*.tar.gz"]).select(
        below("path", root).alias("rel_path"), "name", "length")


QUERIES["scan_explicit"] = q_scan_explicit
ORACLE["scan_explicit"] = f"""SELECT rel_path, string_split(rel_path, '/')[-1] AS name, CAST(strlen(text) AS BIGINT) AS length
FROM ({_SQL_INPUT}) WHERE suffix(rel_path, '.txt') OR suffix(rel_path, '.tar.gz')"""


# -- the output root: Markdown (not for src7), content lists (some missing, some malformed), images
# of French documents, and a folder inside each images folder ------------------------------------
def output_files(spark, sf_dir):
    _, _, md, img = PX.export_inputs(spark, sf_dir)
    folder = F.concat(F.lit("output/"), F.col("id").cast("string"))

    def files(df, name, content):
        return df.select(F.concat(folder, F.lit("/"), name).alias("file_name"), F.encode(content, "UTF-8").alias("content"))

    lists = E.content_lists(spark, sf_dir).filter(F.col("content_list_json").isNotNull()).withColumnRenamed("doc_id", "id")
    return (files(md, F.lit("doc.md"), "markdown")
            .unionByName(files(lists, F.lit("doc_content_list.json"), "content_list_json"))
            .unionByName(img.select(F.concat(folder, F.lit("/images/"), "image_name").alias("file_name"), "content"))
            .unionByName(img.select(F.concat(folder, F.lit("/images/thumbs/"), "image_name").alias("file_name"), "content")))


_SQL_IMAGES = ("SELECT doc_id AS id, doc_id || '.jpg' AS image_name, lang AS content FROM documents WHERE lang = 'fr' "
               "UNION ALL SELECT doc_id, doc_id || '.png', source FROM documents WHERE lang = 'fr'")


# -- read_markdown (SRC-7): whole files; '' and found = false where there is none -----------------
def q_read_markdown(spark, sf_dir):
    root = _written(output_files(spark, sf_dir), spark, "outputs")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.format_string("output/%d/doc.md", F.col("doc_id")).alias("markdown_path"))
    return IO.read_markdown(spark, root, docs, id_col="doc_id").select(
        "doc_id", "found", F.length("markdown").cast("bigint").alias("n_chars"), F.sha2("markdown", 256).alias("sha256"))


QUERIES["read_markdown"] = q_read_markdown
ORACLE["read_markdown"] = f"""SELECT doc_id, found, CAST(length(md) AS BIGINT) AS n_chars, sha256(md) AS sha256 FROM (
  SELECT doc_id, source <> 'src7' AS found, CASE WHEN source <> 'src7' THEN {PX.SQL_MARKDOWN} ELSE '' END AS md FROM documents)"""


# -- read_content_lists (SRC-6): one JSON list a file, malformed ones without blocks --------------
def q_read_content_lists(spark, sf_dir):
    root = _written(output_files(spark, sf_dir), spark, "outputs")
    return blocks.with_preview(IO.read_content_lists(spark, root)).select(
        F.col("doc_id").alias("file"), "block_idx", "type", "page_idx", "text_level", "preview")


QUERIES["read_content_lists"] = q_read_content_lists
ORACLE["read_content_lists"] = f"""SELECT 'output/' || doc_id || '/doc_content_list.json' AS file, block_idx, type, page_idx, text_level, preview
FROM ({E.ORACLE['content_list_blocks']})"""


# -- image_inventory (SRC-11): the files of each images folder, not those of folders inside it ----
def q_image_inventory(spark, sf_dir):
    root = _written(output_files(spark, sf_dir), spark, "outputs")
    return IO.image_inventory(spark, root)


QUERIES["image_inventory"] = q_image_inventory
ORACLE["image_inventory"] = f"""SELECT 'output/' || id || '/images' AS images_dir, image_name, CAST(strlen(content) AS BIGINT) AS length
FROM ({_SQL_IMAGES})"""


# -- artifact_tree (SRC-12): every file of every document, relative to its output folder; the size of
# a content list is left out, since its JSON text is the writer's own ------------------------------
def q_artifact_tree(spark, sf_dir):
    root = _written(output_files(spark, sf_dir), spark, "outputs")
    t = artifacts.list_tree(spark, root)
    return t.select(F.split_part("rel_path", F.lit("/"), F.lit(2)).cast("bigint").alias("doc_id"),
                    F.regexp_replace("rel_path", r"^output/[^/]*/", "").alias("file"),
                    F.when(~F.col("rel_path").endswith(".json"), F.col("length")).alias("length"))


QUERIES["artifact_tree"] = q_artifact_tree
ORACLE["artifact_tree"] = f"""WITH im AS ({_SQL_IMAGES})
SELECT doc_id, 'doc.md' AS file, CAST(strlen({PX.SQL_MARKDOWN}) AS BIGINT) AS length FROM documents WHERE source <> 'src7'
UNION ALL SELECT doc_id, 'doc_content_list.json', NULL FROM documents WHERE source <> 'src3'
UNION ALL SELECT id, 'images/' || image_name, CAST(strlen(content) AS BIGINT) FROM im
UNION ALL SELECT id, 'images/thumbs/' || image_name, CAST(strlen(content) AS BIGINT) FROM im"""


# -- export_md_only (SNK-3, AGG-4): the export written as files and listed again -------------------
def q_export_md_only(spark, sf_dir):
    sel, lib, md, _ = PX.export_inputs(spark, sf_dir)
    root = scratch_path(spark, "export")
    export.export_to(sel, lib, md, root, mode="md-only")
    return IO.files_below(spark, root).select(F.col("_rel").alias("file_name"), F.col("length").alias("n_bytes"),
                                              F.sha2("_text", 256).alias("sha256"))


QUERIES["export_md_only"] = q_export_md_only
ORACLE["export_md_only"] = Q.with_ctes(
    PX.SQL_EXPORT_NAMES,
    "SELECT name || '.md' AS file_name, CAST(strlen(markdown) AS BIGINT) AS n_bytes, sha256(markdown) AS sha256 FROM nm JOIN md USING (id)")


# -- single_document (LIM-2): one document of the batch result, by the newest id --------------------
def q_single_document(spark, sf_dir):
    newest = read_table(spark, sf_dir, "documents", balance=False).agg(F.max("doc_id")).first()[0]
    return IO.get_doc(X.q_extract_text_documents(spark, sf_dir), newest, id_col="doc_id")


QUERIES["single_document"] = q_single_document
ORACLE["single_document"] = f"""SELECT * FROM ({X.ORACLE['extract_text_documents']}) WHERE doc_id = (SELECT max(doc_id) FROM documents)"""
