"""Flat export of selected documents (SNK-3/4, JON-1/2, PRJ-9, WIN-1, STRG-4, SET-1, AGG-4).

``export_files(selection, library, markdown, images, mode)`` returns one row
per file to write: ``<name>.md`` for every eligible selected document and, in
``md+images`` mode, ``<name>_images/<image>`` for each of its images.

* selection (ord, id): request order; unknown ids drop out of the inner join,
  repeated ids stay and each gets its own name;
* eligibility (has a Markdown path and the Markdown exists: a row of ``markdown`` whose
  ``found``, where that column is given, is true) is applied *before* naming, so skipped documents
  never claim a name.  Empty paths, names and folders count as missing;
* names: safe stem of the original name (else the stored stem), made unique
  case-insensitively in request order;
* links are rewritten only for documents that have at least one image.

Everything is joins, one aggregate and the naming operator; no document is
read on the driver.  The Markdown and image payloads join in last, so the
naming shuffle only moves ids and stems.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.names import sanitize_stem
from quire.functions.text import rewrite_image_links
from quire.operators.naming import unique_names
from quire.session import materialize

MODES = ("md-only", "md+images")


def export_files(selection: DataFrame, library: DataFrame, markdown: DataFrame,
                 images: DataFrame | None = None, mode: str = "md-only") -> DataFrame:
    """selection(ord, id), library(id, original_name, stem, markdown_path, images_dir),
    markdown(id, markdown), images(id, image_name, content) ->
    (ord, id, file_name, kind, content binary)."""
    if mode not in MODES:
        raise ValueError(f"export mode must be one of {', '.join(MODES)}, not {mode!r}")
    lib = library.select("id", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("original_name", "stem", "markdown_path", "images_dir")])
    picked = selection.select("ord", "id").join(lib, "id", "inner")
    if "found" in markdown.columns:
        markdown = markdown.filter("found")
    has_md = markdown.select("id").distinct()
    eligible = picked.filter(F.col("markdown_path").isNotNull()).join(has_md, "id", "left_semi")
    eligible = eligible.select("ord", "id", "images_dir",
                               sanitize_stem(F.coalesce(F.col("original_name"), F.col("stem"))).alias("_stem"))
    # Naming reads its input several times (family check, ranks); the narrow
    # (ord, id, stem) table is written once so the joins above are not redone.
    named = materialize(unique_names(materialize(eligible), "_stem", ["ord"], "name"))

    docs = named.join(markdown.select("id", "markdown"), "id", "inner")
    if mode == "md+images" and images is not None:
        per_doc = images.groupBy("id").agg(F.count(F.lit(1)).alias("_n_images"))
        docs = docs.join(per_doc, "id", "left")
        with_imgs = F.col("images_dir").isNotNull() & (F.coalesce(F.col("_n_images"), F.lit(0)) > 0)
        img_dir = F.concat(F.col("name"), F.lit("_images"))
        docs = docs.withColumn("markdown", F.when(with_imgs, rewrite_image_links("markdown", img_dir))
                               .otherwise(F.col("markdown"))).withColumn("_imgs", with_imgs)
        img_rows = (named.filter(F.col("images_dir").isNotNull()).select("ord", "id", "name")
                    .join(images.select("id", "image_name", "content"), "id", "inner")
                    .select("ord", "id",
                            F.concat(F.col("name"), F.lit("_images/"), F.col("image_name")).alias("file_name"),
                            F.lit("image").alias("kind"), F.col("content").cast("binary").alias("content")))
    else:
        img_rows = None
    md_rows = docs.select("ord", "id", F.concat(F.col("name"), F.lit(".md")).alias("file_name"),
                          F.lit("markdown").alias("kind"), F.encode("markdown", "UTF-8").alias("content"))
    return md_rows.unionByName(img_rows) if img_rows is not None else md_rows


def export_count(files: DataFrame) -> DataFrame:
    """Number of exported documents and files; ``empty`` flags the error case."""
    return files.agg(F.count_if(F.col("kind") == "markdown").cast("bigint").alias("documents"),
                     F.count(F.lit(1)).cast("bigint").alias("files")).withColumn(
        "empty", F.col("documents") == 0)


class EmptyExportError(ValueError):
    pass


def export_to(selection: DataFrame, library: DataFrame, markdown: DataFrame, path: str,
              images: DataFrame | None = None, mode: str = "md-only") -> int:
    """Build the export and write it as files under ``path``; returns the number
    of documents.  Nothing selected with Markdown is an error (AGG-4)."""
    from quire.sources.files_sink import write_files

    files = materialize(export_files(selection, library, markdown, images, mode), "export")
    n = files.filter(F.col("kind") == "markdown").count()
    if n == 0:
        raise EmptyExportError("no selected document has Markdown to export")
    write_files(files, path)
    return n
