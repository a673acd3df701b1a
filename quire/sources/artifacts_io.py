"""Readers for parser outputs on storage (SRC-6, SRC-7, SRC-11, LIM-2).

Whole files are read by tasks (``listing``: raw paths and exact bytes) from the output root, recursively,
with a glob so other files are never read, and joined to the library by
path.  No file list passes through the driver.

* Markdown: the file as UTF-8; a missing file is '' with ``found`` false, so that an export can leave it out.
* Content list: one JSON array per file, parsed with the block schema;
  unknown fields survive in a VARIANT ``raw`` column; missing -> no blocks.
* Images: names and sizes only (``content`` pruned) until an export needs bytes.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.names import base_name
from quire.functions.paths import below
from quire.operators.blocks import blocks_from_content_list
from quire.sources.listing import add_content, list_files


def _named(glob: str) -> tuple[str, str]:
    """The names' pattern, and the glob (of ``*`` alone) it says."""
    return re.sub(r"\\\*", ".*", re.escape(glob)), glob


def _text(content: str) -> F.Column:
    return F.make_valid_utf8(F.col(content).cast("string"))


def files_below(spark: SparkSession, root: str, glob: str = "*", with_content: bool = True) -> DataFrame:
    """(_rel, length, _text) of the files below ``root`` whose name matches ``glob`` (of ``*`` alone); ``_text`` only with content."""
    df = list_files(spark, root, *_named(glob), with_content)
    return df.select(below("path", root).alias("_rel"), "length", *([_text("content").alias("_text")] if with_content else []))


def read_markdown(spark: SparkSession, root: str, docs: DataFrame, path_col: str = "markdown_path",
                  id_col: str = "id") -> DataFrame:
    """docs(id, markdown_path relative to root) -> (id, markdown, found); '' and false when missing (SRC-7).

    Documents meet the names of the files, in tasks whatever the names' number; the texts are read after that."""
    listed = list_files(spark, root, *_named("*.md")).select("path", below("path", root).alias("_rel")).hint("merge")
    asked = docs.select(F.col(id_col).alias("_id"), F.col(path_col).alias("_asked"))
    files = add_content(asked.join(listed, F.col("_asked") == F.col("_rel"), "left").select("_id", "path"), root, "*.md")
    return files.select(F.col("_id").alias(id_col), F.coalesce(_text("content"), F.lit("")).alias("markdown"),
                        F.col("path").isNotNull().alias("found"))


def read_content_lists(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*_content_list.json`` under root -> blocks table keyed by the
    file's path relative to root (SRC-6)."""
    files = files_below(spark, root, "*_content_list.json")
    return blocks_from_content_list(files.select(F.col("_rel").alias("doc_id"),
                                                 F.col("_text").alias("content_list_json")))


def image_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(images_dir, image_name, length) of every file inside an ``images``
    folder under root, in name order; bytes are not read (SRC-11)."""
    df = files_below(spark, root, "*", with_content=False).filter(F.col("_rel").rlike(r"(^|/)images/[^/]+$"))
    return (df.select(F.regexp_extract("_rel", r"^(.*)/[^/]*$", 1).alias("images_dir"),
                      base_name(F.col("_rel")).alias("image_name"), "length")
            .orderBy("images_dir", "image_name"))


def get_doc(library: DataFrame, doc_id, id_col: str = "id") -> DataFrame:
    """One library entry by id (LIM-2): a filter, pushed down to the scan."""
    return library.filter(F.col(id_col) == F.lit(doc_id))
