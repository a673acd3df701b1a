"""Artifact discovery over file listings (SRC-1/2, SRC-8, SRC-11/12, SRT-3).

Folder trees are listed by tasks (``sources.listing``), so only
file metadata is read; the case-insensitive pattern keeps unsupported files out
of the scan altogether.
"""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.names import SUPPORTED_SUFFIXES, base_name
from quire.functions.paths import below, path_sort_key
from quire.sources.listing import few_tasks, list_files

ARTIFACT_SUFFIXES = {"markdown_path": ".md", "content_list_path": "_content_list.json",
                     "middle_json_path": "_middle.json"}


def suffix_glob(suffixes=SUPPORTED_SUFFIXES) -> str:
    """Case-insensitive glob such as ``*.{[pP][dD][fF],[pP][nN][gG]}``."""
    def ci(s):
        return "".join(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch for ch in s)
    return "*.{" + ",".join(ci(s.lstrip(".")) for s in suffixes) + "}"


class NoDocumentsError(ValueError):
    pass


def scan_documents(spark: SparkSession, paths: list[str], with_content: bool = False,
                   require: bool = False, ordered: bool = False) -> DataFrame:
    """Recursive document scan keeping supported suffixes (SRC-1, SRC-2).

    Returns path, name, length, modificationTime (+ content when asked).
    ``ordered`` sorts by path components, as a directory listing would; it is a
    global sort, so leave it off for bulk processing, where order does not
    matter.  Files named with a leading '.' or '_' are hidden by the source.
    With ``require`` an empty result raises ``NoDocumentsError`` (one
    ``limit(1)`` job).
    """
    named = r"(?i:.*\.(" + "|".join(re.escape(s.lstrip(".")) for s in SUPPORTED_SUFFIXES) + "))"
    df = reduce(DataFrame.unionByName, [list_files(spark, p, named, suffix_glob(), with_content) for p in paths])
    cols = ["path", "modificationTime", "length"] + (["content"] if with_content else [])
    out = df.select(*cols).withColumn("name", base_name(F.col("path")))
    if ordered:
        out = out.orderBy(path_sort_key("path"))
    if require and out.limit(1).count() == 0:
        raise NoDocumentsError("the given paths hold no file of a supported kind")
    return out


def scan_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Explicit file arguments: read as given, no suffix check (SRC-2).
    A missing path raises the source's path-not-found error."""
    return few_tasks(spark.read.format("binaryFile").load(paths).select("path", "modificationTime", "length")) \
        .withColumn("name", base_name(F.col("path")))


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``root`` with paths relative to it, in component order (SRC-12)."""
    df = list_files(spark, root)
    return df.select(below("path", root).alias("rel_path"), "length").orderBy(path_sort_key("rel_path"))


def locate_outputs(listing: DataFrame, doc_col: str = "doc_id", dir_col: str = "parse_dir",
                   name_col: str = "file_name", stem_col: str = "stem") -> DataFrame:
    """Per document, pick each artifact: ``<stem><suffix>`` if present, else
    the smallest name ending in the suffix, else null (SRC-8).  One partial
    aggregate with ``min_by`` over (not exact, name)."""
    aggs = []
    for out, sfx in ARTIFACT_SUFFIXES.items():
        hit = F.col(name_col).endswith(sfx) & ~F.col(name_col).contains("/")  # the top level only
        exact = F.col(name_col) == F.concat(F.col(stem_col), F.lit(sfx))
        rank = F.struct((~exact).alias("e"), F.col(name_col).alias("n"))
        aggs.append(F.min_by(F.when(hit, F.concat(F.col(dir_col), F.lit("/"), F.col(name_col))),
                             F.when(hit, rank)).alias(out))
    aggs.append(F.max(F.when(F.col(name_col).startswith("images/"), F.concat(F.col(dir_col), F.lit("/images"))))
                .alias("images_dir"))
    return listing.groupBy(doc_col, dir_col, stem_col).agg(*aggs)
