"""Admission of incoming files (SRC-4/5, JON-4, AGG-5, AGG-7)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import names as N
from quire.functions.options import OPTIONS_STRUCT, with_sanitized_options
from quire.functions.paths import below, stable_id


def admission_split(files: DataFrame, name_col: str = "name") -> DataFrame:
    """Tag every file ``accepted`` or ``skipped`` by its suffix in one pass.

    Nothing is dropped: callers take the two sides with a filter on
    ``decision``, so accepted + skipped always equals the input.
    """
    ok = N.is_supported(name_col)
    return files.withColumn("decision", F.when(ok, "accepted").otherwise("skipped"))


def admission_summary(tagged: DataFrame) -> DataFrame:
    """One row: accepted and skipped counts, and whether the request fails
    (nothing accepted while something was skipped)."""
    acc = F.count_if(F.col("decision") == "accepted").cast("bigint")
    skp = F.count_if(F.col("decision") == "skipped").cast("bigint")
    return tagged.agg(acc.alias("accepted"), skp.alias("skipped")).withColumn(
        "rejected", (F.col("accepted") == 0) & (F.col("skipped") > 0))


def staged_dedup(files: DataFrame, name_col: str = "name", size_col: str = "size",
                 arrival_col: str = "arrival") -> DataFrame:
    """Browser staging: keep supported files, first arrival per (name, size).

    A partial/final aggregate (``min_by``) instead of a window: a hot
    (name, size) pair is combined map-side, never gathered into one task.
    """
    ok = files.filter(N.is_supported_client(name_col))
    other = [c for c in files.columns if c not in (name_col, size_col, arrival_col)]
    aggs = [F.min(arrival_col).alias(arrival_col)]
    aggs += [F.min_by(c, arrival_col).alias(c) for c in other]
    return ok.groupBy(name_col, size_col).agg(*aggs)


def submit_uploads(files: DataFrame, root: str, options: str | None) -> DataFrame:
    """Uploaded files (``path, length``) -> ``path`` (below ``root``), ``length``, ``decision``, ``kind``, ``doc_id``, ``options``, ``error``.

    Every file gets a row: a skipped one says so, an accepted one whose request has bad options carries the error,
    every other one is a ``submit`` event with the checked options and an id made of its whole path and length,
    so two uploads of one name and size stay two documents.  Works on streams."""
    d = admission_split(files.select(below("path", root).alias("path"), "length").withColumn("_name", N.base_name(F.col("path"))), "_name")
    d = with_sanitized_options(d.withColumn("_raw", F.lit(options).cast("string")), "_raw", "_opts")
    taken = F.col("decision") == "accepted"
    good = taken & F.col("_opts.error").isNull()
    return d.select("path", "length", "decision", F.when(good, "submit").alias("kind"), F.when(good, stable_id("path", "length")).alias("doc_id"),
                    F.when(good, F.col("_opts.options")).cast(OPTIONS_STRUCT).alias("options"), F.when(taken, F.col("_opts.error")).alias("error"))
