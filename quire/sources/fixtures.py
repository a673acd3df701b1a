"""Derivations of the reference's inputs from the driver tables (FIXTURES.md §2).

Every derivation is a projection over the whole table, so its work grows with
the data; none samples, caps or filters rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import read_table

# Fixture suffixes cycled by doc_id: supported, unsupported, upper case, none.
FIXTURE_SUFFIXES = [".pdf", ".PDF", ".docx", ".png", ".txt", "", ".JPEG", ".tar.gz", ".xlsx", ".",
                    ".tiff", ".md", ".pptx", ".jp2", ".webp", ".gif", ".bmp", ".jpg", ".Pdf", ".zip"]


def first_line(text) -> F.Column:
    return F.regexp_extract(text, r"^([^\n]*)", 1)


def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, original_name): first line of the text + '.pdf'."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(first_line(F.col("text")), F.lit(".pdf")).alias("original_name"))


def suffix_for(doc_id) -> F.Column:
    arr = F.array(*[F.lit(s) for s in FIXTURE_SUFFIXES])
    return F.element_at(arr, (F.col(doc_id) % len(FIXTURE_SUFFIXES) + 1).cast("int"))


def mixed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, name): first line + a cycled suffix; every 23rd name is the bare suffix."""
    d = read_table(spark, sf_dir, "documents")
    sfx = suffix_for("doc_id")
    name = F.when(F.col("doc_id") % 23 == 0, sfx).otherwise(F.concat(first_line(F.col("text")), sfx))
    return d.select("doc_id", name.alias("name"), F.col("n_chars").alias("size"))


def url_last_segment(url) -> F.Column:
    """Last path segment of a URL with query and fragment cut off."""
    return F.regexp_extract(url, r"^[^?#]*/([^/?#]*)", 1)


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, name): colliding names from the last URL path segment."""
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", url_last_segment(F.col("url")).alias("name"))


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content lists from conversations: conv_id = document, turn = block ordinal and
    page, role = block type.  Already one row per block, so nothing is collected."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("block_idx"),
        F.col("turn").alias("page_idx"),
        F.col("role").alias("type"),
        F.col("text").alias("text"),
    )


# Event type -> job event kind.  A 'view' starts a queued job and is progress
# for a running one, so it serves as both start and progress.
EVENT_KINDS = {"signup": "submit", "view": "view", "click": "cancel", "purchase": "done", "error": "failed"}


def with_job_kinds(e: DataFrame) -> DataFrame:
    """Add ``kind`` and ``payload`` to raw events (native expressions)."""
    kinds = F.create_map(*[x for k, v in EVENT_KINDS.items() for x in (F.lit(k), F.lit(v))])
    payload = (F.when(F.col("event_type") == "view", F.format_string("progress %.2f", F.col("value")))
               .when(F.col("event_type") == "purchase",
                     F.to_json(F.struct(
                         F.when(F.col("value") >= 25, "cuda").otherwise("cpu").alias("device"),
                         F.floor(F.col("value") * 10).cast("long").alias("markdown_chars"),
                         F.floor("value").cast("long").alias("blocks"),
                         F.concat(F.lit("/data/out/"), F.col("user_id").cast("string"), F.lit("/./doc.md")).alias("markdown_path"),
                         F.struct(F.floor(F.col("value") / 10).cast("int").alias("start_page")).alias("options"))))
               .when(F.col("event_type") == "error", F.concat(F.lit("RuntimeError: "), F.col("props"))))
    return e.withColumn("kind", F.element_at(kinds, F.col("event_type"))).withColumn("payload", payload)


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job events from ``events``: job = (user, running count of signups up to
    the event by (ts, event_id)).  Events before a user's first signup get
    generation 0 - an unknown job, which the lifecycle drops."""
    from quire.operators.sequence import running_count_within_key

    e = read_table(spark, sf_dir, "events").select(
        "user_id", "ts", F.col("event_id").alias("seq"), "event_type", "value", "props")
    g = with_job_kinds(running_count_within_key(e, ["user_id"], ["ts", "seq"], F.col("event_type") == "signup", "gen"))
    return g.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("gen").cast("string")).alias("job_id"),
                    "user_id", "seq", "ts", "kind", "payload")
