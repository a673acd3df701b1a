"""Text queries over ``documents``: math spans and log-line framing."""
from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as TX
from quire.operators.log_frames import frame_chunks
from quire.plans import sqlfrag as Q
from quire.session import read_table

QUERIES = {}
ORACLE = {}


# -- math_spans (STRG-8) -------------------------------------------------------------------
def q_math_spans(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    ex = d.select("doc_id", F.explode(TX.math_spans("text")).alias("m"))
    return ex.select("doc_id", F.col("m.span_idx").cast("bigint").alias("span_idx"),
                     F.col("m.display").alias("display"), F.col("m.body").alias("body"))


_PH_PREFIX, _PH_SUFFIX = TX.MATH_PLACEHOLDER.split("{}")
QUERIES["math_spans"] = q_math_spans
ORACLE["math_spans"] = f"""WITH
a AS (SELECT doc_id, text, regexp_extract_all(text, {Q.lit(TX.DISPLAY_MATH)}, 1) AS disp,
             regexp_split_to_array(text, {Q.lit(TX.DISPLAY_MATH)}) AS segs FROM documents),
b AS (SELECT doc_id, disp, array_to_string(list_transform(segs, lambda s, i: CASE WHEN i = 1 THEN s
        ELSE {Q.lit(_PH_PREFIX)} || (i - 2) || {Q.lit(_PH_SUFFIX)} || s END), '') AS rebuilt FROM a),
c AS (SELECT doc_id, disp, regexp_extract_all(rebuilt, {Q.lit(TX.INLINE_MATH)}, 1) AS inl FROM b),
d AS (SELECT doc_id, unnest(range(len(disp))) AS span_idx, true AS display, unnest(disp) AS body FROM c
      UNION ALL
      SELECT doc_id, len(disp) + unnest(range(len(inl))) AS span_idx, false AS display, unnest(inl) AS body FROM c)
SELECT doc_id, CAST(span_idx AS BIGINT) AS span_idx, display, body FROM d"""


# -- log_lines (STRG-5/6/7, STR-5 batch twin, LIM-1) ------------------------------------------------
# Each document stands for one job's captured stderr: the whole text is the
# byte stream, split on CR or LF; the unfinished tail is never emitted.
def q_log_lines(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    ex = d.select("doc_id", F.posexplode(TX.complete_lines(TX.decode_lenient(F.encode("text", "UTF-8"))))
                  .alias("line_idx", "line"))
    return ex.select("doc_id", F.col("line_idx").cast("bigint").alias("line_idx"),
                     TX.truncate_progress("line").alias("line"))


QUERIES["log_lines"] = q_log_lines
ORACLE["log_lines"] = f"""WITH
a AS (SELECT doc_id, regexp_split_to_array(text, {Q.lit(TX.LINE_BREAK)}) AS parts FROM documents),
b AS (SELECT doc_id, list_filter(list_transform(list_slice(parts, 1, len(parts) - 1),
        lambda l: regexp_replace(regexp_replace(l, {Q.lit(TX.ANSI_PATTERN)}, '', 'g'),
                                 {Q.lit('^' + TX.STRIP_WS + '+|' + TX.STRIP_WS + '+' + chr(92) + 'z')}, '', 'g')),
        lambda l: l <> '') AS lines FROM a)
SELECT doc_id, CAST(unnest(range(len(lines))) AS BIGINT) AS line_idx,
       substr(unnest(lines), 1, {TX.PROGRESS_CHARS}) AS line FROM b"""


# -- log_chunks (STR-5, STRG-7 at rest): logs as chunks of bytes, cut anywhere ----------------------
# Every third document is a part of one log, a third of all bytes; the others are a log each.  Each text is followed by
# a byte that is no UTF-8, the beginning of a character and, for odd ids, a line break.
CHUNK_BYTES = 500
BROKEN = bytes.fromhex("ffe4b8")


def q_log_chunks(spark, sf_dir):
    i = F.col("doc_id")
    d = read_table(spark, sf_dir, "documents").select(
        F.when(i % 3 > 0, i).alias("log_id"), i.alias("doc_id"),
        F.concat(F.encode("text", "UTF-8"), F.lit(BROKEN), F.when(i % 2 == 1, F.lit(b"\r\n")).otherwise(F.lit(b""))).alias("data"))
    # the chunks are cut before the explode, which would copy the whole text to each of them
    starts = F.sequence(F.lit(0), F.octet_length("data") - 1, F.lit(CHUNK_BYTES))
    pieces = F.transform(starts, lambda at: F.substring(F.col("data"), at + 1, F.lit(CHUNK_BYTES)))
    chunks = d.filter("data IS NOT NULL").select("log_id", "doc_id", F.posexplode_outer(pieces).alias("k", "chunk")).select(
        "log_id", (i * (1 << 24) + F.col("k")).alias("pos"), "chunk")
    lines = frame_chunks(chunks, "log_id", "pos", "chunk", min_hot_rows=500)
    return lines.select("log_id", "line_idx", TX.truncate_progress("line").alias("line"))


QUERIES["log_chunks"] = q_log_chunks
ORACLE["log_chunks"] = f"""WITH
l AS (SELECT CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS log_id,
        string_agg(text || chr(65533) || chr(65533) || CASE WHEN doc_id % 2 = 1 THEN chr(13) || chr(10) ELSE '' END, '' ORDER BY doc_id) AS text
      FROM documents GROUP BY 1),
a AS (SELECT log_id, regexp_split_to_array(text, {Q.lit(TX.LINE_BREAK)}) AS parts FROM l),
b AS (SELECT log_id, list_filter(list_transform(list_slice(parts, 1, len(parts) - 1),
        lambda l: regexp_replace(regexp_replace(l, {Q.lit(TX.ANSI_PATTERN)}, '', 'g'),
                                 {Q.lit('^' + TX.STRIP_WS + '+|' + TX.STRIP_WS + '+' + chr(92) + 'z')}, '', 'g')),
        lambda l: l <> '') AS lines FROM a)
SELECT log_id, CAST(unnest(range(len(lines))) AS BIGINT) AS line_idx,
       substr(unnest(lines), 1, {TX.PROGRESS_CHARS}) AS line FROM b"""
