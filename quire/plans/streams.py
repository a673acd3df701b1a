"""Streaming queries (STR-1 .. STR-7): each replays a table as time-ordered file
drops through Structured Streaming (``availableNow``) and returns the final
snapshot, which must equal the batch twin - so the oracle is the twin's SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import names as N
from quire.functions import paths as P
from quire.functions import text as TX
from quire.functions.time import epoch_micros, instant_from_micros
from quire.operators.admission import submit_uploads
from quire.plans import jobs as J
from quire.plans import text as TXQ
from quire.plans import sqlfrag as Q
from quire.session import read_table, scratch_path
from quire.sources import fixtures as FX
from quire.sources.files_sink import write_files
from quire.operators.sequence import rank_within_key
from quire.streaming.files import drop_files, file_stream, latest_per_key, run_available_now
from quire.streaming.inbox import inbox_stream, scan_inbox
from quire.streaming.jobs import COLUMNS, job_updates, missed, publish_feed
from quire.streaming.library_sink import library_sink, read_stream_library
from quire.streaming.keyed import fold_by_key
from quire.streaming.processors import (JOB_OUTPUT, PIECES_OUTPUT, STALL_OUTPUT, fold_gaps, fold_lines, fold_stall_alerts,
                                        fold_throttle, fold_user)

QUERIES = {}
ORACLE = {}
DROPS = 4


def _event_stream(spark, sf_dir, name, cols):
    e = read_table(spark, sf_dir, "events")
    e = FX.with_job_kinds(e).select(*cols)
    folder = drop_files(e, "ts", DROPS, name)
    return file_stream(spark, folder, e.schema)


_JOB_EVENT = ["user_id", "ts", "event_id", "kind", "payload"]


def _timed(s, *more):
    """user_id, us, seq and ``more`` of the events that have a time."""
    us = epoch_micros(F.col("ts"), s.schema["ts"].dataType)
    return s.filter(F.col("ts").isNotNull()).select("user_id", us.alias("us"), F.col("event_id").alias("seq"), *more)


def _user_jobs(rows):
    return fold_by_key(rows, "user_id", ["us", "seq"], fold_user, JOB_OUTPUT, "update")


# -- stream_lifecycle (STR-1, STR-6/7 snapshot) ------------------------------------------------
def q_stream_lifecycle(spark, sf_dir):
    out = _user_jobs(_timed(_event_stream(spark, sf_dir, "events-lifecycle", _JOB_EVENT), "kind", "payload"))
    return latest_per_key(run_available_now(out.drop("result"), "lifecycle", "update"), ["job_id"])


QUERIES["stream_lifecycle"] = q_stream_lifecycle
ORACLE["stream_lifecycle"] = J.ORACLE["job_lifecycle"]


# -- stream_jobs (STR-1): events that carry their job id, state of live and recently ended jobs only -------
def _job_updates(spark, sf_dir, name):
    e = FX.job_events(spark, sf_dir).drop("user_id")
    s = file_stream(spark, drop_files(e, "ts", DROPS, name), e.schema)
    return job_updates(s, keep="3 days", late="1 hour", start_kinds=("view",), progress_kinds=("view",))


def q_stream_jobs(spark, sf_dir):
    out = run_available_now(_job_updates(spark, sf_dir, "job-events").drop("result"), "jobs", "update")
    return latest_per_key(out, ["job_id"])


QUERIES["stream_jobs"] = q_stream_jobs
ORACLE["stream_jobs"] = J.ORACLE["job_lifecycle"]


# -- stream_reconcile (STR-7): consumers that missed batches get the jobs that changed since ---------------
CONSUMERS = [("new", None), ("far", 0), ("mid", 1), ("near", 2), ("up to date", DROPS - 1)]


def q_stream_reconcile(spark, sf_dir):
    root = scratch_path(spark, "job-feed")
    q = (_job_updates(spark, sf_dir, "job-events-feed").writeStream.foreachBatch(publish_feed(root, keep_batches=3)).outputMode("update")
         .option("checkpointLocation", scratch_path(spark, "job-feed-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    consumers = spark.createDataFrame(CONSUMERS, "consumer string, version long")
    return missed(spark, root, consumers).select("consumer", *[c for c in COLUMNS if c != "result"])


QUERIES["stream_reconcile"] = q_stream_reconcile
# A job's last change is its last effective event; drops cut the time range evenly.
ORACLE["stream_reconcile"] = f"""WITH {J.SQL_JOB_STATES},
p5 AS (SELECT job_id, max(ts) FILTER (WHERE kind = 'view' AND st IS NOT NULL AND {{'ts': ts, 'seq': seq}} > st
              AND (en IS NULL OR {{'ts': ts, 'seq': seq}} < en)) AS said FROM e3 GROUP BY job_id),
last AS (SELECT job_id, CASE WHEN ciq THEN c0.ts ELSE greatest(s.ts, st.ts, en.ts, said) END AS ts FROM j JOIN p5 USING (job_id)),
span AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM je),
moved AS (SELECT job_id, least(floor((epoch_us(ts) - lo)::DOUBLE * {DROPS} / (hi - lo + 1)), {DROPS - 1}) AS batch FROM last JOIN span ON true),
c AS (SELECT * FROM (VALUES {', '.join(f"({Q.lit(n)}, {-1 if v is None else v})" for n, v in CONSUMERS)}) AS t(consumer, version))
SELECT consumer, states.* FROM states JOIN moved USING (job_id) JOIN c ON batch > version"""


# -- stream_throttle (STR-2) ---------------------------------------------------------------------
def q_stream_throttle(spark, sf_dir):
    s = _event_stream(spark, sf_dir, "events-throttle", ["user_id", "event_id", "ts"])
    out = fold_by_key(_timed(s), "user_id", ["us", "seq"], fold_throttle(3600.0),
                      "key long, event_id long, ts timestamp_ntz", "append")
    return run_available_now(out, "throttle").drop("batch_id")


QUERIES["stream_throttle"] = q_stream_throttle
ORACLE["stream_throttle"] = J.ORACLE["throttle"]


# -- stream_stalls (STR-3, closed gaps) ---------------------------------------------------------------
def q_stream_stalls(spark, sf_dir):
    s = _event_stream(spark, sf_dir, "events-stalls", ["user_id", "event_id", "ts"])
    out = fold_by_key(_timed(s), "user_id", ["us", "seq"], fold_gaps(86400.0),
                      "user_id long, gap_start timestamp_ntz, gap_end timestamp_ntz, quiet_minutes long", "append")
    return run_available_now(out, "stalls").drop("batch_id")


QUERIES["stream_stalls"] = q_stream_stalls
ORACLE["stream_stalls"] = J.ORACLE["stalls"]


# -- stream_log_lines (STR-5): byte chunks with a carried tail ------------------------------------------
CHUNK_BYTES = 256


def q_stream_log_lines(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    n = F.greatest(F.ceil(F.octet_length("b") / CHUNK_BYTES) - 1, F.lit(0))
    chunks = d.select("doc_id", "b", F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("chunk_idx")).select(
        "doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"),
        F.substring("b", F.col("chunk_idx") * CHUNK_BYTES + 1, CHUNK_BYTES).alias("chunk"))
    folder = drop_files(chunks, "chunk_idx", DROPS, "log-chunks")
    s = file_stream(spark, folder, chunks.schema)
    pieces = fold_by_key(s, "doc_id", ["chunk_idx"], fold_lines, PIECES_OUTPUT, "append")
    lines = pieces.select("doc_id", "first", F.posexplode(TX.complete_lines(TX.decode_lenient("whole"))).alias("pos", "line"))
    out = run_available_now(lines.select("doc_id", "first", "pos", TX.truncate_progress("line").alias("line")), "log-lines")
    ranked = rank_within_key(out, ["doc_id"], ["first", "pos"], "_n")
    return ranked.select("doc_id", (F.col("_n") - 1).alias("line_idx"), "line")


QUERIES["stream_log_lines"] = q_stream_log_lines
ORACLE["stream_log_lines"] = TXQ.ORACLE["log_lines"]


# -- stream_ingest (STR-4): an inbox of uploads read incrementally ---------------------------------------
def inbox_files(spark, sf_dir):
    """One folder per language; names repeat across folders."""
    d = read_table(spark, sf_dir, "documents")
    name = F.concat("lang", F.lit("/"), "source", F.lit("-"), (F.col("doc_id") / 20).cast("long").cast("string"), FX.suffix_for("doc_id"))
    return d.select(name.alias("file_name"), F.encode("text", "UTF-8").alias("content"), "doc_id")


UPLOAD_OPTIONS = '{"lang": "fr", "start_page": "\\t2", "device": "auto", "other": 1}'


def q_stream_ingest(spark, sf_dir):
    inbox = scratch_path(spark, "inbox")
    first = inbox_files(spark, sf_dir).groupBy("file_name").agg(F.min_by("content", "doc_id").alias("content"))
    write_files(first, inbox)
    found = scratch_path(spark, "uploads")
    scan_inbox(spark, inbox, found)
    jobs = submit_uploads(inbox_stream(spark, found).select("path", "length"), inbox, UPLOAD_OPTIONS)
    return run_available_now(jobs, "ingest").select("path", "length", "decision", "kind", "doc_id", "options.lang", "options.start_page", "error")


QUERIES["stream_ingest"] = q_stream_ingest
_SFX = f"([{', '.join(Q.lit(x) for x in FX.FIXTURE_SUFFIXES)}])[(doc_id % {len(FX.FIXTURE_SUFFIXES)}) + 1]"
ORACLE["stream_ingest"] = f"""
WITH f AS (SELECT file_name AS path, CAST(strlen(arg_min(text, doc_id)) AS BIGINT) AS length FROM (
  SELECT lang || '/' || source || '-' || (doc_id // 20) || {_SFX} AS file_name, text, doc_id FROM documents) GROUP BY file_name),
g AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM f)
SELECT path, length, CASE WHEN {Q.is_supported('name')} THEN 'accepted' ELSE 'skipped' END AS decision,
  CASE WHEN {Q.is_supported('name')} THEN 'submit' END AS kind,
  CASE WHEN {Q.is_supported('name')} THEN substr(sha256(concat_ws(chr(0), path, CAST(length AS VARCHAR))), 1, 32) END AS doc_id,
  CASE WHEN {Q.is_supported('name')} THEN 'fr' END AS lang, CASE WHEN {Q.is_supported('name')} THEN 2 END AS start_page, NULL AS error FROM g"""


# -- stream_library (STR-6): done jobs maintain the library snapshot ------------------------------------
def q_stream_library(spark, sf_dir):
    out = _user_jobs(_timed(_event_stream(spark, sf_dir, "events-library", _JOB_EVENT), "kind", "payload"))
    root = scratch_path(spark, "library")
    q = (out.writeStream.foreachBatch(library_sink(root, "/data")).outputMode("update")
         .option("checkpointLocation", scratch_path(spark, "library-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    lib = read_stream_library(spark, root)
    return lib.select("id", "stem", F.col("created").cast("timestamp_ntz").alias("created"), "device", "seconds",
                      "markdown_path", "markdown_chars", "blocks", "options.start_page")


QUERIES["stream_library"] = q_stream_library
ORACLE["stream_library"] = f"""WITH {J.SQL_JOB_STATES},
done AS (SELECT job_id, json_extract(en_ev.payload, '$.value')::DOUBLE AS value, json_extract_string(en_ev.payload, '$.user_id') AS u FROM p3 WHERE en_ev.kind = 'done')
SELECT job_id AS id, job_id AS stem, finished_at AS created, device,
  round((epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 1) AS seconds, 'out/' || u || '/doc.md' AS markdown_path,
  CAST(floor(value * 10) AS BIGINT) AS markdown_chars, CAST(floor(value) AS BIGINT) AS blocks, CAST(floor(value / 10) AS INTEGER) AS start_page
FROM states JOIN done USING (job_id) WHERE status = 'done'"""


# -- stream_open_stalls (STR-3 open tail): keys still quiet when the stream ends ---------------------
def q_stream_open_stalls(spark, sf_dir):
    s = _event_stream(spark, sf_dir, "events-open-stalls", ["user_id", "event_id", "ts"])
    s = _timed(s).withColumn("event_time", instant_from_micros(F.col("us"))).withWatermark("event_time", "0 seconds")
    fold, quiet = fold_stall_alerts(86400.0)
    out = fold_by_key(s, "user_id", ["us", "seq"], fold, STALL_OUTPUT, "append", quiet)
    alerts = run_available_now(out, "open-stalls").drop("batch_id")
    closed = alerts.filter(~F.col("open")).select("user_id", "gap_start")
    still_open = alerts.filter("open").join(closed, ["user_id", "gap_start"], "left_anti")
    return still_open.select("user_id", "gap_start").distinct()


QUERIES["stream_open_stalls"] = q_stream_open_stalls
# Watermark = latest event time (ms); a key is open when last + 1 day < watermark.
ORACLE["stream_open_stalls"] = (
    "WITH k AS (SELECT user_id, max(ts) AS gap_start FROM events GROUP BY user_id), "
    "w AS (SELECT max(ts) AS wm FROM events) "
    "SELECT user_id, gap_start FROM k, w "
    "WHERE floor(epoch_us(gap_start) / 1000) + 86400000 < floor(epoch_us(wm) / 1000)")
