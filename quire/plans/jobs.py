"""Job queries over ``events``: lifecycle fold, throttles, stalls, elapsed, queue."""
from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import lifecycle as LC
from quire.operators.stalls import running_stalls, stalls
from quire.functions.time import micros_between
from quire.operators.throttle import throttle
from quire.session import read_table
from quire.sources import fixtures as FX

QUERIES = {}
ORACLE = {}

# -- shared SQL: job events from events -----------------------------------------------------------
SQL_JOB_EVENTS = """ev AS (SELECT user_id, ts, event_id AS seq, event_type, value, props,
    sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gen FROM events),
je AS (SELECT user_id || '-' || gen AS job_id, user_id, seq, ts,
    CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'view' WHEN 'click' THEN 'cancel'
                    WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS kind,
    CASE WHEN event_type = 'view' THEN printf('progress %.2f', value)
         WHEN event_type = 'purchase' THEN CAST(to_json({'device': CASE WHEN value >= 25 THEN 'cuda' ELSE 'cpu' END, 'value': value, 'user_id': user_id}) AS VARCHAR)
         WHEN event_type = 'error' THEN 'RuntimeError: ' || props END AS payload FROM ev)"""

SQL_JOB_STATES = SQL_JOB_EVENTS + """,
sub AS (SELECT job_id, min({'ts': ts, 'seq': seq}) AS s FROM je WHERE kind = 'submit' GROUP BY job_id),
e1 AS (SELECT je.* , sub.s FROM je JOIN sub USING (job_id) WHERE {'ts': je.ts, 'seq': je.seq} >= sub.s),
p2 AS (SELECT job_id, any_value(s) AS s, min({'ts': ts, 'seq': seq}) FILTER (WHERE kind = 'view') AS st,
              min({'ts': ts, 'seq': seq}) FILTER (WHERE kind = 'cancel') AS c0 FROM e1 GROUP BY job_id),
e2 AS (SELECT e1.job_id, e1.ts, e1.seq, e1.kind, e1.payload, p2.st FROM e1 JOIN p2 USING (job_id)),
p3 AS (SELECT job_id,
              min({'ts': ts, 'seq': seq}) FILTER (WHERE kind IN ('done', 'failed', 'cancel', 'died') AND st IS NOT NULL AND {'ts': ts, 'seq': seq} > st) AS en,
              arg_min({'kind': kind, 'payload': payload}, {'ts': ts, 'seq': seq})
                FILTER (WHERE kind IN ('done', 'failed', 'cancel', 'died') AND st IS NOT NULL AND {'ts': ts, 'seq': seq} > st) AS en_ev
       FROM e2 GROUP BY job_id),
e3 AS (SELECT e2.*, p3.en FROM e2 JOIN p3 USING (job_id)),
p4 AS (SELECT job_id, arg_max(payload, {'ts': ts, 'seq': seq}) FILTER (WHERE kind = 'view' AND st IS NOT NULL AND {'ts': ts, 'seq': seq} > st
              AND (en IS NULL OR {'ts': ts, 'seq': seq} < en)) AS prog FROM e3 GROUP BY job_id),
j AS (SELECT p2.job_id, p2.s, p2.st, p2.c0, p3.en, p3.en_ev, p4.prog,
             p2.c0 IS NOT NULL AND (p2.st IS NULL OR p2.c0 < p2.st) AS ciq
      FROM p2 JOIN p3 USING (job_id) LEFT JOIN p4 USING (job_id)),
states AS (SELECT job_id,
  CASE WHEN ciq THEN 'cancelled' WHEN st IS NULL THEN 'queued' WHEN en IS NULL THEN 'running'
       WHEN en_ev.kind = 'done' THEN 'done' WHEN en_ev.kind = 'cancel' THEN 'cancelled' ELSE 'failed' END AS status,
  CASE WHEN ciq THEN NULL WHEN en_ev.kind = 'failed' THEN en_ev.payload
       WHEN en_ev.kind = 'died' THEN '""" + LC.DIED_MESSAGE + """' END AS error,
  CASE WHEN NOT ciq AND en_ev.kind = 'done' THEN json_extract_string(en_ev.payload, '$.device') END AS device,
  CASE WHEN NOT ciq AND (en IS NULL OR en_ev.kind IN ('failed', 'died')) THEN prog END AS progress,
  s.ts AS queued_at, CASE WHEN NOT ciq THEN st.ts END AS started_at,
  CASE WHEN ciq THEN c0.ts ELSE en.ts END AS finished_at FROM j)"""


def states(spark, sf_dir):
    return LC.job_states(FX.job_events(spark, sf_dir), "job_id", start_kinds=("view",), progress_kinds=("view",))


# -- job_lifecycle (STR-1 batch twin, JON-3) -----------------------------------------------------
QUERIES["job_lifecycle"] = states
ORACLE["job_lifecycle"] = f"WITH {SQL_JOB_STATES}\nSELECT * FROM states"


# -- last_device (AGG-6) ---------------------------------------------------------------------------
def q_last_device(spark, sf_dir):
    return LC.last_device(states(spark, sf_dir))


QUERIES["last_device"] = q_last_device
ORACLE["last_device"] = (f"WITH {SQL_JOB_STATES}\nSELECT arg_max(device, finished_at) FILTER (WHERE status = 'done') "
                         "AS device FROM states")


# -- queue_position (WIN-6) --------------------------------------------------------------------------
def q_queue_position(spark, sf_dir):
    return LC.queue_positions(states(spark, sf_dir))


QUERIES["queue_position"] = q_queue_position
ORACLE["queue_position"] = (f"WITH {SQL_JOB_STATES}\nSELECT job_id, queued_at, "
                            "row_number() OVER (ORDER BY queued_at, job_id) AS position FROM states "
                            "WHERE status = 'queued'")


# -- elapsed (DAT-1, DAT-2): as of the last event -------------------------------------------------------
def q_elapsed(spark, sf_dir):
    s = states(spark, sf_dir)
    ev = read_table(spark, sf_dir, "events")
    latest = ev.agg(F.max("ts")).first()[0]  # the as-of time, one scalar
    now = F.lit(latest.isoformat(sep=" ")).cast(ev.schema["ts"].dataType)  # wall-clock text: no zone shift
    run_us = micros_between(F.col("started_at"), F.coalesce(F.col("finished_at"), now))
    wait_us = micros_between(F.col("queued_at"), F.coalesce(F.col("started_at"), now))
    # durations as exact integer milliseconds; the text is the DAT-1 display
    return s.select("job_id", "status", F.floor(wait_us / 1000).cast("bigint").alias("wait_ms"),
                    F.floor(run_us / 1000).cast("bigint").alias("run_ms"),
                    LC.elapsed_text(run_us / 1e6).alias("elapsed"))


QUERIES["elapsed"] = q_elapsed
ORACLE["elapsed"] = f"""WITH {SQL_JOB_STATES},
nw AS (SELECT max(ts) AS now FROM events),
x AS (SELECT job_id, status,
        epoch_us(coalesce(started_at, now)) - epoch_us(queued_at) AS wait_us,
        epoch_us(coalesce(finished_at, now)) - epoch_us(started_at) AS run_us FROM states, nw),
y AS (SELECT *, CAST(greatest(floor(run_us / 1e6 + 0.5), 0) AS BIGINT) AS s FROM x)
SELECT job_id, status, CAST(floor(wait_us / 1000) AS BIGINT) AS wait_ms, CAST(floor(run_us / 1000) AS BIGINT) AS run_ms,
  CASE WHEN run_us IS NULL THEN '' WHEN s >= 60 THEN printf('%dm%02ds', s // 60, s % 60) ELSE s || 's' END AS elapsed
FROM y"""


# -- throttle (WIN-3): events keyed by user, interval 1 hour -----------------------------------------
def _throttle_sql(key_expr, interval_sql, where="", ctes="", source="events"):
    return f"""WITH RECURSIVE {ctes}
tev AS (SELECT {key_expr} AS k, event_id, ts FROM {source} {where}),
nx AS MATERIALIZED (SELECT a.k, a.event_id, b.event_id AS nxt_id FROM tev a
       ASOF LEFT JOIN tev b ON a.k = b.k AND b.ts >= a.ts + {interval_sql}),
fst AS (SELECT k, arg_min(event_id, (ts, event_id)) AS event_id FROM tev GROUP BY k),
chain(k, event_id) AS (SELECT k, event_id FROM fst
    UNION ALL SELECT nx.k, nx.nxt_id FROM chain JOIN nx ON nx.event_id = chain.event_id WHERE nx.nxt_id IS NOT NULL)
SELECT e.k AS key, e.event_id, e.ts FROM chain JOIN tev e USING (event_id)"""


def q_throttle(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    return throttle(e, "key", "ts", "event_id", 3600.0).filter("emitted").drop("emitted")


QUERIES["throttle"] = q_throttle
ORACLE["throttle"] = _throttle_sql("user_id", "INTERVAL 1 HOUR")


# -- publish_throttle (WIN-4): progress of running jobs, one key shared by every job, interval 30 minutes ---------------------------
def q_publish_throttle(spark, sf_dir):
    e = LC.accepted_progress(FX.job_events(spark, sf_dir), "job_id", start_kinds=("view",), progress_kinds=("view",))
    e = e.select(F.lit("all").alias("key"), F.col("seq").alias("event_id"), "ts")
    return throttle(e, "key", "ts", "event_id", 1800.0).filter("emitted").drop("emitted")


QUERIES["publish_throttle"] = q_publish_throttle
ORACLE["publish_throttle"] = _throttle_sql("'all'", "INTERVAL 30 MINUTE", ctes=SQL_JOB_STATES + """,
running AS (SELECT e3.seq AS event_id, e3.ts FROM e3 JOIN j USING (job_id) WHERE NOT j.ciq AND kind = 'view' AND e3.st IS NOT NULL
            AND {'ts': e3.ts, 'seq': e3.seq} > e3.st AND (e3.en IS NULL OR {'ts': e3.ts, 'seq': e3.seq} < e3.en)),""", source="running")


# -- stalls (WIN-5): quiet gaps over one day per user ----------------------------------------------------
def q_stalls(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return stalls(e, "user_id", "ts", "event_id", 86400.0)


QUERIES["stalls"] = q_stalls
ORACLE["stalls"] = """SELECT user_id, gap_start, ts AS gap_end,
  CAST(floor((epoch_us(ts) - epoch_us(gap_start)) / 60000000.0 + 0.5) AS BIGINT) AS quiet_minutes FROM (
  SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_start FROM events)
WHERE epoch_us(ts) - epoch_us(gap_start) > 86400000000"""


# -- stalls_running (WIN-5): quiet gaps of jobs between their start and their end -------------------------
def q_stalls_running(spark, sf_dir):
    return running_stalls(FX.job_events(spark, sf_dir), "job_id", 86400.0, start_kinds=("view",), progress_kinds=("view",))


QUERIES["stalls_running"] = q_stalls_running
ORACLE["stalls_running"] = f"""WITH {SQL_JOB_STATES},
heard AS (SELECT e3.job_id, e3.ts, e3.seq FROM e3 JOIN j USING (job_id) WHERE NOT j.ciq AND e3.st IS NOT NULL
  AND (({{'ts': e3.ts, 'seq': e3.seq}} = e3.en) OR (kind = 'view' AND {{'ts': e3.ts, 'seq': e3.seq}} >= e3.st AND (e3.en IS NULL OR {{'ts': e3.ts, 'seq': e3.seq}} < e3.en))))
SELECT job_id, gap_start, ts AS gap_end, CAST(floor((epoch_us(ts) - epoch_us(gap_start)) / 60000000.0 + 0.5) AS BIGINT) AS quiet_minutes FROM (
  SELECT job_id, ts, lag(ts) OVER (PARTITION BY job_id ORDER BY ts, seq) AS gap_start FROM heard)
WHERE epoch_us(ts) - epoch_us(gap_start) > 86400000000"""
