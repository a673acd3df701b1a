import datetime as dt
import random

from quire.operators import lifecycle as LC
from quire.streaming import jobs as SJ
from quire.streaming.files import latest_per_key

SCHEMA = "job_id string, ts timestamp_ntz, seq long, kind string, payload string"
T0 = dt.datetime(2024, 1, 1)
COLS = ["job_id", "status", "error", "device", "progress", "queued_at", "started_at", "finished_at"]


def _events(rnd, drop, jobs):
    """Events of a drop: a day each; odd orders, repeats and unknown jobs included."""
    rows = []
    for j in jobs:
        for _ in range(rnd.randint(1, 7)):
            kind = rnd.choice(["submit", "start", "progress", "progress", "done", "failed", "cancel", "died", "other"])
            payload = {"done": '{"device": "cpu"}', "failed": "E: x", "progress": f"p{rnd.randint(0, 3)}"}.get(kind)
            rows.append((j, T0 + dt.timedelta(days=drop, seconds=rnd.randint(0, 80_000)), rnd.randint(0, 10**6), kind, payload))
    return rows


def _run(spark, folder, root, ckpt, keep, keep_batches=100):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = (SJ.job_updates(s, keep=keep, late="1 hour").writeStream.foreachBatch(SJ.publish_feed(root, keep_batches)).outputMode("update")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.exception() is None
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def _state(spark, root):
    head = SJ._versions(spark, f"{root}/state", "v")[-1]
    return head, spark.read.parquet(f"{root}/state/v={head}")


def _rows(df):
    return sorted([tuple(r) for r in df.select(*COLS).collect()], key=str)


def test_stream_equals_batch_twin_over_a_restart_and_reconciles(spark, tmp_path):
    rnd = random.Random(3)
    folder, root, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    everything, marks = [], []
    for part, drops in enumerate([(0, 1), (2, 3)]):  # the second part runs from the first one's checkpoint
        for d in drops:
            rows = _events(rnd, d, [f"j{rnd.randint(0, 120)}" for _ in range(80)] + ["hot"] * 40)
            everything += rows
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        _run(spark, folder, root, ckpt, "30 days", keep_batches=2)
        marks.append(_state(spark, root)[0])
    want = LC.job_states(spark.createDataFrame(everything, SCHEMA))
    head, state = _state(spark, root)
    assert _rows(state) == _rows(want)
    # consumers that stopped at any batch, some before what the feed still holds
    seen = [None, *range(head + 1), head + 5]
    out = SJ.missed(spark, root, spark.createDataFrame([(f"c{v}", v) for v in seen], "consumer string, version long"))
    got = {}
    for r in out.collect():
        got.setdefault(r.consumer, []).append((r.source, tuple(r[c] for c in COLS)))
    rows = {v: sorted([tuple(r) for r in state.filter(f"changed > {-1 if v is None else v}").select(*COLS).collect()], key=str) for v in seen}
    assert all(sorted((x for _, x in got.get(f"c{v}", [])), key=str) == rows[v] for v in seen)
    assert {s for s, _ in got["cNone"]} == {"snapshot"} and all({s for s, _ in got.get(f"c{v}", [])} <= {"feed"} for v in range(head - 2, head + 1))
    assert len(SJ._versions(spark, f"{root}/feed", "batch")) == 2


def test_finished_jobs_leave_the_state(spark, tmp_path):
    folder, root, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    sizes = []
    for d in range(6):
        at = T0 + dt.timedelta(days=d)
        rows = [(f"{d}-{i}", at + dt.timedelta(seconds=i * 10 + k), k, kind, None) for i in range(100) for k, kind in enumerate(["submit", "start", "done", "progress"])]
        rows += [(f"{d - 3}-1", at, 9, "progress", "late")] if d > 3 else []  # of a job that is forgotten: dropped
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        sizes.append(_run(spark, folder, root, ckpt, "1 day")[-1])
    assert max(sizes[2:]) <= 300 and sizes[-1] <= sizes[2] + 5  # flat, not 600
    states = _state(spark, root)[1]
    assert states.count() == 600 and states.filter("status <> 'done' OR progress IS NOT NULL").count() == 0


def test_rows_without_id_or_time_are_dropped(spark, tmp_path):
    folder, root, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    rows = [(None, T0, 1, "submit", None), ("a", None, 1, "submit", None), ("b", T0, None, "submit", None), ("c", T0, 1, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    _run(spark, folder, root, ckpt, "1 day")
    assert [r.job_id for r in _state(spark, root)[1].collect()] == ["b"]
    empty = SJ.missed(spark, str(tmp_path / "none"), spark.createDataFrame([("x", None)], "consumer string, version long"))
    assert empty.count() == 0 and latest_per_key(empty.selectExpr("*", "0 AS batch_id"), ["job_id"]).count() == 0
