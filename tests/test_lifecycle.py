import pandas as pd
from pyspark.sql import functions as F

from quire.operators import lifecycle as LC
from quire.sources import fixtures as FX
from quire.streaming.processors import fold_user_jobs
from tests.conftest import SF_SMALL


def test_elapsed_golden(spark):
    df = spark.createDataFrame([(0.0,), (59.4,), (59.5,), (125.0,), (3600.0,), (-3.0,), (None,)], "s double")
    got = [r.e for r in df.select(LC.elapsed_text(F.col("s")).alias("e")).collect()]
    assert got == ["0s", "59s", "1m00s", "2m05s", "60m00s", "0s", ""]


class _State:
    def __init__(self):
        self.value = None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value = v


def test_batch_twin_equals_sequential_fold(spark):
    """The closed-form batch lifecycle equals the event-by-event state machine."""
    ev = FX.with_job_kinds(spark.read.parquet(f"{SF_SMALL}/events.parquet")).select(
        "user_id", "ts", F.col("event_id").alias("seq"), "kind", "payload").toPandas()
    want = {}
    for user, g in ev.groupby("user_id"):
        st = _State()
        # feed in three chunks, as micro-batches would
        for part in (g.iloc[: len(g) // 3], g.iloc[len(g) // 3: 2 * len(g) // 3], g.iloc[2 * len(g) // 3:]):
            for out in fold_user_jobs((user,), iter([part]), st):
                for r in out.itertuples():
                    want[r.job_id] = (r.status, r.error, r.device, r.progress)
    got = LC.job_states(FX.job_events(spark, SF_SMALL), "job_id", ("view",), ("view",)).collect()
    got = {r.job_id: (r.status, r.error, r.device, r.progress) for r in got}
    assert got == want
    assert set(s for s, *_ in got.values()) <= set(LC.STATUSES)


def test_queue_position_and_last_device(spark):
    import datetime as dt
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    ev = spark.createDataFrame([
        ("j1", 1, t(0), "submit", None), ("j2", 2, t(1), "submit", None), ("j3", 3, t(2), "submit", None),
        ("j1", 4, t(3), "start", None), ("j1", 5, t(4), "done", '{"device": "mps"}'),
        ("j3", 6, t(5), "cancel", None), ("j9", 7, t(6), "start", None)],
        "job_id string, seq long, ts timestamp_ntz, kind string, payload string")
    st = LC.job_states(ev)
    assert {r.job_id: r.status for r in st.collect()} == {"j1": "done", "j2": "queued", "j3": "cancelled"}
    assert LC.last_device(st).first().device == "mps"
    assert [(r.job_id, r.position) for r in LC.queue_positions(st).collect()] == [("j2", 1)]


def test_only_running_jobs_can_be_quiet(spark):
    import datetime as dt

    from quire.operators.stalls import running_stalls

    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", 0, "submit"), ("a", 500, "start"), ("a", 590, "progress"), ("a", 700, "progress"), ("a", 900, "done"), ("a", 2000, "progress"),
            ("b", 0, "submit"), ("b", 1000, "cancel"), ("c", 0, "start"), ("c", 500, "progress"), ("d", 0, "submit"), ("d", 10, "start"), ("d", 400, "failed")]
    df = spark.createDataFrame([(j, t0 + dt.timedelta(seconds=s), i, k, None) for i, (j, s, k) in enumerate(rows)], "job_id string, ts timestamp_ntz, seq long, kind string, payload string")
    got = sorted((r.job_id, (r.gap_start - t0).seconds, (r.gap_end - t0).seconds, r.quiet_minutes) for r in running_stalls(df).collect())
    assert got == [("a", 590, 700, 2), ("a", 700, 900, 3), ("d", 10, 400, 7)]
