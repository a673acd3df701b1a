import random

from pyspark.sql import functions as F

from quire.operators.throttle import throttle


def leading_edge(times, interval):
    """The rule one event at a time: emit if the last emission is at least the interval ago."""
    last = float("-inf")
    for t in times:
        if t - last >= interval:
            last = t
        yield last == t


def _check(spark, rows, interval, min_hot_rows):
    df = spark.createDataFrame(rows, "k long, ts timestamp, seq long")
    got = {r.seq: r.emitted for r in throttle(df, "k", "ts", "seq", interval, min_hot_rows=min_hot_rows).collect()}
    by_key = {}
    for k, ts, seq in rows:
        by_key.setdefault(k, []).append((ts, seq))
    for k, evs in by_key.items():
        evs.sort()
        want = leading_edge([ts.timestamp() for ts, _ in evs], interval)
        for (ts, seq), w in zip(evs, want):
            assert got[seq] == w, (k, ts, seq, got[seq], w)


def test_throttle_golden(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    times = [0, 0.1, 0.25, 0.3, 0.6]
    rows = [(1, base + dt.timedelta(seconds=t), i) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, seq long")
    out = [r.emitted for r in throttle(df, "k", "ts", "seq", 0.25).orderBy("seq").collect()]
    assert out == [True, False, True, False, True]


def test_throttle_hot_key_across_slices(spark):
    import datetime as dt
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows, seq = [], 0
    for k in range(12):
        count = 3000 if k == 0 else rnd.randint(1, 60)
        t = 0.0
        for _ in range(count):
            t += rnd.choice([0.05, 0.1, 0.2, 0.3, 0.6, 1.7])
            rows.append((k, base + dt.timedelta(microseconds=int(t * 1e6)), seq))
            seq += 1
    for interval in (0.25, 1.0, 30.0):
        _check(spark, rows, interval, min_hot_rows=200)


def test_throttle_periodic_chains(spark):
    # events every 0.6 T never let two chains merge: the entry state matters
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(7, base + dt.timedelta(milliseconds=600 * i), i) for i in range(2000)]
    _check(spark, rows, 1.0, min_hot_rows=100)


def test_results_do_not_depend_on_session_time_zone(spark):
    from quire.operators.stalls import stalls
    from tests.conftest import SF_SMALL

    e = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(F.col("user_id").alias("key"), "event_id", "ts")

    def run():
        t = {r.event_id for r in throttle(e, "key", "ts", "event_id", 3600.0).filter("emitted").collect()}
        s = {(r.key, r.gap_start, r.quiet_minutes) for r in stalls(e, "key", "ts", "event_id", 86400.0).collect()}
        return t, s

    base = run()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert run() == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_null_keys_times_and_dense_intervals(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    # 1 s apart, an interval longer than a bucket; the key is null
    rows = [(None, base + dt.timedelta(seconds=i), i) for i in range(3000)] + [(4, None, 5000), (4, base, 5001)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, seq long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")  # segments span batches
    try:
        got = {hot: sorted(r.seq for r in throttle(df, "k", "ts", "seq", 900.0, min_hot_rows=hot).filter("emitted").collect()) for hot in (1, 100, 100_000)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got[1] == got[100] == got[100_000] == [0, 900, 1800, 2700, 5001]
