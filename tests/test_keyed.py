"""State of many keys per bucket: as key by key, in a bounded number of calls, with timers of their own."""
import datetime as dt
import json

import numpy as np
import pandas as pd

from quire.streaming.keyed import NO_NUMBER, bucket_fn, fold_by_key

T0 = dt.datetime(2024, 1, 1)


class State:
    """As much of GroupState as a bucket uses."""

    def __init__(self):
        self.value, self.timer, self.hasTimedOut, self.watermark = None, None, False, 0

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, ms):
        assert ms > self.watermark
        self.timer = ms


def _last(key, rows, state):
    state.update(int(rows["us"][-1]))
    state.setTimeoutTimestamp(state.get + 10)
    return [(key, state.get, rows["us"].tolist())]


def _gone(key, state):
    state.remove()
    return [(key, None, [])]


def test_keys_of_a_bucket_keep_their_own_values_and_timers():
    fn, state = bucket_fn(_last, ["us"], ["us"], ["key", "last", "all"], int, _gone), State()

    def call(rows, watermark):
        state.watermark, state.hasTimedOut = watermark, not rows
        frame = pd.DataFrame({"_key": [r[0] for r in rows], "us": np.array([r[1] for r in rows], dtype="int64")})
        half = len(rows) // 2
        return [tuple(r) for out in fn((0,), iter([frame[:half], frame[half:]]), state) for r in out.itertuples(index=False, name=None)]

    big = 2**53 + 1
    got = call([("7", 30), (str(big), 5), (None, 40), ("7", 20), ("7", NO_NUMBER // 2)], 0)
    assert sorted(got, key=str) == sorted([(7, NO_NUMBER // 2, [20, 30, NO_NUMBER // 2]), (big, 5, [5]), (None, 40, [40])], key=str)
    assert state.timer == 15
    # a timer that has passed is served though only another key has data; the key with data is not expired
    assert sorted(call([(None, 41)], 60), key=str) == sorted([(None, 41, [41]), (big, None, [])], key=str)
    assert {k for k, *_ in json.loads(state.get[0])} == {7, None} and state.timer == 61
    assert call([], 62) == [(None, None, [])] and [k for k, *_ in json.loads(state.get[0])] == [7]
    assert call([], 2**63) == [(7, None, [])] and not state.exists


def _sum(key, rows, state):
    state.update((state.get or 0) + int(rows["x"].sum()))
    return [(key, state.get)]


def test_many_keys_take_few_states(spark, tmp_path):
    folder, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "k long, x long"
    for _ in range(2):
        spark.createDataFrame([(None if i == 0 else i, i) for i in range(900)], schema).coalesce(1).write.mode("append").parquet(folder)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = (fold_by_key(s, "k", ["x"], _sum, "k long, total long", "update", buckets=16)
         .writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}")).outputMode("update")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) == 16  # 900 before
    got = {r.k: r.total for r in spark.read.parquet(f"{out}/b=1").collect()}
    assert got == {(None if i == 0 else i): 2 * i for i in range(900)}
