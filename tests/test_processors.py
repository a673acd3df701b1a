"""State functions of the streams against event-by-event models, over random batches."""
import random

import pandas as pd
import pytest

from quire.streaming.processors import gaps_fn, throttle_fn


class State:
    def __init__(self):
        self.value = None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def _batches(rng):
    """Ordered and late events, equal times, rows without a time, a batch of these alone."""
    n = 0
    for _ in range(rng.randint(1, 5)):
        rows = []
        for _ in range(rng.randint(1, 12)):
            rows.append((7, n, None if rng.random() < 0.1 else rng.randint(0, 400) * 500_000))
            n += 1
        yield rows


def _stamp(us):
    return pd.Timestamp("2024-01-01") + pd.Timedelta(microseconds=us)


def _run(fn, batches, unit):
    state, out = State(), []
    for rows in batches:
        pdf = pd.DataFrame({"k": [r[0] for r in rows], "seq": [r[1] for r in rows],
                            "ts": pd.Series([None if r[2] is None else _stamp(r[2]) for r in rows], dtype=f"datetime64[{unit}]")})
        half = len(pdf) // 2
        for got in fn((7,), iter([pdf[:half], pdf[half:]]), state):
            out.extend(got.itertuples(index=False, name=None))
    return out


def _ordered(rows):
    return sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1]))


@pytest.mark.parametrize("unit", ["ns", "us"])
@pytest.mark.parametrize("interval", [0, 1, 17.5])
def test_throttle_equals_event_by_event(interval, unit):
    for seed in range(60):
        batches = list(_batches(random.Random(seed)))
        want, last = [], None
        for rows in batches:
            for _, seq, us in _ordered(rows):
                if last is None or us - last >= interval * 1_000_000:
                    want.append(seq)
                    last = us
        assert [r[1] for r in _run(throttle_fn(interval, "k", "ts", "seq"), batches, unit)] == want


@pytest.mark.parametrize("unit", ["ns", "us"])
def test_gaps_equal_event_by_event(unit):
    for seed in range(60):
        batches = list(_batches(random.Random(seed)))
        want, last = [], None
        for rows in batches:
            for _, _, us in _ordered(rows):
                if last is not None and us - last > 20_000_000:
                    want.append((7, _stamp(last), _stamp(us), int((us - last) / 60_000_000 + 0.5)))
                last = us if last is None else max(last, us)
        assert _run(gaps_fn(20, "k", "ts", "seq"), batches, unit) == want


def test_folds_of_a_bucket_equal_single_keys():
    """One call over many keys gives what a call per key gives; before, there was only the latter."""
    from quire.streaming.keyed import NO_NUMBER, bucket_fn
    from quire.streaming.processors import fold_gaps, fold_lines, fold_stall_alerts, fold_throttle

    class Group(State):
        hasTimedOut = False

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, ms):
            self.timer = ms

    rng = random.Random(1)
    fold, quiet = fold_stall_alerts(20)
    bucket = {"throttle": bucket_fn(fold_throttle(17.5), ["us", "seq"], ["us", "seq"], ["k", "seq", "ts"], int),
              "gaps": bucket_fn(fold_gaps(20), ["us", "seq"], ["us", "seq"], ["k", "a", "b", "m"], int),
              "stalls": bucket_fn(fold, ["us", "seq"], ["us", "seq"], ["k", "a", "b", "m", "open"], int, quiet)}
    single = {"throttle": throttle_fn(17.5, "k", "ts", "seq"), "gaps": gaps_fn(20, "k", "ts", "seq")}
    states, alone = {n: Group() for n in bucket}, {(n, k): State() for n in single for k in range(9)}
    for b in range(4):
        rows = [(rng.randrange(9), i, 10**15 + (600 * b + rng.randint(0, 800)) * 500_000) for i in range(120)]
        frame = pd.DataFrame({"_key": [str(r[0]) for r in rows], "seq": [r[1] for r in rows], "us": [r[2] for r in rows]})
        got = {n: sorted(x for out in fn((0,), iter([frame[:50], frame[50:]]), states[n]) for x in out.itertuples(index=False, name=None)) for n, fn in bucket.items()}
        for n, fn in single.items():
            want = []
            for k in range(9):
                one = pd.DataFrame([(r[0], r[1], pd.Timestamp(r[2] * 1000)) for r in rows if r[0] == k], columns=["k", "seq", "ts"])
                want += [x for out in fn((k,), iter([one]), alone[n, k]) for x in out.itertuples(index=False, name=None)]
            assert got[n] == sorted(want) and want
        assert [x[:4] for x in got["stalls"]] == got["gaps"] and not any(x[4] for x in got["stalls"])
    assert bucket["throttle"]((0,), iter([pd.DataFrame({"_key": ["77"], "seq": [NO_NUMBER], "us": [1]})]), states["throttle"]).__next__()["seq"][0] is None

    lines, state = bucket_fn(fold_lines, ["chunk_idx", "chunk"], ["chunk_idx"], ["k", "first", "whole"], int), Group()
    parts = [("1", 0, b"a\xff\nb\xe4"), ("2", 0, b"no break"), ("1", 1, b"\xb8\xad\r"), ("2", 1, b"\n")]
    out = []
    for part in (parts[:2], parts[2:]):
        for pdf in lines((0,), iter([pd.DataFrame(part, columns=["_key", "chunk_idx", "chunk"])]), state):
            out += pdf.itertuples(index=False, name=None)
    assert out == [(1, 0, b"a\xff\n"), (1, 1, b"b\xe4\xb8\xad\r"), (2, 0, b"no break\n")]
