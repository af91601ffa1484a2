"""Ordered, as-of, interval and fold operators against brute force, plain and split plans alike."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from aerolake.operators import asof, folds, intervals, segments

KEYS = ["k"]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    rows, marks = [], []
    for k in range(3):
        for i in range(200 if k == 0 else 20):
            rows.append((k, float(rng.randint(0, 150)), i, None if rng.random() < 0.2 else rng.random() * 10))
        for i in range(40):
            marks.append((k, rng.choice([float(rng.randint(-5, 155)), rng.random() * 160 - 5]), i))
    return rows, marks


@pytest.fixture(params=["plain", "split"])
def frames(request, spark, data):
    spark.conf.set("aerolake.maxRowsPerTask", "1000000" if request.param == "plain" else "30")
    rows, marks = data
    yield (spark.createDataFrame(rows, "k int, t double, seq long, v double"), spark.createDataFrame(marks, "k int, t double, cid long"))
    spark.conf.unset("aerolake.maxRowsPerTask")


def series(data, k):
    return sorted((t, seq, v) for key, t, seq, v in data[0] if key == k)


def test_linear_and_hold(frames, data):
    samples, marks = frames
    for row in asof.asof_linear(marks, samples, KEYS, "t", "v", "seq").collect():
        s = series(data, row.k)
        times = [x[0] for x in s]
        i = bisect.bisect_left(times, row.t)
        if row.t < times[0] or row.t > times[-1]:
            want = None
        elif i == 0 or (times[i] == row.t and s[i][2] is not None):
            want = s[i][2]
        else:
            a, b = s[i - 1], s[i]
            want = b[2] if a[2] is None else a[2] if b[2] is None else a[2] + (b[2] - a[2]) * (row.t - a[0]) / (b[0] - a[0])
        assert row.value == (None if want is None else pytest.approx(want))
    for row in asof.asof_hold(marks, samples, KEYS, "t", ["v"], "seq").collect():
        s = series(data, row.k)
        i = bisect.bisect_right([x[0] for x in s], row.t) - 1
        assert (None if row.held is None else (row.held.t, row.held.seq, row.held.v)) == (None if i < 0 else s[i])


def test_nearest_ties(frames, data):
    samples, marks = frames
    found = asof.nearest_event(marks, samples, KEYS, "t", "seq", ["v"], within=1.0, ties="last").collect()
    for row in found:
        best, gap = None, 1.0
        for t, seq, _ in series(data, row.k):
            if abs(t - row.t) <= gap:
                best, gap = (t, seq), abs(t - row.t)
        assert (None if row.event is None else (row.event.t, row.event.seq)) == best


def test_regions_and_anchors(frames, data):
    samples, _ = frames
    on = F.coalesce(F.col("v") > 5, F.lit(False))
    found = segments.state_regions(samples, KEYS, "t", ["t", "seq"], on, segments.key_span(samples, KEYS, "t")).collect()
    want, anchors = [], []
    for k in range(3):
        start, idx, anchor = None, 0, None
        s = series(data, k)
        for t, seq, v in s:
            if (v or 0) > 5 and start is None:
                start = t
            elif not (v or 0) > 5 and start is not None:
                want.append((k, idx, start, t))
                start, idx = None, idx + 1
            if anchor is None or t - anchor > 7:
                anchor = t
                anchors.append((k, t, seq))
        if start is not None:
            want.append((k, idx, start, s[-1][0]))
    assert sorted(map(tuple, found)) == sorted(want)
    kept = folds.greedy_anchors(samples, KEYS, "t", ["t", "seq"], 7.0).where("is_anchor").select("k", "t", "seq").collect()
    assert sorted(map(tuple, kept)) == sorted(anchors)


def test_windows(frames, spark):
    samples, _ = frames
    spans = [(k, float(a), float(a + a % 9), i) for k in range(3) for i, a in enumerate(range(0, 150, 11))]
    windows = spark.createDataFrame(spans, "k int, t_start double, t_end double, idx long")
    inside = [(r.k, r.t, r.seq) for r in samples.collect() if any(k == r.k and a <= r.t <= b for k, a, b, _ in spans)]
    for small in (True, False):
        kept = intervals.within_windows(samples, windows, KEYS, "t", small=small)
        assert sorted((r.k, r.t, r.seq) for r in kept.collect()) == sorted(inside)
    counted = {(r.k, r.idx): r.n_points for r in intervals.count_in_windows(windows, samples, KEYS, "t", "seq").collect()}
    assert all(counted[k, i] == sum(1 for r in inside if r[0] == k and a <= r[1] <= b) for k, a, b, i in spans)
