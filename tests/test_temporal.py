"""Sessions, flicker fold and joins against plain Python models."""

import bisect
import random

import pytest

from chronolith.operators import temporal, views
from chronolith.params import SECOND, Params

FRAME = "id long, ts_us long, app string, window string, site string, device string"
P = Params()


def frames(spark, rows, device=""):
    return spark.createDataFrame([(i, t * SECOND, app, app, None, device) for i, (t, app) in enumerate(rows)], FRAME)


def model(rows, gap=300, cap=90, flicker=20):
    """Greedy: [start, end, active, app, interruptions]."""
    segs = []
    for i, (t, app) in enumerate(rows):
        before = t - rows[i - 1][0] if i else None
        if not segs or segs[-1][3] != app or before > gap:
            segs.append([t, t, 0, app, 0])
        segs[-1][1] = t
        if i + 1 < len(rows) and rows[i + 1][0] - t <= gap:
            segs[-1][2] += min(cap, rows[i + 1][0] - t)
    out, i = [], 0
    while i < len(segs):
        s = list(segs[i])
        while i + 2 < len(segs) and segs[i + 2][3] == s[3] and segs[i + 1][1] - segs[i + 1][0] <= flicker and segs[i + 1][0] - s[1] <= gap and segs[i + 2][0] - segs[i + 1][1] <= gap:
            s[1], s[2], s[4], i = segs[i + 2][1], s[2] + segs[i + 2][2], s[4] + 1, i + 2
        out.append(tuple(s))
        i += 1
    return out


@pytest.mark.parametrize("runs", [3, 5, 4096])
def test_segments_equal_the_greedy_model(spark, monkeypatch, runs):
    """Whatever the size of a bucket of runs; long chains of short visits cross it, and hours, many times."""
    monkeypatch.setattr(temporal, "RUNS", runs)
    rng = random.Random(4)
    for pauses in ([1, 3, 5, 15, 25, 100, 299, 300, 301, 5000], [5, 10, 15]):
        t, rows = 86_000, []
        for i in range(700):
            t += rng.choice(pauses)
            rows.append((t, rng.choice("AAB") if len(pauses) > 3 or i % 50 == 0 else "AB"[i % 2]))
        got = temporal.segments(frames(spark, rows), P).collect()
        got = sorted((r["start_us"] // SECOND, r["end_us"] // SECOND, r["active_us"] // SECOND, r["app"], len(r["interruptions"])) for r in got)
        assert got == model(rows)


def test_gap_is_a_barrier_and_cap_is_noted(spark):
    got = temporal.segments(frames(spark, [(100, "A"), (250, "A"), (260, "S"), (265, "S"), (365, "A")]), P).collect()
    assert len(got) == 1 and got[0]["capped"] and [i["us"] for i in got[0]["interruptions"]] == [95 * SECOND]
    got = temporal.segments(frames(spark, [(0, "A"), (60, "A"), (2700, "S"), (2708, "S"), (2720, "A"), (2750, "A")]), P).collect()
    assert sorted(r["app"] for r in got) == ["A", "A", "S"]
    assert {r["break_reason"] for r in got} == {"start", "session_gap: 2640s > 300s", "context_switch"}


def test_merge_can_be_off_and_empty_is_empty(spark):
    off = Params(merge_flicker=0)
    assert temporal.segments(frames(spark, [(0, "A"), (1, "B"), (2, "A")]), off).count() == 3
    assert temporal.segments(frames(spark, []), P).count() == 0


def test_nearest_prefers_the_earlier_and_crosses_days(spark):
    day = 86_400
    f = frames(spark, [(10, "a"), (20, "b"), (30, "c"), (5 * day, "d")])
    e = spark.createDataFrame([("", i, t * SECOND) for i, t in enumerate([9, 14, 15, 16, 100, 3 * day, 9 * day])], "device string, id long, ts_us long")
    got = {r["id"]: r["frame"]["app"] for r in temporal.nearest(e, f, ["app"]).collect()}
    times = [10, 20, 30, 5 * day]
    for i, t in enumerate([9, 14, 15, 16, 100, 3 * day, 9 * day]):
        k = bisect.bisect_right(times, t)
        best = min([j for j in (k - 1, k) if 0 <= j < 4], key=lambda j: (abs(times[j] - t), j))
        assert got[i] == "abcd"[best]


def test_each_event_counts_once_over_devices(spark):
    one = spark.createDataFrame([(i, t * SECOND, "Editor", "w", None, "m1") for i, t in enumerate(range(0, 600, 10))] + [(1000 + i, t * SECOND, "Browser", "w", None, "m2") for i, t in enumerate(range(5, 600, 10))], FRAME)
    e = spark.createDataFrame([(i, (3 + 5 * i) * SECOND, "key", None) for i in range(100)], "id long, ts_us long, event_type string, text string")
    got = views.input_stats(e, one, P).collect()
    assert sum(r["keys"] for r in got) == 100
    segs = temporal.segments(one, P).collect()
    assert len(segs) == 2 and not any(r["interruptions"] for r in segs)


def test_first_span_that_holds_a_time_equals_a_loop(spark):
    """Spans of every length, many nested or at once, before and after 1970."""
    rng = random.Random(8)
    spans = []
    for i in range(400):
        start = rng.choice([0, -5 * temporal.HOUR, 470_000 * temporal.HOUR]) + rng.randrange(rng.choice([5, 3_000, 5_000_000, 200_000_000, 6 * temporal.HOUR]))
        spans.append((start, start + rng.choice([0, 1, 999, 1_000, rng.randrange(3_000_000), rng.randrange(90_000_000), rng.randrange(5 * temporal.HOUR)]), (rng.randrange(300), i)))
    edges = [t + d for s, e, _ in spans for t in (s, e) for d in (-1, 0, 1)]
    times = rng.sample(edges, 900) + [rng.choice(spans)[0] + rng.randrange(temporal.HOUR) for _ in range(300)]
    want = {t: min((o for s, e, o in spans if s <= t <= e), default=None) for t in times}
    got = temporal.first_holding(spark.createDataFrame([(t,) for t in times], "ts_us long"), spark.createDataFrame(spans, "start_us long, end_us long, span struct<seen:int,i:int>")).collect()
    assert {r["ts_us"]: tuple(r["span"]) for r in got} == {t: o for t, o in want.items() if o} and len(got) > 500


def test_no_window_reads_to_the_end_of_its_partition_for_each_row(spark):
    f = frames(spark, [(10, "a"), (20, "b")])
    e = spark.createDataFrame([("", 1, 15 * SECOND)], "device string, id long, ts_us long")
    plan = temporal.nearest(e, f, ["app"])._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()


def test_coverage_and_gaps(spark):
    f = frames(spark, [(0, "A"), (59, "A"), (61, "B"), (4000, "B")])
    c = views.coverage(f).first()
    assert (c["active_minutes"], c["span_minutes"], c["coverage_pct"], c["distinct_apps"]) == (3, 66, 4, 2)
    assert [r["minutes"] for r in views.coverage_gaps(f).collect()] == [65]
