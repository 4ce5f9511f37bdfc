"""Registered queries of every length and number of rounds against plain Python models."""

from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from chronolith import queries
from chronolith.operators import mining

#: Steps of three users: the two specific ones are seven apart, so no shorter n-gram has both.
PATH = ["click:0", "[error]", "[signup]", "[purchase]", "[error]", "[signup]", "view:1"]


@pytest.fixture
def long_routine(spark, tmp_path):
    rows = []
    for user in range(3):
        for i, step in enumerate(PATH):
            kind, _, k = step.strip("[]").partition(":")
            rows.append((len(rows), datetime(2024, 1, 1) + timedelta(hours=user, minutes=i), user, kind, f'{{"k": {k or 0}}}', 0.0))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string, value double").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_ngrams_of_every_length(spark, long_routine):
    run = lambda name: queries.queries()[name](spark, long_routine).collect()
    count = Counter(" -> ".join(PATH[i : i + n]) for n in range(3, 8) for i in range(8 - n))
    assert {r["sig"]: r["cnt"] for r in run("frequent_ngrams")} == {g: 3 * c for g, c in count.items()}
    assert [(r["sig"], r["n"], r["cnt"]) for r in run("maximal_ngrams")] == [(" -> ".join(PATH), 7, 3)]
    assert [(r["covered"], r["total"]) for r in run("ngram_coverage")] == [(21, 21)]
    assert {r["part"]: (r["covered"], r["total"]) for r in run("temporal_holdout")} == {"train": (21, 21), "test": (0, 0)}


def test_break_reasons_equal_sql_where_frames_share_a_time(spark, tmp_path):
    """Frames at one time at the start, whose first gap the SQL does not know, and before and after pauses."""
    times = [0, 0, 0, 10, 10, 400, 400, 400, 405, 2000]
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=t), i, "view" if i % 5 else "click" if i else "view", '{"k": 1}', 0.0) for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["segment_break_reasons"]).fetchall()
    got = queries.queries()["segment_break_reasons"](spark, str(tmp_path)).select("break_reason", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 2


def test_null_takes_twenty_rounds_of_every_length(spark, long_routine, monkeypatch):
    seen = {}
    monkeypatch.setattr(mining, "shuffled_null", lambda sessions, **args: seen.update(args))
    queries.queries()["shuffle_null"](spark, long_routine)
    assert seen == {"rounds": 20, "least": 3}


def test_rounds_of_the_null_are_mined_together(spark, monkeypatch):
    steps = ["view:1", "click:2", "type:3", "[Save]"]
    sessions = spark.createDataFrame([(f"s{i}", 100 * i, [steps[(i * k * k + k) % 4] for k in range(6 + i)]) for i in range(8)], "session string, start_us long, path array<string>").cache()
    want = []
    for i in range(3):
        one = sessions.withColumn("path", F.transform(F.sort_array(F.transform("path", lambda s, k: F.struct(F.xxhash64(F.lit(5 + i), "session", k).alias("r"), s.alias("s")))), lambda x: x["s"]))  # noqa: B023
        paths = [r["path"] for r in one.collect()]
        runs = [(s, at, tuple(p[at : at + n])) for s, p in enumerate(paths) for n in range(3, len(p) + 1) for at in range(len(p) - n + 1)]
        count = Counter(g for _, _, g in runs)
        good = {tuple(r["gram"]) for r in mining.specific(spark.createDataFrame([(list(g),) for g, c in count.items() if c >= 3] or [([],)], "gram array<string>")).collect()}
        inside = {(s, at + k) for s, at, g in runs if g in good for k in range(len(g))}
        want.append((len(inside), sum(map(len, paths)), i))
    calls, mine = [], mining.frequent_ngrams
    monkeypatch.setattr(mining, "frequent_ngrams", lambda *a, **k: calls.append(1) or mine(*a, **k))
    got = mining.shuffled_null(sessions, rounds=3, seed=5, least=3)
    assert got.columns == ["covered", "total", "round"] and sorted(map(tuple, got.collect()), key=lambda r: r[2]) == want
    assert len({c for c, _, _ in want}) > 1 and len(calls) == 1
    assert sorted(map(tuple, mining.shuffled_null(sessions.limit(0), rounds=2).collect())) == [(0, 0, 0), (0, 0, 1)]
