"""Mining of coded and of equal paths against Python, and the size of its plans."""

import random
from collections import Counter

import pytest

from chronolith.operators import mining

SESSION = "session string, start_us long, path array<string>"


@pytest.mark.parametrize("kinds,codes", [(5, 1 << 16), (400, 1 << 16), (5, 3)])
def test_any_number_of_steps_and_equal_paths(spark, monkeypatch, kinds, codes):
    """Steps of one byte, of two, and too many for numbers; paths that many sessions have."""
    monkeypatch.setattr(mining, "CODES", codes)
    rng = random.Random(kinds)
    some = [[f"é{rng.randrange(kinds)}" for _ in range(rng.randrange(3, 40))] for _ in range(12)]
    rows = [(f"s{i:03}", rng.randrange(3) * 7_200_000_000, rng.choice(some)) for i in range(60)]
    s = spark.createDataFrame(rows, SESSION)
    count, first = Counter(), {}
    for session, start, p in rows:
        for n in range(3, 41):
            for i in range(len(p) - n + 1):
                gram = tuple(p[i : i + n])
                count[gram] += 1
                first[gram] = min(first.get(gram, (start, session, i + 1)), (start, session, i + 1))
    want = {g: (c, first[g]) for g, c in count.items() if c >= 5}
    grams = mining.frequent_ngrams(s, least=5)
    assert {tuple(r["gram"]): (r["cnt"], tuple(r["first"])) for r in grams.collect()} == want
    inside = {(session, j) for session, _, p in rows for g in want for i in range(len(p) - len(g) + 1) if tuple(p[i : i + len(g)]) == g for j in range(i, i + len(g))}
    assert mining.coverage_h(s, grams).first()["covered"] == len(inside)
    other = spark.createDataFrame([("t", 0, ["unknown", *some[0], "unknown"])], SESSION)
    assert mining.coverage_h(other, grams).first()["covered"] == len({j for g in want for i in range(len(some[0]) - len(g) + 1) if tuple(some[0][i : i + len(g)]) == g for j in range(i, i + len(g))})


def test_coverage_is_one_join_for_all_lengths(spark):
    """The driver holds one join, not one for each length."""
    path = [f"view:{i}" for i in range(30)]
    s = spark.createDataFrame([(f"s{i}", i, path) for i in range(4)], SESSION)
    grams = mining.frequent_ngrams(s)
    plan = mining.coverage_h(s, grams)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 1 and grams.select("n").distinct().count() == 28
