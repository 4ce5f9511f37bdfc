"""The registered activity queries against DuckDB, a stream against a table, and mining against Python."""

import math
import os
import random
from collections import Counter

import duckdb
import pytest

from chronolith import queries
from chronolith.operators import mining, spatial
from chronolith.streaming import blocks

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else float(f"{v:.10g}") if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", ["segments_merged", "interruptions", "app_ledger", "input_asof", "device_arbitration", "nearest_frame", "url_typing", "comm_surfaces", "patterns_all", "maximal_ngrams", "ngram_coverage", "click_hit_test", "click_any_screen", "steps_script", "find_frame", "enriched_events", "nearest_with_tolerance", "three_arm_cost", "determinism_fingerprint", "routine_plans", "typed_urls"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(dict(zip(names, x))[c]) for c in cols) for x in r.fetchall()), key=repr)


def test_every_sql_has_a_query():
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_mining_equals_python(spark):
    rng = random.Random(2)
    paths = [[rng.choice("abcd") for _ in range(rng.randrange(3, 30))] for _ in range(40)]
    s = spark.createDataFrame([(str(i), i, p) for i, p in enumerate(paths)], "session string, start_us long, path array<string>")
    count = Counter(tuple(p[i : i + n]) for p in paths for n in range(3, 13) for i in range(len(p) - n + 1))
    want = {g: c for g, c in count.items() if c >= 3}
    grams = mining.frequent_ngrams(s, longest=12)
    assert {tuple(r["gram"]): r["cnt"] for r in grams.collect()} == want
    top = {g for g, c in want.items() if not any(c == d and len(h) > len(g) and " -> ".join(g) in " -> ".join(h) for h, d in want.items())}
    assert {tuple(r["gram"]) for r in mining.maximal(grams).collect()} == top
    inside = {(i, j) for i, p in enumerate(paths) for g in want for k in range(len(p) - len(g) + 1) if tuple(p[k : k + len(g)]) == g for j in range(k, k + len(g))}
    assert mining.coverage_h(s, grams).first()["covered"] == len(inside)
    assert 0.5 < mining.fano_bound(1.0, 8) < 1


def test_hit_by_ring_and_zone(spark):
    e = spark.createDataFrame([(1, 5, "accessibility", "AXButton", "Message", 0.45, 0.45, 0.1, 0.1)], "id long, frame_id long, source string, role string, text string, left_bound double, top_bound double, width_bound double, height_bound double")
    c = spark.createDataFrame([(1, 5, 864, 558), (2, 5, 970, 558), (3, 5, 10, 600), (4, 6, 864, 558)], "id long, frame_id long, x int, y int")
    assert {r["id"]: (r["resolution"], r["target"] or r["zone"]) for r in spatial.hit_test(c, e).collect()} == {1: ("exact", "Message"), 2: ("tolerance", "Message"), 3: ("zone", "left sidebar"), 4: (None, None)}


def test_stream_equals_table(spark, tmp_path):
    rows = [(i, t * 1_000_000, "A", "d") for i, t in enumerate([0, 100, 400, 701, 5000, 5300])]
    schema = "id long, ts_us long, app string, device string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = blocks(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 300, "1 hour")
    q = stream.writeStream.format("memory").queryName("blocks_test").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("blocks_test").collect())) == sorted(map(tuple, blocks(table, 300).collect()))
    assert table.count() == 6 and blocks(table, 300).count() == 3
