"""Points on elements against a loop over all pairs."""

import random

from chronolith.operators import spatial

ELEMENT = "id long, frame_id long, source string, role string, text string, left_bound double, top_bound double, width_bound double, height_bound double"
W, H = 1728, 1117


def tables(seed):
    """Rectangles of several sizes, many equal, some off the screen or without bounds; points on edges, corners and off the screen."""
    rng = random.Random(seed)
    rects = [(rng.randrange(-2, 17) / 16, rng.randrange(-2, 17) / 16, rng.choice([0.05, 0.125, 0.5, 1.3]), rng.choice([0.03, 0.125, 0.5, 1.3])) for _ in range(25)] + [(rng.random(), rng.random(), 0.2, 0.2) for _ in range(25)]
    elements = [(i, i % 3, "accessibility", f"r{i % 2}", rng.choice(["", "x", "name", f"el{i}"]), *rng.choice(rects)) for i in range(200)] + [(200, 0, "accessibility", None, "none", None, 0.1, 0.1, 0.1), (201, 4, "accessibility", "r", "wide", -1.0, -1.0, -0.5, 9.0)]
    points = [(i, i % 5, rng.choice([rng.randrange(-5, 1900), 0, W, W // 2]), rng.choice([rng.randrange(-5, 1300), 0, H])) for i in range(300)]
    return elements, points


def holds(e, px, py, pad):
    _, _, _, _, _, x, y, w, h = e
    return x is not None and x - pad <= px <= x + w + pad and y - pad <= py <= y + h + pad


def test_hits_equal_all_pairs(spark):
    elements, points = tables(5)
    e, c = spark.createDataFrame(elements, ELEMENT), spark.createDataFrame(points, "id long, frame_id long, x int, y int")
    want, first = {}, {}
    for i, frame, x, y in points:
        for s, (w, h) in enumerate(spatial.SCREENS):
            inside = [(s, o[7] * o[8], o[0]) for o in elements if o[1] == frame and len(o[4]) > 1 and 0 <= x / w <= 1 and 0 <= y / h <= 1 and holds(o, x / w, y / h, 0.01)]
            if inside and i not in first:
                first[i] = elements[min(inside)[2]][4]
        px, py, named = x / W, y / H, [o for o in elements if o[1] == frame and o[4].strip() and o[7] > 0 and o[8] > 0]
        want[i] = (None, None)
        if named and 0 <= px <= 1 and 0 <= py <= 1:
            tier, _, best = min((0 if holds(o, px, py, 0) else 1 if holds(o, px, py, 40 / W) else 2, o[7] * o[8], o[0]) for o in named)
            want[i] = (("exact", "tolerance", "zone")[tier], elements[best][4] if tier < 2 else None)
    got = spatial.hit_test(c, e).collect()
    assert {r["id"]: (r["resolution"], r["target"]) for r in got} == want and len(got) == len(points)
    assert {r["id"]: r["target"] for r in spatial.hit_any_screen(c, e).collect()} == first
    assert {k for k, _ in want.values()} == {"exact", "tolerance", "zone", None} and len(first) > 50


def test_equal_and_covering_elements_meet_a_point_once(spark):
    """So that a frame with many elements in few places costs no more than those places."""
    one = "accessibility", "Button", "name"
    e = spark.createDataFrame([(i, 1, *one, 0.4, 0.4, 0.01, 0.01) for i in range(400)] + [(i, 1, *one, 0.0, 0.0, 1.0 + i / 1000, 1.2) for i in range(400, 800)], ELEMENT)
    points = spark.createDataFrame([(i, 1, 0.405, 0.405) for i in range(50)], "id long, frame_id long, px double, py double")
    assert sorted(r["element_id"] for r in spatial._held(points, e, 0.01).where("id = 7").collect()) == [0, 400]
