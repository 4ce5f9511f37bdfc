"""Clicks on elements: point in rectangle by frame, with a tolerance ring and named zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import screen_zone

#: Screen sizes in the order in which they are tried.
SCREENS = ((1728, 1117), (2560, 1440), (1920, 1080), (1512, 982))
#: Parts of each axis of the screen in which points and elements meet.
CELLS = 16


def _area():
    return F.col("width_bound") * F.col("height_bound")


def _held(points: DataFrame, elements: DataFrame, pad: float) -> DataFrame:
    """points (frame_id, px and py from 0 to 1, and others) with element_id, target, role, area and bounds of elements of
    their frame that hold them within pad, but for those that are never the best: of equal rectangles, and of rectangles
    that cover a whole cell, all but the smallest, of equal areas the one of the least id.

    Both sides meet in cells of a CELLS-th of the screen. That is a power of two, so the cell of a coordinate is exact."""
    bounds = ["left_bound", "top_bound", "width_bound", "height_bound"]
    right, low = F.col("left_bound") + F.col("width_bound"), F.col("top_bound") + F.col("height_bound")
    cell = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * CELLS).cast("int")
    cells = lambda lo, hi: F.explode(F.sequence(cell(F.col(lo) - pad), cell(hi + pad)))
    e = elements.join(points.select("frame_id").distinct(), "frame_id", "left_semi").groupBy("frame_id", *bounds).agg(F.min(F.struct(F.col("id").alias("element_id"), F.col("text").alias("target"), "role")).alias("of"))
    e = e.select("frame_id", *bounds, "of.*").withColumn("cx", cells("left_bound", right)).withColumn("cy", cells("top_bound", low))
    covers = lambda lo, hi, at: (F.col(lo) <= F.col(at) / CELLS) & ((F.col(at) + 1) / CELLS <= hi)
    full = covers("left_bound", right, "cx") & covers("top_bound", low, "cy")
    e = e.groupBy("frame_id", "cx", "cy", F.when(~full, F.col("element_id")).alias("part")).agg(F.min(F.struct(_area().alias("area"), "element_id", "target", "role", *bounds)).alias("of")).select("frame_id", "cx", "cy", "of.*")
    inside = F.col("px").between(F.col("left_bound") - pad, right + pad) & F.col("py").between(F.col("top_bound") - pad, low + pad)
    return points.withColumn("cx", cell(F.col("px"))).withColumn("cy", cell(F.col("py"))).join(e, ["frame_id", "cx", "cy"]).where(inside)


def hit_test(clicks: DataFrame, elements: DataFrame, screen: tuple[int, int] = (1728, 1117), ring_px: int = 40) -> DataFrame:
    """Each click (id, frame_id, x, y) with target, role, resolution and zone.

    exact: the smallest named element of the frame that holds the point; tolerance: else the smallest within ring_px
    (of the width, on both axes); zone: else the part of the screen, if the frame has elements. A point off the screen
    or a frame without elements gives nulls. Of equal areas the least element id counts.
    """
    w, h = screen
    c = clicks.select("id", "frame_id", (F.col("x") / F.lit(float(w))).alias("px"), (F.col("y") / F.lit(float(h))).alias("py")).where("px between 0 and 1 and py between 0 and 1")
    e = elements.where("text is not null and trim(text) <> '' and width_bound > 0 and height_bound > 0")
    right, low = F.col("left_bound") + F.col("width_bound"), F.col("top_bound") + F.col("height_bound")
    exact = F.col("px").between(F.col("left_bound"), right) & F.col("py").between(F.col("top_bound"), low)
    hits = _held(c, e, ring_px / w).select("id", F.when(exact, 0).otherwise(1).alias("tier"), "area", "element_id", "target", "role", F.lit(None).cast("string").alias("zone"))
    rest = c.join(e.select("frame_id").distinct(), "frame_id", "left_semi").select("id", F.lit(2).alias("tier"), screen_zone(F.col("px"), F.col("py")).alias("zone"))
    best = hits.unionByName(rest, allowMissingColumns=True).groupBy("id").agg(F.min(F.struct("tier", "area", "element_id", "target", "role", "zone")).alias("of"))
    best = best.select("id", "of.target", "of.role", F.element_at(F.array(*map(F.lit, ("exact", "tolerance", "zone"))), F.col("of.tier") + 1).alias("resolution"), "of.zone")
    return clicks.select("id", "frame_id", "x", "y").join(best, "id", "left")


def hit_any_screen(clicks: DataFrame, elements: DataFrame, pad: float = 0.01, screens=SCREENS) -> DataFrame:
    """id, target, role: the first screen size in order under which an element (of two letters or more) holds the
    point, and of it the smallest. Four points for each click, joined on the frame and the part of the screen."""
    sizes = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h")) for i, (w, h) in enumerate(screens)])
    c = clicks.select("id", "frame_id", "x", "y", F.explode(sizes).alias("o")).select("id", "frame_id", "o.s", (F.col("x") / F.col("o.w")).alias("px"), (F.col("y") / F.col("o.h")).alias("py"))
    both = _held(c.where("px between 0 and 1 and py between 0 and 1"), elements.where("length(text) > 1"), pad)
    return both.groupBy("id").agg(F.min(F.struct("s", "area", "element_id", "target", "role")).alias("of")).select("id", "of.target", "of.role")


def hit_normalized(points: DataFrame, elements: DataFrame) -> DataFrame:
    """id, element_id, target, role: the smallest accessibility element (half of the screen at most) at a point with
    coordinates from 0 to 1."""
    e = elements.where((F.col("source") == "accessibility") & (_area() <= 0.5)).select("frame_id", F.col("id").alias("element_id"), F.col("text").alias("target"), "role", "left_bound", "top_bound", "width_bound", "height_bound")
    both = points.join(e, "frame_id").where("px between left_bound and left_bound + width_bound and py between top_bound and top_bound + height_bound")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(_area(), "element_id"))
    return both.withColumn("r", rank).where("r = 1").select("id", "element_id", "target", "role")


def with_reference(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """rows with frame_id replaced by the frame whose elements stand for it."""
    ref = frames.select(F.col("id").alias("frame_id"), F.coalesce("elements_ref_frame_id", "id").alias("ref"))
    return rows.join(ref, "frame_id", "left").withColumn("frame_id", F.coalesce("ref", "frame_id")).drop("ref")


def ocr_match(points: DataFrame, elements: DataFrame) -> DataFrame:
    """id, ocr_text of points (id, frame_id, ax_name): the OCR line of the frame that equals the name, else holds it,
    else (of three letters or more) is held by it; of equals the least element id."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    e = elements.where((F.col("source") == "ocr") & (F.trim("text") != "")).select("frame_id", F.col("id").alias("element_id"), F.col("text").alias("ocr_text"), norm("text").alias("line"))
    p = points.select("id", "frame_id", norm("ax_name").alias("name")).where("name <> ''")
    tier = F.when(F.col("line") == F.col("name"), 0).when(F.col("line").contains(F.col("name")), 1).when((F.length("line") >= 3) & F.col("name").contains(F.col("line")), 2)
    both = p.join(e, "frame_id").withColumn("tier", tier).where("tier is not null")
    return both.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("tier", "element_id"))).where("r = 1").select("id", "ocr_text")
