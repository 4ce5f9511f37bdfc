"""The temporal kernel: gaps and islands, the flicker fold, as-of and nearest joins.

No window is over a device or a session: rows are ordered in buckets of an hour of a device, runs in buckets of a fixed
number of runs, and what a bucket needs of those before and after it is carried over by a table of one row for each
bucket. So a stream that never pauses is as many tasks as it has hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params

HOUR = 3_600_000_000
#: Lengths of the buckets in which spans meet times; each divides the next.
UNITS = (1, 1_000, 1_000_000, 60_000_000, HOUR)
#: Runs in a bucket of the flicker fold.
RUNS = 4096


def _hour(ts: str = "ts_us"):
    return F.floor(F.col(ts) / HOUR).cast("long")


def raw_frames(frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """frames with previous (ts_us of the row before on the device, null on the first), block (from 0, up by one after
    each gap longer than the session gap), dwell (the gap to the next row, at most the cap, 0 over a session gap or at
    the end), capped (the cap took something) and seg: the number on its device, from 1, of the run of one app and site
    in one block that a row belongs to. Ties in ts_us go by id."""
    gap = p.session_gap
    w = Window.partitionBy("device", "hour").orderBy("ts_us", "id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    row = F.struct("ts_us", "id", "app", "site")
    breaks = lambda now, old: now["ts_us"] - old["ts_us"] > gap
    turns = lambda now, old: breaks(now, old) | ~now["app"].eqNullSafe(old["app"]) | ~now["site"].eqNullSafe(old["site"])
    count = lambda flag: F.when(F.coalesce(flag, F.lit(False)), 1).otherwise(0)
    rows = frames.withColumn("hour", _hour()).withColumn("row", row).withColumn("old", F.lag("row").over(w)).withColumn("next", F.lead("ts_us").over(w))
    rows = rows.withColumn("b", F.sum(count(breaks(F.col("row"), F.col("old")))).over(so_far)).withColumn("t", F.sum(count(F.col("old").isNotNull() & turns(F.col("row"), F.col("old")))).over(so_far))
    hours = rows.groupBy("device", "hour").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.max("b").alias("bs"), F.max("t").alias("ts"))
    d = Window.partitionBy("device").orderBy("hour")
    hours = hours.withColumn("before", F.lag("last").over(d)).withColumn("after", F.lead("first.ts_us").over(d))
    hours = hours.withColumn("b0", count(breaks(F.col("first"), F.col("before")))).withColumn("t0", F.when(F.col("before").isNull(), 1).otherwise(count(turns(F.col("first"), F.col("before")))))
    past = d.rowsBetween(Window.unboundedPreceding, 0)
    hours = hours.select("device", "hour", F.col("before.ts_us").alias("before"), "after", (F.sum(F.col("b0") + F.col("bs")).over(past) - F.col("bs")).alias("b0"), (F.sum(F.col("t0") + F.col("ts")).over(past) - F.col("ts")).alias("t0"))
    rows = rows.join(hours, ["device", "hour"]).withColumn("wait", F.coalesce("next", "after") - F.col("ts_us"))
    dwell = F.when(F.col("wait") <= gap, F.least("wait", F.lit(p.dwell_cap))).otherwise(0)
    return rows.select(
        *frames.columns, F.coalesce("old.ts_us", "before").alias("previous"), (F.col("b0") + F.col("b")).alias("block"), dwell.alias("dwell"),
        F.coalesce((F.col("wait") <= gap) & (F.col("wait") > p.dwell_cap), F.lit(False)).alias("capped"), (F.col("t0") + F.col("t")).alias("seg"),
    )


def block_split(frames: DataFrame, gap: int) -> DataFrame:
    """frames with previous and block, as in raw_frames."""
    rows = frames
    for c in ("app", "site"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    return raw_frames(rows, Params(session_gap=gap)).select(*frames.columns, "previous", "block")


def raw_segments(frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row for each run: device, block, seg, app, site, start_us, end_us, active_us, n_frames, first_id, last_id,
    capped, break_reason (start, context_switch, or session_gap with the seconds before it)."""
    return _runs_of(raw_frames(frames, p), p)


def _runs_of(rows: DataFrame, p: Params, *keep: str) -> DataFrame:
    out = rows.groupBy("device", "block", "seg", *keep).agg(
        F.min("app").alias("app"), F.min("site").alias("site"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.sum("dwell").alias("active_us"), F.count("*").alias("n_frames"),
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.bool_or("capped").alias("capped"), F.min_by("previous", F.struct("ts_us", "id")).alias("previous"),
    )
    gap = F.expr("(start_us - previous) div 1000000").cast("string")
    reason = F.when(F.col("previous").isNull(), "start").when(F.col("start_us") - F.col("previous") <= p.session_gap, "context_switch").otherwise(F.concat(F.lit("session_gap: "), gap, F.lit(f"s > {p.session_gap // 1_000_000}s")))
    return out.withColumn("break_reason", reason).drop("previous")


def _with_neighbours(runs: DataFrame, before: int, after: int) -> DataFrame:
    """runs with bucket, and copies (own is false) of the last runs of a bucket in the next one, of the first in the one before."""
    bucket, at = F.floor(F.col("seg") / RUNS), F.col("seg") % RUNS
    place = lambda shift, own, when: F.when(when, F.struct((bucket + shift).cast("long").alias("bucket"), F.lit(own).alias("own")))
    places = F.array_compact(F.array(place(0, True, F.lit(True)), place(1, False, at >= RUNS - before), place(-1, False, at < after)))
    return runs.withColumn("place", F.explode(places)).select("*", "place.*").drop("place")


def fold_flicker(raw: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """raw_segments with swallowed (a short visit between two runs of one app and site) and merged (the number on its
    device of the segment it belongs to).

    A run may be folded if it lasts merge_flicker at most and the runs around it, in its block, have the same app and
    site. In a chain of such runs every other one is swallowed, which is the parity of their number so far.
    """
    if p.merge_flicker <= 0:
        return raw.withColumn("swallowed", F.lit(False)).withColumn("merged", F.col("seg"))
    w = Window.partitionBy("device", "bucket").orderBy("seg")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    lead = lambda c, n: F.lead(c, n).over(w)
    ext = (
        (lead("end_us", 1) - lead("start_us", 1) <= p.merge_flicker) & (lead("block", 2) == F.col("block"))
        & F.col("app").eqNullSafe(lead("app", 2)) & F.col("site").eqNullSafe(lead("site", 2))
    )
    runs = _with_neighbours(raw, 2, 2).withColumn("ext", F.coalesce(ext, F.lit(False)))
    # the last run before a bucket and its copies that is not ext: of the bucket before without its last two, and of those before it
    solid = F.when(~F.col("ext"), F.col("seg"))
    of = runs.where("own").groupBy("device", "bucket").agg(F.max(solid).alias("whole"), F.max(F.when(F.col("seg") % RUNS < RUNS - 2, solid)).alias("short"))
    d = Window.partitionBy("device").orderBy("bucket")
    of = of.select("device", "bucket", F.greatest(F.lag("short").over(d), F.max("whole").over(d.rowsBetween(Window.unboundedPreceding, -2)), F.lit(0)).alias("carried"))
    runs = runs.join(of, ["device", "bucket"])
    runs = runs.withColumn("run", F.when(F.col("ext"), F.col("seg") - F.greatest(F.max(solid).over(so_far), "carried")).otherwise(0))
    odd = lambda n: F.coalesce(F.lag("run", n).over(w) % 2 == 1, F.lit(False))
    runs = runs.withColumn("swallowed", odd(1)).withColumn("head", F.when(F.col("own") & ~F.col("swallowed") & ~odd(2), 1).otherwise(0))
    heads = runs.groupBy("device", "bucket").agg(F.sum("head").alias("heads"))
    heads = heads.select("device", "bucket", F.coalesce(F.sum("heads").over(d.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    runs = runs.join(heads, ["device", "bucket"]).withColumn("merged", F.sum("head").over(so_far) + F.col("before"))
    return runs.where("own").drop("own", "bucket", "ext", "carried", "run", "head", "before")


def segments(frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Merged segments: device, block, merged, app, site, start_us, end_us, active_us, n_frames, first_id, last_id,
    capped, break_reason and interruptions (array of app, site, microseconds, in order)."""
    return _merged(fold_flicker(raw_segments(frames, p), p))


def segments_of(own: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The segments of framed() rows, without working out the runs again."""
    return _merged(_runs_of(own, p, "swallowed", "merged"))


def _merged(rows: DataFrame) -> DataFrame:
    own = ~F.col("swallowed")
    took = F.coalesce(F.nullif("active_us", F.lit(0)), F.nullif(F.col("end_us") - F.col("start_us"), F.lit(0)), F.lit(1_000_000))
    host = lambda f, c: f(F.when(own, F.col(c))).alias(c)
    out = rows.groupBy("device", "block", "merged").agg(
        host(F.min, "app"), host(F.min, "site"), host(F.min, "start_us"), host(F.max, "end_us"), host(F.sum, "active_us"), host(F.sum, "n_frames"), host(F.min, "first_id"), host(F.max, "last_id"),
        host(F.bool_or, "capped"), F.min_by("break_reason", "seg").alias("break_reason"),
        F.sort_array(F.collect_list(F.when(~own, F.struct("seg", "app", "site", took.alias("us"))))).alias("interruptions"),
    )
    return out.withColumn("interruptions", F.transform("interruptions", lambda x: F.struct(x["app"].alias("app"), x["site"].alias("site"), x["us"].alias("us"))))


def framed(frames: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """raw_frames with swallowed and merged of the run of each row."""
    own = fold_flicker(raw_segments(frames, p), p).select("device", "block", "seg", "swallowed", "merged")
    return raw_frames(frames, p).join(own, ["device", "block", "seg"])


def asof_contained(events: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    """Each event (device, ts_us, id) with columns (as struct span) of the latest span of the device that starts no
    later (of equal starts the greatest by columns), if that has not ended; other events are dropped. Spans are dealt to the hours they touch."""
    hours = F.sequence(_hour("start_us"), _hour("end_us"))
    s = spans.select("device", F.explode(hours).alias("hour"), "start_us", F.struct("start_us", "end_us", *columns).alias("span"))
    s = s.select("device", "hour", F.greatest("start_us", F.col("hour") * HOUR).alias("ts_us"), F.lit(0).alias("kind"), "span", F.lit(None).cast(events.schema).alias("event"))
    e = events.select("device", _hour().alias("hour"), "ts_us", F.lit(1).alias("kind"), F.lit(None).cast(s.schema["span"].dataType).alias("span"), F.struct(*events.columns).alias("event"))
    w = Window.partitionBy("device", "hour").orderBy("ts_us", "kind", "span").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(e).withColumn("span", F.last("span", ignorenulls=True).over(w)).where("kind = 1")
    return both.where(F.col("span.end_us") >= F.col("ts_us")).select("event.*", "span")


def nearest(events: DataFrame, frames: DataFrame, columns: list[str]) -> DataFrame:
    """Each event (device, ts_us, id) with frame (struct of ts_us, id and columns) nearest in time on its device, of
    equally near ones the earlier; null if the device has no frame. Hours are joined at their edges."""
    f = frames.select("device", _hour().alias("hour"), F.struct("ts_us", "id", *columns).alias("frame"))
    of_hour = f.groupBy("device", "hour").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    hours = of_hour.unionByName(events.select("device", _hour().alias("hour")).distinct(), allowMissingColumns=True).groupBy("device", "hour").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    d = Window.partitionBy("device").orderBy("hour")
    hours = hours.select(
        "device", "hour", F.last("hi", ignorenulls=True).over(d.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.last("lo", ignorenulls=True).over(Window.partitionBy("device").orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)).alias("after")
    )
    kind = f.schema["frame"].dataType
    e = events.select("device", _hour().alias("hour"), "ts_us", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("frame"), F.struct(*events.columns).alias("event"))
    p = f.select("device", "hour", F.col("frame.ts_us").alias("ts_us"), F.lit(0).alias("kind"), "frame", F.lit(None).cast(e.schema["event"].dataType).alias("event"))
    # both ways from the start of an order: Spark reads a frame that ends at the end of a partition anew for each row
    w = Window.partitionBy("device", "hour")
    so_far = lambda *order: F.last("frame", ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = p.unionByName(e).withColumn("back", so_far("ts_us", "kind", "frame")).withColumn("ahead", so_far(F.desc("ts_us"), F.desc("kind"), F.desc("frame")))
    both = both.where("kind = 1").join(hours, ["device", "hour"])
    back, ahead = F.coalesce("back", "before"), F.coalesce("ahead", "after")
    both = both.select("event", back.alias("back"), ahead.alias("ahead"))
    pick = F.when(F.col("back").isNull(), F.col("ahead")).when(F.col("ahead").isNull(), F.col("back")).when(F.col("event.ts_us") - F.col("back.ts_us") <= F.col("ahead.ts_us") - F.col("event.ts_us"), F.col("back")).otherwise(F.col("ahead"))
    return both.select("event.*", pick.alias("frame"))


def first_holding(times: DataFrame, spans: DataFrame) -> DataFrame:
    """ts_us of times with span, the least (column span of spans) of those with ts_us from start_us to end_us; other
    times are dropped.

    A span is dealt to buckets of the greatest unit that parts its ends: in the last of them it holds the times up to
    its end, in those before it the times from its start or the bucket's. So the least span is a running minimum from
    either side of a bucket, and spans that start or end at once there are one row."""
    of = lambda c, unit: F.col(c) - F.pmod(c, unit)
    unit = F.coalesce(*[F.when(of("start_us", F.lit(u)) != of("end_us", F.lit(u)), u) for u in reversed(UNITS)], F.lit(UNITS[0])).cast("long")
    s = spans.where("start_us <= end_us").select("start_us", "end_us", "span", unit.alias("unit"))
    lo, hi = of("start_us", F.col("unit")), of("end_us", F.col("unit"))
    first = s.select("unit", F.explode(F.sequence(lo, F.greatest(lo, hi - F.col("unit")), F.col("unit"))).alias("bucket"), "start_us", "span").select("unit", "bucket", F.greatest("start_us", "bucket").alias("at"), F.lit(0).alias("kind"), "span")
    last = s.where("start_us < end_us").select("unit", hi.alias("bucket"), F.col("end_us").alias("at"), F.lit(1).alias("kind"), "span")
    marks = first.union(last).groupBy("unit", "bucket", "at", "kind").agg(F.min("span").alias("span"))
    t = times.select("ts_us").distinct().withColumn("unit", F.explode(F.array(*[F.lit(u).cast("long") for u in UNITS])))
    t = t.select("unit", of("ts_us", F.col("unit")).alias("bucket"), F.col("ts_us").alias("at"), F.lit(2).alias("kind"), F.lit(None).cast(marks.schema["span"].dataType).alias("span"))
    w = Window.partitionBy("unit", "bucket")
    so_far = lambda kind, *order: F.min(F.when(F.col("kind") == kind, F.col("span"))).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = marks.union(t).withColumn("from", so_far(0, "at", "kind")).withColumn("to", so_far(1, F.desc("at"), "kind"))
    return both.where("kind = 2").groupBy(F.col("at").alias("ts_us")).agg(F.min(F.least("from", "to")).alias("span")).where("span is not null")
