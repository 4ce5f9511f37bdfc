"""The activity document: segments, coverage, input, pages and windows assembled into one row, and its text forms."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import views
from ..operators.temporal import framed, segments_of
from ..params import DEFAULT, Params

SCHEMA_VERSION = 1
#: What a document cannot show.
BLIND_SPOTS = [
    "Browser URLs are captured only for browser apps; native-app context comes from window titles.",
    "Time is attributed from event-driven frame capture, not a stopwatch; per-frame credit is capped.",
    "Click labels resolve only when the click lands on a recorded element; unresolved clicks are counted, not named.",
    "Activity on non-primary monitors may have reduced element resolution.",
    "Monitors are sessionized as separate streams; the same app visible on two monitors at once earns time on both.",
    "Audio (meetings, calls) is recorded by the engine when enabled but not yet compiled into frames.",
]


def document_rows(frames: DataFrame, events: DataFrame | None, p: Params = DEFAULT, *, include_text: bool = False, layout=None, own: DataFrame | None = None) -> DataFrame:
    """One row for each merged segment with all that its document entry needs; durations stay in microseconds. own:
    framed(frames, p) if it is at hand."""
    keys = ["device", "block", "merged"]
    own = framed(frames, p) if own is None else own
    out = segments_of(own, p)
    tops = views.segment_windows(frames, p, own=own).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "window"))), lambda x: x["window"]).alias("windows"))
    out = out.join(tops, keys, "left")
    if "url" in frames.columns:
        pages = views.segment_pages(frames, p, own=own).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "kind", "entity", "n"))).alias("pages"))
        out = out.join(pages, keys, "left")
    else:
        out = out.withColumn("pages", F.expr("CAST(NULL AS array<struct<place:int,kind:string,entity:string,n:bigint>>)"))
    if events is not None:
        out = out.join(views.input_stats(events, frames, p, own, include_text=include_text, layout=layout), keys, "left")
    else:
        out = out.withColumn("keys", F.lit(None)).withColumn("clicks", F.lit(None)).withColumn("copies", F.lit(None))
    return out if "texts" in out.columns else out.withColumn("texts", F.lit(None).cast("array<string>"))


def clock(us: int | None, tz: str, form: str = "%H:%M") -> str:
    """Local time of microseconds, "?" where there is none."""
    return "?" if us is None or us <= 0 else datetime.fromtimestamp(us // 1_000_000, timezone.utc).astimezone(ZoneInfo(tz)).strftime(form)


def _iso(us: int | None) -> str | None:
    return None if us is None else datetime.fromtimestamp(us // 1_000_000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")


def _minutes(us: int) -> float:
    return round(us / 60e6, 1)


def _entry(r, number: int, tz: str) -> dict:
    """One entry of a document; what is empty is left out."""
    wall, active = _minutes(r["end_us"] - r["start_us"]), _minutes(r["active_us"])
    given = {k: r[k] for k in ("keys", "clicks", "copies") if r[k]} | ({"text": list(r["texts"])} if r["texts"] else {})
    folded = [{"app": i["app"], **({"site": i["site"]} if i["site"] is not None else {}), "seconds": round(i["us"] / 1e6, 1)} for i in r["interruptions"]]
    pages = [{"kind": x["kind"], **({"entity": x["entity"]} if x["entity"] is not None else {}), **({"count": x["n"]} if x["n"] > 1 else {})} for x in r["pages"] or []]
    parts = {
        "id": f"f-{number:04d}", "app": r["app"], "site": r["site"] or None, "start": clock(r["start_us"], tz, "%H:%M:%S"), "end": clock(r["end_us"], tz, "%H:%M:%S"), "duration_min": active,
        "wall_min": wall if abs(wall - active) > 1 else None, "windows": list(r["windows"] or []) or None, "pages": pages or None, "input": given or None, "interruptions": folded or None,
        "evidence": {"frame_ids": f"{r['first_id']}..{r['last_id']}"},
    }
    return {k: v for k, v in parts.items() if v is not None}


def build_document(
    frames: DataFrame, events: DataFrame | None = None, p: Params = DEFAULT, *, window: tuple[str, str] | None = None, generated_at: str | None = None,
    day: str | None = None, include_text: bool = False, layout=None, debug: bool = False, recorder: str = "capture",
) -> dict:
    """The document of a window of frames as a dict, in local times of p.timezone. Only here, at the edge, are numbers
    rounded (as Python rounds) and the rows, one for each segment of the window, brought to the driver."""
    tz = p.timezone
    own = framed(frames, p).persist()
    try:
        rows = sorted(document_rows(frames, events, p, include_text=include_text, layout=layout, own=own).collect(), key=lambda r: (r["start_us"], r["device"], r["block"], r["merged"]))
        cover = views.coverage(own).first()
        gaps = sorted(views.coverage_gaps(own.select(*frames.columns), p).collect(), key=lambda r: r["start_us"])
    finally:
        own.unpersist()
    shown = [r for r in rows if _minutes(r["active_us"]) >= p.min_minutes]
    omitted = len(rows) - len(shown)
    window = window or (_iso(cover["first_us"]), _iso(cover["last_us"]))
    doc = {
        "schema_version": SCHEMA_VERSION,
        "generated_at": generated_at,
        "source": {"recorder": recorder},
        "window": {"start_utc": window[0], "end_utc": window[1], **({"day": day} if day else {})},
        "coverage": {
            "first_activity": clock(cover["first_us"], tz), "last_activity": clock(cover["last_us"], tz), "active_minutes": cover["active_minutes"] or 0, "span_minutes": cover["span_minutes"] or 0, "coverage_pct": cover["coverage_pct"] or 0,
            "frames_analyzed": cover["frames_analyzed"], "distinct_apps": cover["distinct_apps"], "gaps": [{"start": clock(g["start_us"], tz), "end": clock(g["end_us"], tz), "minutes": g["minutes"]} for g in gaps if g["minutes"] >= 5],
        },
        "frames": [_entry(r, i, tz) for i, r in enumerate(shown, 1)],
        "blind_spots": BLIND_SPOTS,
    }
    if omitted:
        doc["omitted"] = {"below_min_minutes": omitted, "min_minutes": p.min_minutes}
    if debug and shown:
        doc["_debug"] = {"sessionization": {f"f-{i:04d}": r["break_reason"] for i, r in enumerate(shown, 1) if r["break_reason"]}}
    return doc


def to_json(doc: dict) -> str:
    return json.dumps(doc, indent=2, ensure_ascii=False)


def to_yaml(doc: dict) -> str:
    """YAML if the library is there, else JSON."""
    try:
        import yaml
    except ImportError:
        return to_json(doc)
    return yaml.safe_dump(doc, sort_keys=False, allow_unicode=True)


def _day(doc: dict) -> str:
    return doc["window"].get("day") or (doc["window"]["start_utc"] or "")[:10]


def _place(f: dict, form: str) -> str:
    return f["app"] + (form.format(f["site"]) if f.get("site") else "")


def to_markdown(doc: dict) -> str:
    c = doc["coverage"]
    out = [
        f"# Activity {_day(doc)}", "",
        f"**Coverage:** {c['first_activity']} to {c['last_activity']} local, {c['active_minutes']} active min across {c['distinct_apps']} apps ({c['coverage_pct']}% of span)", "",
        "| # | Time | App / Site | Active | What was on screen |", "|---|------|-----------|--------|--------------------|",
    ]
    for f in doc["frames"]:
        pages = [": ".join(filter(None, (x["kind"], x.get("entity")))) for x in f.get("pages", [])[:3]]
        out.append(f"| {f['id']} | {f['start'][:5]}-{f['end'][:5]} | {_place(f, ' ({})')} | {f['duration_min']}m | {'; '.join(pages or f.get('windows', [])[:2])} |")
    if c["gaps"]:
        out += ["", "**Away:** " + ", ".join(f"{g['start']}-{g['end']} ({g['minutes']}m)" for g in c["gaps"])]
    return "\n".join(out)


def context_block(doc: dict, max_frames: int = 40) -> str:
    """Plain lines for a prompt with a budget: the longest max_frames entries, in order of time."""
    c, entries = doc["coverage"], list(enumerate(doc["frames"]))
    kept = sorted(sorted(entries, key=lambda x: (-x[1]["duration_min"], x[0]))[:max_frames])
    out = [f"USER ACTIVITY ({_day(doc)}, local time; measured from screen capture, no interpretation):", f"coverage: {c['first_activity']}-{c['last_activity']}, {c['active_minutes']} active min, {c['distinct_apps']} apps"]
    out += [f"away: {g['start']}-{g['end']} ({g['minutes']}m)" for g in c["gaps"]]
    for _, f in kept:
        bits = [":".join(filter(None, (x["kind"], x.get("entity")))) + (f" x{x['count']}" if x.get("count") else "") for x in f.get("pages", [])[:4]]
        bits = bits or [w[:60] for w in f.get("windows", [])[:1]]
        keys = f.get("input", {}).get("keys", 0)
        bits += [f"typed ~{keys} chars"] * (keys > 50)
        out.append(f"- {f['start'][:5]}-{f['end'][:5]} {_place(f, '/{}')} ({f['duration_min']}m): {'; '.join(bits) or 'on screen'}")
    if len(entries) > len(kept):
        out.append(f"(+{len(entries) - len(kept)} frames over the size budget omitted)")
    if "omitted" in doc:
        out.append(f"(+{doc['omitted']['below_min_minutes']} brief frames under {doc['omitted']['min_minutes']} min omitted)")
    return "\n".join(out)


def context_rows(segs: DataFrame, max_rows: int = 40) -> DataFrame:
    """The longest max_rows segments with place, their order in time; for bulk output without a driver loop."""
    top = segs.orderBy(F.desc("active_us"), "start_us", "first_id").limit(max_rows)
    return top.withColumn("place", F.row_number().over(Window.orderBy("start_us", "first_id")))
