"""The facade: an ActivityLog over capture tables, with the clock and the time zone as arguments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans, sources
from .functions import clean_name, site, ts_us
from .operators import steps, views
from .params import DEFAULT, Params

_FORM = "%Y-%m-%dT%H:%M:%S"


def day_window(day: str, tz: str) -> tuple[str, str]:
    """UTC strings of a local day, whatever its length; ValueError for what is no day."""
    start = datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=ZoneInfo(tz))
    end = datetime.combine(start.date() + timedelta(days=1), start.timetz().replace(tzinfo=None), ZoneInfo(tz))
    return tuple(t.astimezone(timezone.utc).strftime(_FORM) for t in (start, end))


def normalize_frames(raw: DataFrame) -> DataFrame:
    """Capture frames as normalized frames: rows with an app and a readable time."""
    out = raw.where("app_name is not null and app_name <> ''").select(
        "id", ts_us(F.col("timestamp")).alias("ts_us"), clean_name(F.col("app_name")).alias("app"), clean_name(F.coalesce("window_name", F.lit(""))).alias("window"), F.col("browser_url").alias("url"), site(F.col("browser_url")).alias("site"),
        F.coalesce("device_name", F.lit("")).alias("device"), F.coalesce("focused", F.lit(False)).alias("focused"), "elements_ref_frame_id",
    )
    return out.where("ts_us > 0")


def normalize_events(raw: DataFrame) -> DataFrame:
    out = raw.select(
        "id", ts_us(F.col("timestamp")).alias("ts_us"), "event_type", "x", "y", F.col("text_content").alias("text"), F.col("app_name").alias("app"), F.col("window_title").alias("window"), F.col("browser_url").alias("url"), "element_name", "element_role", "element_automation_id", "frame_id"
    )
    return out.where("ts_us > 0")


class ActivityLog:
    """Views of the capture tables in a Parquet folder. Every view but the documents is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, source: str, *, layout=None, min_minutes: float = 0.5, tz: str = "UTC", clock: Callable[[], datetime] | None = None, params: Params = DEFAULT):
        self.spark, self.source, self.layout, self.tz = spark, source, layout, tz
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self.params = replace(params, min_minutes=min_minutes, timezone=tz)

    def _trailing(self, **span) -> tuple[str, str]:
        now = self.clock().astimezone(timezone.utc)
        return (now - timedelta(**span)).strftime(_FORM), now.strftime(_FORM)

    def _day(self, day: str | None) -> tuple[str, str]:
        return day_window(day or self.clock().astimezone(ZoneInfo(self.tz)).strftime("%Y-%m-%d"), self.tz)

    def frames(self, window: tuple[str, str]) -> DataFrame:
        return normalize_frames(sources.read_capture(self.spark, self.source, "frames", window))

    def events(self, window: tuple[str, str]) -> DataFrame:
        return normalize_events(sources.read_capture(self.spark, self.source, "ui_events", window))

    def elements(self) -> DataFrame:
        return sources.read_capture(self.spark, self.source, "elements")

    def window(self, start: str, end: str, **args) -> dict:
        """The document of a window of UTC times; args as of plans.build_document (include_text, debug)."""
        events = self.events((start, end)).select("id", "ts_us", "event_type", "text")
        made = self.clock().astimezone(timezone.utc).strftime(_FORM + "Z")
        return plans.build_document(self.frames((start, end)), events, self.params, window=(start, end), generated_at=made, layout=self.layout, **args)

    def day(self, day: str | None = None, **args) -> dict:
        day = day or self.clock().astimezone(ZoneInfo(self.tz)).strftime("%Y-%m-%d")
        return self.window(*self._day(day), day=day, **args)

    def recent(self, hours: float = 2, **args) -> dict:
        return self.window(*self._trailing(hours=hours), **args)

    def context(self, hours: float = 2, max_frames: int = 40) -> str:
        return plans.context_block(self.recent(hours), max_frames)

    def day_context(self, day: str | None = None, max_frames: int = 40) -> str:
        return plans.context_block(self.day(day), max_frames)

    def apps(self, day: str | None = None) -> DataFrame:
        return views.app_ledger(self.frames(self._day(day)), self.params).orderBy(F.desc("active_us"), "app")

    def patterns(self, days: int = 7, include_text: bool = False) -> DataFrame:
        w = self._trailing(days=days)
        return views.patterns(self.frames(w), self.events(w), include_text)

    def communications(self, hours: float = 24, day: str | None = None, kinds=None) -> DataFrame:
        return views.comm_surfaces(self.frames(self._day(day) if day else self._trailing(hours=hours)), kinds)

    def enriched(self, start: str, end: str, *, include_text: bool = False, screen=(1728, 1117)) -> DataFrame:
        w = (start, end)
        frames = self.frames(w).withColumn("device", F.lit(""))
        return steps.enrich(self.events(w).withColumn("device", F.lit("")), frames, self.elements(), layout=self.layout, include_text=include_text, screen=screen)

    def _steps(self, w: tuple[str, str], doc: dict, **args) -> tuple[DataFrame, DataFrame]:
        rows = [(f["id"], f["app"], *map(int, f["evidence"]["frame_ids"].split(".."))) for f in doc["frames"]]
        ranges = self.spark.createDataFrame(rows, "key string, app string, first_id long, last_id long")
        frames = self.frames(w)
        spans = steps.evidence_windows(ranges, frames)
        return steps.steps(spans, self.events(w), self.elements(), frames, tz=self.tz, **args), spans

    def steps(self, frame: str, day: str | None = None, hours: float = 3, *, include_text: bool = True, max_steps: int = 250) -> dict:
        """The script of one entry of a document, or an error with the ids that there are."""
        w = self._day(day) if day else self._trailing(hours=hours)
        doc = self.window(*w)
        entry = next((f for f in doc["frames"] if f["id"] == frame), None)
        if entry is None:
            return {"error": f"no entry {frame}", "available": [f["id"] for f in doc["frames"][:40]], "hint": "ids change with the window and min_minutes"}
        found, _ = self._steps(w, {"frames": [entry]}, include_text=include_text, max_steps=max_steps + 1)
        rows = [r.asDict() for r in found.orderBy("n").collect()]
        keep = [{k: v for k, v in r.items() if v is not None and k not in ("key", "event_id", "resolved")} for r in rows[:max_steps]]
        return {"frame": frame, "app": entry["app"], "steps": keep, "unresolved": sum(not r["resolved"] for r in rows[:max_steps]), "truncated": len(rows) > max_steps}

    def find(self, query: str, day: str | None = None, hours: float = 3, max_steps: int = 250) -> dict:
        """The last entry that shows what a query asks for."""
        if not steps.query_groups(query):
            return {"error": "the query has only stop words", "query": query}
        w = self._day(day) if day else self._trailing(hours=hours)
        doc = self.window(*w)
        if not doc["frames"]:
            return {"error": "no match", "query": query}
        every, spans = self._steps(w, doc, include_text=False, max_steps=max_steps)
        best = steps.find(every, spans, query).limit(1).collect()
        return {"frame": best[0]["key"], **{k: best[0][k] for k in ("score", "task_clicks", "from_url")}} if best else {"error": "no match", "query": query}

    def freshness_seconds(self) -> float | None:
        """Age of the newest frame."""
        row = sources.read_capture(self.spark, self.source, "frames").agg(F.max(ts_us(F.col("timestamp"))).alias("t")).first()
        return None if row["t"] is None else self.clock().timestamp() - row["t"] / 1e6
