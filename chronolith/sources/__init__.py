"""Readers of capture tables: a declared schema each; what a source lacks becomes null or empty."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FRAMES = _schema(id=_L, timestamp=_S, app_name=_S, window_name=_S, focused=_B, browser_url=_S, document_path=_S, device_name=_S, elements_ref_frame_id=_L, accessibility_tree_json=_S, full_text=_S, capture_trigger=_S)
UI_EVENTS = _schema(id=_L, timestamp=_S, event_type=_S, x=_I, y=_I, text_content=_S, app_name=_S, window_title=_S, browser_url=_S, element_name=_S, element_role=_S, element_automation_id=_S, frame_id=_L)
ELEMENTS = _schema(id=_L, frame_id=_L, source=_S, role=_S, text=_S, left_bound=_D, top_bound=_D, width_bound=_D, height_bound=_D)
TABLES = {"frames": FRAMES, "ui_events": UI_EVENTS, "elements": ELEMENTS}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema in its order and types; absent ones are null, others are left out."""
    have = {c.lower(): c for c in df.columns}
    return df.select([(F.col(f"`{have[f.name]}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def read_capture(spark: SparkSession, path: str, name: str, window: tuple[str, str] | None = None) -> DataFrame:
    """Table name (of TABLES) of a Parquet folder or, if path is a file, of a SQLite capture; empty if there is none.
    window is a half-open range of timestamp strings, which reaches the scan; a date partition column is filtered too if
    the source has one."""
    schema = TABLES[name]
    if os.path.isfile(path):
        from .sqlite import read_table

        return conform(read_table(spark, path, name, schema, window), schema)
    try:
        df = spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    if window and "timestamp" in df.columns:
        lo, hi = window
        if "date" in df.columns:
            df = df.where((F.col("date").cast("string") >= lo[:10]) & (F.col("date").cast("string") <= hi[:10]))
        df = df.where((F.col("timestamp") >= lo) & (F.col("timestamp") < hi))
    return conform(df, schema)


class CaptureNotFound(FileNotFoundError):
    """There is no capture where one was looked for."""


#: Where a capture is looked for, and the variable that names one.
CAPTURES, CAPTURE_VARIABLE = ("~/.chronolith/db.sqlite", "~/.chronolith/data/db.sqlite", "~/.chronolith/capture"), "CHRONOLITH_DB"


def find_capture() -> str:
    """The capture that the variable names, else of CAPTURES the one that was written last."""
    named = os.environ.get(CAPTURE_VARIABLE)
    there = [p for p in map(os.path.expanduser, [named] if named else CAPTURES) if os.path.exists(p)]
    if not there:
        raise CaptureNotFound(f"${CAPTURE_VARIABLE} names no file: {named}" if named else f"no capture found; set ${CAPTURE_VARIABLE}")
    return max(there, key=os.path.getmtime)


def write_partitioned(df: DataFrame, path: str, name: str) -> None:
    """Write a capture table partitioned by UTC date, sorted within, as read_capture prunes it."""
    (df.withColumn("date", F.substring("timestamp", 1, 10)).repartition("date").sortWithinPartitions("timestamp", "id").write.mode("overwrite").partitionBy("date").parquet(f"{path.rstrip('/')}/{name}.parquet"))




def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("user_id"),
        F.col("event_type"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("value"),
    )


def frames_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized frames with one device for each user."""
    return _events(spark, sf_dir).select(
        "id", "ts_us", F.col("event_type").alias("app"), F.concat("event_type", F.lit("-"), F.col("k").cast("string")).alias("window"), F.lit(None).cast("string").alias("site"), F.col("user_id").cast("string").alias("device")
    )


def frames_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized frames with a single device."""
    return frames_by_user(spark, sf_dir).withColumn("device", F.lit(""))


def input_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized input events: half an hour after each event, by the same user."""
    kinds = F.create_map(*[F.lit(x) for p in (("purchase", "text"), ("signup", "click"), ("error", "key"), ("view", "clipboard"), ("click", "app_switch")) for x in p])
    return _events(spark, sf_dir).select(
        "id", (F.col("ts_us") + 1_800_000_000).alias("ts_us"), F.col("user_id").cast("string").alias("device"), kinds[F.col("event_type")].alias("event_type"), F.concat(F.lit("el"), F.col("k").cast("string")).alias("element_name"), F.concat(F.lit("text "), F.col("k").cast("string")).alias("text"), F.col("event_type").alias("app")
    )


def action_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each user in order: stream, ts_us, id, step (the event type and, of two kinds, a bucket of k)."""
    return _events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("stream"), "ts_us", "id", F.when(F.col("event_type").isin("click", "view"), F.concat("event_type", F.lit(":"), (F.col("k") % 2).cast("string"))).otherwise(F.concat(F.lit("["), "event_type", F.lit("]"))).alias("step")
    )
