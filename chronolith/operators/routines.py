"""Routines as plans: the most repeated maximal n-grams, each compiled from its first occurrence into guarded actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens, url_template
from .mining import CONTEXT_TOKENS, JOIN, REASON_TOKENS, SCREEN_TOKENS, maximal, specific

#: Columns that step_sessions(keep=...) must carry along for a plan.
EVENT = ("element_name", "element_role", "app", "url")
STEP_TOKENS = SCREEN_TOKENS["typical_1512x982"] + CONTEXT_TOKENS + REASON_TOKENS


def top_routines(grams: DataFrame, limit: int = 20) -> DataFrame:
    """The maximal specific n-grams with the most steps over all occurrences; of equals the longer, then by text."""
    return maximal(specific(grams)).orderBy(F.desc(F.col("cnt") * F.col("n")), F.desc("n"), "sig").limit(limit)


def _quoted(c: Column) -> Column:
    """A JSON string."""
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _action(step: Column, row: Column) -> Column:
    """The JSON of one action: what to do, on what, and what must hold before it is done."""
    text = lambda c: F.coalesce(row[c], F.lit(""))
    name, role, app = F.substring(F.trim(text("element_name")), 1, 60), text("element_role"), text("app")
    field = F.coalesce(F.nullif(row["element_name"], F.lit("")), F.lit("field"))
    types = step.startswith("type:")
    page = F.when(text("url") != "", F.concat(F.lit(', "expect_url_template": '), _quoted(F.coalesce(url_template(row["url"]), F.lit(""))))).otherwise("")
    guard = F.concat(F.when(types, "").otherwise(F.concat(F.lit('"expect_element": '), _quoted(name), F.lit(", "))), F.lit('"expect_role": '), _quoted(role), F.lit(', "expect_app": '), _quoted(app), page)
    return F.concat(F.lit('{"op": "'), F.when(types, "type").otherwise("click"), F.lit('", "target": '), _quoted(F.when(types, field).otherwise(name)), F.lit(', "role": '), _quoted(role), F.lit(', "guard": {'), guard, F.lit("}}"))


def _grounded(step: Column, row: Column) -> Column:
    """Whether a guard names an element or a page."""
    return (~step.startswith("type:") & (F.trim(F.coalesce(row["element_name"], F.lit(""))) != "")) | (F.coalesce(url_template(row["url"]), F.lit("")) != "")


def compile_plans(routines: DataFrame, sessions: DataFrame) -> DataFrame:
    """sig, n, cnt, plan_tokens, grounded (steps whose guard names an element or a page), guard_coverage,
    rederivation_tokens, ratio, plan (a JSON list) of routines, from the first occurrence in sessions (with rows)."""
    at = routines.select("sig", "gram", "n", "cnt", F.col("first.session").alias("session"), F.col("first.pos").alias("pos"))
    found = at.join(sessions.select("session", "rows"), "session").withColumn("rows", F.slice("rows", F.col("pos"), F.col("n").cast("int")))
    actions = F.zip_with("gram", "rows", _action)
    out = found.select("sig", F.col("n").cast("long").alias("n"), "cnt", F.concat(F.lit("["), F.array_join(actions, ", "), F.lit("]")).alias("plan"), F.size(F.filter(F.zip_with("gram", "rows", _grounded), lambda x: x)).alias("grounded"))
    out = out.withColumn("plan_tokens", tokens(F.col("plan"))).withColumn("rederivation_tokens", F.col("n") * STEP_TOKENS)
    return out.select("sig", "n", "cnt", "plan_tokens", "grounded", F.bround(F.col("grounded") / F.col("n"), 2).alias("guard_coverage"), "rederivation_tokens", F.round(F.col("rederivation_tokens") / F.col("plan_tokens"), 1).alias("ratio"), "plan")


def plan_summary(plans: DataFrame) -> DataFrame:
    """n_plans, the upper medians of tokens and guard coverage, and median, p25 and p75 of the ratios, of a top list."""
    ranked = lambda c, part: F.get(F.sort_array(F.collect_list(c)), F.floor(F.count("*") * part).cast("int"))
    return plans.agg(
        F.count("*").alias("n_plans"), ranked("plan_tokens", 0.5).alias("plan_tokens"), ranked("guard_coverage", 0.5).alias("guard_coverage"),
        F.round(F.expr("percentile(ratio, 0.5)"), 1).alias("median"), ranked("ratio", 0.25).alias("p25"), ranked("ratio", 0.75).alias("p75"),
    )


def routine_store(plans: DataFrame) -> DataFrame:
    """One row for each routine as a store keeps them: routine_id (of the text), sig, n, cnt, plan_tokens, ratio, plan."""
    return plans.select(F.substring(F.sha2("sig", 256), 1, 16).alias("routine_id"), "sig", "n", "cnt", "plan_tokens", "ratio", "plan")


def retrieve(store: DataFrame, query: str, top: int = 5) -> DataFrame:
    """Routines that hold words of query: those with most of them, then the most frequent; none without a word."""
    words = sorted(set(w for w in query.lower().split() if w))
    hits = sum((F.when(F.contains(F.lower("sig"), F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    return store.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), F.desc("cnt"), "sig").limit(top)


def joined(sig: str) -> list[str]:
    return sig.split(JOIN)
