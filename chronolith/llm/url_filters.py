"""URL filters: a sort-merge range join of urls and (host, path prefix) rules, in DataFrame operations only.

A host's labels are reversed, so "a rule's host or any subdomain" means "a prefix of labels", and a rule
becomes the key ``reversed host / path``. A url is looked up under each of its host's suffixes, with its path
appended: a rule fits exactly if its key is a prefix of one of these keys. As prefixes nest or are disjoint,
one sweep over the sorted keys needs only the rule that was opened last and the stack of rules around it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions


def ascii_lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null and for a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def host_key(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def nested_rules(rules: DataFrame) -> DataFrame:
    """A row for each distinct rule: key, depth (labels), stack (the rules whose key is a prefix of it, itself
    last). Of equal rules with different verdicts the greatest word counts, so ``block`` goes before ``allow``."""
    own = rules.where("host is not null and path is not null and host <> ''").select(
        ascii_lower(F.col("host")).alias("host"), "path", "verdict"
    )
    own = own.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    own = own.select(
        F.concat(host_key(F.col("host")), F.lit("/"), "path").alias("key"),
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.size(F.split("host", r"\.")).alias("depth"),
    )
    cuts = own.select(
        "key", "depth", F.explode(F.expr("transform(sequence(1, length(key)), i -> substring(key, 1, i))")).alias("cut")
    )
    around = own.select(F.col("key").alias("cut"), "rule", "verdict")
    return (
        cuts.join(around, "cut")
        .groupBy("key", "depth")
        .agg(F.sort_array(F.collect_list(F.struct(F.length("cut").alias("n"), "cut", "rule", "verdict"))).alias("stack"))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int | None = None
) -> DataFrame:
    """The longest fitting rule and its verdict for every row of pages.

    rules has host, path and verdict. Result: page_id (of id_col), host, path, rule (null if none fits), verdict
    (else default). Null ids and urls, repeated rows and empty tables are ordinary: each row gives one row.
    Other columns of pages are not read. Rules are dealt to every salt, urls to one each, so that no host can
    be hot; a sweep holds no more than one rule with its stack in memory.
    """
    n = salts or 2 * partitions(pages.sparkSession)
    rules = nested_rules(rules)
    depth = rules.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()["d"]
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", "url", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("page_id", "url"), F.lit(n)).cast("int").alias("salt")
    )
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("salt").orderBy("page_id", "url"))).drop("url")
    labels = F.reverse(F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(labels), F.lit(depth)))), lambda i: F.array_join(F.slice(labels, F.lit(1), i), "."))
    points = rows.select("*", F.explode(suffixes).alias("suffix")).select(
        "salt", F.concat("suffix", F.lit("/"), "path").alias("key"), F.lit(1).alias("kind"), F.struct("nth", "page_id", "host", "path").alias("row"), F.lit(None).cast(rules.schema["stack"].dataType).alias("stack")
    )
    starts = rules.select(
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt"), "key", F.lit(0).alias("kind"), F.lit(None).cast(points.schema["row"].dataType).alias("row"), "stack"
    )
    sweep = Window.partitionBy("salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = points.unionByName(starts).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    active = F.filter("stack", lambda r: F.col("key").startswith(r["cut"]))
    best = F.when(F.size(active) > 0, F.element_at(active, -1))
    found = found.select("salt", "row.*", best.alias("best")).select("salt", "nth", "page_id", "host", "path", F.when(F.col("best").isNotNull(), F.struct(F.length("best.rule").alias("n"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))).alias("best"))
    return (
        found.groupBy("salt", "nth", "page_id", "host", "path")
        .agg(F.max("best").alias("best"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op9_url_filters(spark, sf_dir):
    values = ", ".join(str(r) for r in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP9_SQL = """
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
r AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM q),
s AS (SELECT page_id, host, path, CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM s
"""
