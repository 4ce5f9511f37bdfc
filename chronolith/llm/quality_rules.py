"""Quality rules: counted base rules, then the hashed n-gram log-likelihood ratio between the multinomial of a
trusted target and that of the whole raw corpus, divided by the number of n-grams. DataFrame operations only.

All that decides is integer arithmetic in a fixed order (the ratio of a bucket is rounded to millionths once),
so a document's verdict does not depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPLIT_PATTERN, table

#: Buckets of the hashed n-grams; the table of their ratios has so many longs.
BUCKETS = 16_384
#: Trusted documents that the target is fitted on at most (those with the smallest hash of their id).
TARGET_DOCS = 20_000
#: Documents whose mean log ratio in millionths is lower are dropped.
THRESHOLD = -90_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT_PATTERN), lambda w: w != "")


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Windows of three words are first compared by hash; those with a partner by half a hash are then compared as
    text, so the count is exact. All within the row: nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select("doc_id", words_of(F.col("text")).alias("words"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), lines.alias("lines"))
    d = d.select(
        "doc_id",
        "words",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(words) < 3 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(words) - 3), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))) END").alias("h"),
    )
    d = d.withColumn(
        "packed",
        F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> shiftleft(shiftrightunsigned(x, 31), 31) | CAST(i AS BIGINT))) ELSE CAST(array() AS array<bigint>) END"),
    ).drop("h")
    d = d.withColumn(
        "near",
        F.expr("transform(filter(packed, (p, j) -> shiftrightunsigned(p, 31) <=> shiftrightunsigned(get(packed, j - 1), 31) OR shiftrightunsigned(p, 31) <=> shiftrightunsigned(get(packed, j + 1), 31)), p -> CAST(p & 2147483647 AS INT))"),
    ).drop("packed")
    d = d.withColumn(
        "near", F.expr("sort_array(transform(near, i -> struct(concat_ws(' ', get(words, i), get(words, i + 1), get(words, i + 2)) AS w, i AS i)))")
    )
    d = d.withColumn("at", F.expr("sort_array(transform(filter(near, (e, j) -> e.w <=> get(near, j - 1).w OR e.w <=> get(near, j + 1).w), e -> e.i))")).drop("near")
    d = d.withColumn("n_repeat_words", F.expr("aggregate(transform(at, (p, j) -> least(3, coalesce(get(at, j + 1) - p, 3))), 0L, (a, x) -> a + x)")).drop("at")
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def grams(words: str, buckets: int) -> str:
    """SQL for the buckets of the words and word pairs of the array named words."""
    return (
        f"concat(transform({words}, w -> CAST(pmod(xxhash64(w), {buckets}) AS INT)), CASE WHEN size({words}) < 2 THEN CAST(array() AS array<int>) ELSE "
        f"transform(sequence(0, size({words}) - 2), i -> CAST(pmod(xxhash64(get({words}, i), get({words}, i + 1)), {buckets}) AS INT)) END)"
    )


def ratio_table(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, target_docs: int = TARGET_DOCS) -> list[int]:
    """Of each bucket, log(target / raw) in millionths. raw counts every document, target at most target_docs of
    those labelled quality 1 (none: the ratio is 0 throughout); both with one added to each bucket."""
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs)
    trusted = F.broadcast(trusted.withColumn("trusted", F.lit(1)))
    each = docs.select("doc_id", words_of(F.col("text")).alias("words")).join(trusted, "doc_id", "left")
    each = each.select("trusted", F.explode(F.expr(grams("words", buckets))).alias("bucket"))
    rows = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target")).collect()
    raw, target = [1] * buckets, [1] * buckets
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if sum(target) == buckets:
        return [0] * buckets
    import math

    shift = math.log(sum(raw)) - math.log(sum(target))
    return [round(1e6 * (math.log(t) - math.log(r) + shift)) for t, r in zip(target, raw)]


def judge_quality(docs: DataFrame, ratios: list[int], *, threshold: int = THRESHOLD) -> DataFrame:
    """Base counts, llr_micro (mean log ratio in millionths; 0 without a word) and kept, for every row of docs.

    A null text has no word and fails the base rules; repeated rows give repeated rows; no other column than
    doc_id and text is read.
    """
    held = F.split(F.lit(" ".join(map(str, ratios))), " ").cast("array<bigint>")
    d = base_rules(docs)
    d = d.withColumn("g", F.expr(grams("words", len(ratios)))).drop("words")
    total = F.aggregate("g", F.lit(0).cast("long"), lambda a, b: a + F.get(held, b))
    d = d.withColumn("llr_micro", F.when(F.size("g") > 0, F.floor(total / F.size("g"))).otherwise(F.lit(0)).cast("long")).drop("g")
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("llr_micro") >= threshold))


def op8_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge_quality(docs, ratio_table(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_micro")
