"""A corpus pipeline of five stages, each on what the one before it kept; queries: ``pipeline``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import byte_bpe, decontaminate, language_id, minhash_dedup, secret_scan
from chronolith.llm.common import discard, materialize, scratch_dir, with_scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Where between chance (1 / number of languages, 0) and certainty (1) the mean marginal of a document must lie. Held-out
#: documents of sf0.1 lie below in less than 1 of 2,000 cases; texts in an alphabet that no language has lie about there.
LEAST_CERTAINTY = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose words fit no learned language better than others: a mean marginal
    below 1/k + LEAST_CERTAINTY * (1 - 1/k) with k languages. A text in an unknown language that looks like a learned
    one stays. Null texts go; rows that repeat are judged alike; of equal languages the first by name counts; a null
    doc_id or lang has no effect. An empty table gives an empty one."""
    model = language_id.fit(docs)
    k = max(1, len(model.langs))
    found = language_id.identify(docs.select(COLUMNS), model, keep=COLUMNS)
    least = 1 / k + LEAST_CERTAINTY * (1 - 1 / k) - 1e-6
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the least doc_id stays. Rows that share a
    doc_id are one document: of those that stay, the least by text, lang, source and n_chars is kept. A null doc_id, or
    a text without words, is linked with nothing and stays. An empty table gives an empty one."""
    judged = materialize(minhash_dedup.near_duplicates(docs.select("doc_id", "text"), shingle=5).select("doc_id", "kept"))
    gone = materialize(judged.where("not kept").select("doc_id").distinct())
    again = materialize(judged.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    docs = minhash_dedup.with_ids(docs.select(COLUMNS), gone, "left_anti")
    if again.isEmpty():
        return docs.select(COLUMNS)
    once = minhash_dedup.with_ids(docs, again, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return minhash_dedup.with_ids(docs, again, "left_anti").select(COLUMNS).union(once.select(COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of benchmark go. Null and short texts hold none and stay; rows that repeat are judged
    alike. An empty table gives an empty one, an empty benchmark lets all stay."""
    return decontaminate.decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, all rows stay; n_chars follows the text (null for a null text). Rows that repeat are masked
    alike. An empty table gives an empty one."""
    masked = secret_scan.redact(docs.select(COLUMNS), secret_scan.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the decoded bytes, of every row; a null text has no token,
    rows that repeat give the same ids. An empty table gives an empty one."""
    import public_tokenizers as P

    return byte_bpe.encode_texts(docs, byte_bpe.rank_file(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("tokens", tokens)]

#: Learned models, components and byte pairs are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents. Of a stage's tables only its output stays, and that only until the
    next stage has written its own; the last output is the result's."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = f"{scratch_dir(spark).rstrip('/')}/corpus-{name}-{uuid.uuid4().hex}"
        with with_scratch():
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            discard(before)
        before = docs
    return docs
