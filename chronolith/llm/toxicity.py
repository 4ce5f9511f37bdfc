"""Toxicity by a factorization machine over hashed terms.

The score is a logistic of a linear part and of products of pairs: terms that are harmless alone and toxic
together (an insult with a group named) get weight from the learned factors. Terms are the lower-cased words and
their beginnings of three to five letters, hashed. A term is learned if it tells the classes apart by itself, or if
it does so together with another beyond what the two do alone, so a pair that only matters together is learned too.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, fresh, held_out, structs, table, text_udf

#: Labelled documents that are learned from at most (those with the smallest hash of their id).
SAMPLE_DOCS = 10_000
BUCKETS = 1 << 20
#: Terms that are learned at most for their own effect, least number of sample documents with a term, and factors of each.
TERMS, LEAST_DOCS, FACTORS = 4_096, 4, 8
#: Terms whose pairs are screened (those that most sample documents hold), and the least effect, in standard
#: deviations, of a term and of a pair.
SCREENED, ALONE, TOGETHER = 4_096, 2.5, 6.0
#: Words that a worker keeps the terms of, and letters of the longest of them; neither changes a result.
CACHE, CACHED_LETTERS = 200_000, 64
#: Spread of the factors that learning starts with.
START = 0.05
WORD = r"[^\W\d_]+"
PREDICT = 0.3


def word_terms(word: str) -> list[int]:
    names = [f"w{word}", *(f"p{word[:k]}" for k in (3, 4, 5) if len(word) > k)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


class Model:
    """column: bucket to column; bias, linear (of columns), factors (columns by factor)."""

    def __init__(self, column: dict[int, int], bias: float, linear: np.ndarray, factors: np.ndarray):
        self.column, self.bias, self.linear, self.factors = column, bias, linear, factors

    def score(self, columns: np.ndarray) -> float:
        """Of a text with these distinct columns."""
        v = self.factors[columns]
        s = v.sum(axis=0)
        z = self.bias + self.linear[columns].sum() + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def sample_terms(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """doc_id, toxic, terms (distinct buckets, packed) of at most limit labelled documents that are not held out."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(limit)

    def build():
        import re

        return re.compile(WORD).findall

    def run(find, texts):
        return pa.array([array("I", sorted({t for w in set(find((text or "").lower())) for t in word_terms(w)})).tobytes() for text in texts.to_pylist()], pa.binary())

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(own.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic"))), "doc_id")
    terms = rows.select("doc_id", "toxic", text_udf("toxicity terms", 0, build, run, "binary")("text").alias("terms"))
    return terms.orderBy("doc_id", "terms").limit(2 * limit)  # however often a doc_id repeats


def paired(rows: list[tuple[int, np.ndarray]], rest: np.ndarray, n: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Of the SCREENED terms that most rows hold, those of a pair whose documents deviate by TOGETHER or more from what
    its terms do alone. rest: label less base of each row; n, alone: of each bucket, its rows and the sum of rest."""
    most = np.lexsort((np.arange(BUCKETS), -n))[:SCREENED]
    most = np.sort(most[n[most] >= LEAST_DOCS])
    at = np.full(BUCKETS, -1)
    at[most] = np.arange(len(most))
    both, total = (np.zeros((len(most), len(most)), np.float32) for _ in range(2))
    for i in range(0, len(rows), 1_000):
        part = rows[i : i + 1_000]
        held = np.zeros((len(part), len(most)), np.float32)
        for k, (_, terms) in enumerate(part):
            own = at[terms.astype(np.int64)]
            held[k, own[own >= 0]] = 1
        both += held.T @ held
        total += held.T @ (held * rest[i : i + 1_000, None].astype(np.float32))
    mean = (alone[most] / n[most]).astype(np.float32)
    spread = float((rest * rest).mean())
    good = np.zeros(len(most), bool)
    for i in range(0, len(most), 256):
        count = both[i : i + 256]
        effect = np.abs(total[i : i + 256] - count * (mean[i : i + 256, None] + mean)) / np.sqrt(count * spread + 1)
        # of a term and another that is in the same documents only, nothing can be told
        same = (count >= 0.95 * n[most][i : i + 256, None]) | (count >= 0.95 * n[most])
        effect[same | (count < LEAST_DOCS)] = 0
        good[i : i + 256] = effect.max(axis=1, initial=0) >= TOGETHER
    return most[good]


def learn(rows: list[tuple[int, np.ndarray]], *, epochs: int = 24, rate: float = 0.2, l2: float = 1e-4, seed: int = 5) -> Model:
    """rows: (label, distinct buckets) of each document. The same rows give the same model. Without rows of both
    labels the score is the share of label 1, 0.0 without rows."""
    y = np.array([label for label, _ in rows], np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(0), np.zeros((0, FACTORS)))
    flat = np.concatenate([b for _, b in rows]).astype(np.int64)
    n = np.bincount(flat, minlength=BUCKETS)
    pos = np.bincount(flat, np.repeat(y, [len(b) for _, b in rows]), BUCKETS)
    base = y.mean()
    z = np.abs(pos - base * n) / np.sqrt(n * base * (1 - base) + 1)
    z[n < LEAST_DOCS] = 0
    best = np.lexsort((np.arange(BUCKETS), -z))[:TERMS]
    best = np.union1d(best[z[best] > ALONE], paired(rows, y - base, n, pos - base * n))
    column = {int(b): i for i, b in enumerate(best)}
    at = np.full(BUCKETS, -1)
    at[best] = np.arange(len(best))
    cols = [at[b.astype(np.int64)] for _, b in rows]
    cols = [c[c >= 0] for c in cols]
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(best)), rng.normal(0, START, (len(best), FACTORS)), float(np.log(base / (1 - base)))
    gw, gv, gb = np.full(w.shape, 1e-3), np.full(v.shape, 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 256):
            part = order[i : i + 256]
            sizes = np.array([len(cols[p]) for p in part])
            c, own = np.concatenate([cols[p] for p in part]).astype(np.int64), np.repeat(np.arange(len(part)), sizes)
            s = np.stack([np.bincount(own, v[c, k], len(part)) for k in range(FACTORS)], axis=1)
            q = np.bincount(own, (v[c] ** 2).sum(axis=1), len(part))
            out = bias + np.bincount(own, w[c], len(part)) + 0.5 * ((s * s).sum(axis=1) - q)
            d = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[part]) / len(part) * 16
            used, where = np.unique(c, return_inverse=True)
            dw = np.bincount(where, d[own], len(used)) + l2 * w[used]
            pull = d[own, None] * (s[own] - v[c])
            dv = np.stack([np.bincount(where, pull[:, k], len(used)) for k in range(FACTORS)], axis=1) + l2 * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            db = d.sum()
            gb += db * db
            bias -= 0.3 * rate * db / np.sqrt(gb)
    return Model(column, float(bias), w, v)


def fit(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from toxic of at most sample_docs labelled rows that are not held out; a doc_id that is labelled twice
    is toxic if either says so."""
    got = sample_terms(docs, labels, sample_docs).collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["terms"])))
    return learn([(int(r["toxic"]), np.frombuffer(r["terms"], np.uint32)) for r in got])


class Scorer:
    def __init__(self, model: Model):
        import re

        self.model, self.find, self.known = model, re.compile(WORD).findall, {}

    def _look(self, word: str) -> tuple:
        column = self.model.column
        found = tuple(column[t] for t in word_terms(word) if t in column)
        if len(self.known) >= CACHE:
            self.known.clear()
        if len(word) <= CACHED_LETTERS:
            self.known[word] = found
        return found

    def __call__(self, text: str | None) -> float:
        known, columns = self.known, set()
        for word in set(self.find((text or "").lower())):
            found = known.get(word)
            if found is None:
                found = self._look(word)
            if found:
                columns.update(found)
        return self.model.score(np.array(sorted(columns), np.int64))


SCORE = pa.struct([("score", pa.float64()), ("predicted", pa.int32())])


def score_toxicity(docs: DataFrame, model: Model, *, threshold: float = PREDICT) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from threshold on) for every row of docs.

    A null or empty text has no term and gets the score of the bias alone; repeated rows give repeated rows; other
    columns are not read.
    """
    shared = Shared(docs.sparkSession, model)

    def run(own, texts):
        scores = [own(text.as_py()) for text in texts]
        return structs(SCORE, [(x, int(x >= threshold)) for x in scores])

    score = text_udf("toxicity", shared.id, lambda: Scorer(shared.value), run, "score double, predicted int")
    found = fresh(docs, "found")
    return docs.select(F.col("doc_id").cast("long"), score("text").alias(found)).select("doc_id", f"{found}.*")


def op6_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_toxicity(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
