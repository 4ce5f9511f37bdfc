"""Language ID of words and documents by a linear-chain conditional random field.

The labels are the languages that occur. A word's features are hashed: its affixes of one to three letters, its
letter pairs and triples, and the word itself (the lexicon); transitions are learned too. Training sequences
splice pieces of documents of several languages, so the field learns how often text switches. Words are labelled
by forward-backward; a document's language is the one with the largest mean marginal over its words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import Shared, fresh, held_out, structs, table, text_udf

#: Training documents of a language (expected number, all if it has fewer), and words taken of each.
SAMPLE_DOCS, SAMPLE_WORDS = 400, 240
FEATURES = 1 << 16
#: Words that a worker keeps emissions of, letters of the longest of them, and words labelled at once (a longer text
#: is labelled whole, by itself). None of these changes a result.
CACHE, CACHED_LETTERS, BLOCK = 200_000, 64, 250_000
WORD = r"\p{L}[\p{L}\p{M}]*"


def _hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


def word_features(word: str) -> list[int]:
    b = f"^{word}$"
    n = len(word)
    names = [f"w{word}", *(f"p{word[:k]}" for k in (1, 2, 3) if k <= n), *(f"s{word[-k:]}" for k in (1, 2, 3) if k <= n)]
    names += {b[i : i + k] for k in (2, 3) for i in range(len(b) - k + 1)}
    return [_hashed(x) for x in sorted(names)]


def word_emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The sum of weights over word_features() of each word. Affixes, pairs and triples of all words are made at once,
    as numbers, and each that occurs is hashed once."""
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size + 2) - size - 1  # where a word's first letter lies
    owner = np.repeat(np.arange(len(words)), size + 2)
    letters, c = np.unique(code, return_inverse=True)
    c, base = c + 1, len(letters) + 1  # 0: no letter

    def grams(kind, at, k):
        """The numbers of the k letters from each place on: kind, then three digits."""
        digits = [c[at + j] for j in range(k)] + [0] * (3 - k)
        return ((kind * base + digits[0]) * base + digits[1]) * base + digits[2]

    names, owners = [], []
    for k in (2, 3):
        at = np.flatnonzero(owner[: 1 - k] == owner[k - 1 :])
        names.append(grams(0, at, k))
        owners.append(owner[at])
    for k in (1, 2, 3):
        long = np.flatnonzero(size >= k)
        names += [grams(1, first[long], k), grams(2, first[long] + size[long] - k, k)]
        owners += [long, long]
    kinds, name = np.unique(np.concatenate(names), return_inverse=True)
    signs = ["", *map(chr, letters.tolist())]
    digits = zip(*((kinds // base**i % base).tolist() for i in (2, 1, 0)), (kinds // base**3).tolist())
    hashed = np.array([_hashed(("", "p", "s")[kind] + signs[x] + signs[y] + signs[z]) for x, y, z, kind in digits], np.int64)
    pairs = np.sort(np.concatenate(owners) * len(kinds) + name)
    of, name = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], len(kinds))  # a pair or triple counts once in a word
    out = np.add.reduceat(weights[hashed[name]], np.searchsorted(of, np.arange(len(words))), axis=0)
    return out + weights[[_hashed(f"w{w}") for w in words]]


def splice(docs: list[tuple[int, list[str]]], seed: int = 11) -> tuple[list[str], list[int], list[int]]:
    """words, labels and sequence lengths: pieces of 4 to 40 words, in sequences of one to four pieces."""
    rng = np.random.default_rng(seed)
    pieces = []
    for label, words in docs:
        i = 0
        while i < len(words):
            n = int(rng.integers(4, 41))
            pieces.append((label, words[i : i + n]))
            i += n
    words, labels, lengths = [], [], []
    order = rng.permutation(len(pieces))
    i = 0
    while i < len(order):
        n = int(rng.integers(1, 5))
        total = 0
        for k in order[i : i + n]:
            label, piece = pieces[k]
            words += piece
            labels += [label] * len(piece)
            total += len(piece)
        lengths.append(total)
        i += n
    return words, labels, lengths


class Model:
    """Learned parameters, as plain arrays; langs is sorted."""

    def __init__(self, langs, weights, trans, first):
        self.langs, self.weights, self.trans, self.first = list(langs), weights.astype(np.float32), trans, first


def some_words(limit: int):
    """An Arrow UDF: at most limit consecutive words of each text, from a place that the text itself decides."""

    def build():
        import regex

        return regex.compile(WORD).findall

    def run(find, texts):
        out = []
        for text in texts:
            text = (text.as_py() or "").lower()
            words = find(text)
            at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(words) - limit + 1)
            out.append(words[at : at + limit])
        return pa.array(out, pa.list_(pa.string()))

    return text_udf("language words", limit, build, run, "array<string>")


def fit(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Model:
    """Learn from text and non-null lang of rows that are not held out: of each language about sample_docs rows (a
    fixed fraction by the hash of doc_id and text, the same at every run), sample_words words of each. At most twice
    sample_docs rows for each language reach the driver, however many rows repeat."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((FEATURES, 0)), np.zeros((0, 0)), np.zeros(0))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(sample_docs / counts[lang])).otherwise(share)
    chosen = rows.withColumn("u", F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1 << 30))).where(F.col("u") < share * (1 << 30))
    sample = chosen.select("u", "lang", some_words(sample_words)("text").alias("words")).orderBy("u", "lang", "words").limit(2 * sample_docs * len(langs)).collect()
    texts = [(langs.index(r["lang"]), r["words"]) for r in sample]
    words, labels, lengths = splice(texts)
    if not words:
        return Model(langs, np.zeros((FEATURES, len(langs))), np.zeros((len(langs),) * 2), np.zeros(len(langs)))
    known = {w: np.array(word_features(w)) for w in set(words)}
    features = [known[w] for w in words]
    return Model(langs, *crf.train(features, np.array(labels), np.array(lengths), FEATURES, len(langs), epochs=3))


class Labeller:
    """Marginals of the words of whole texts, with a cache of word emissions."""

    def __init__(self, model: Model):
        import regex

        self.model, self.find = model, regex.compile(WORD).findall
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.passing: list[str] = []
        self.emission = np.zeros((0, len(self.model.langs)), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        for w in self.passing:
            del self.known[w]
        self.emission, self.passing = self.emission[: len(self.known)], []
        known = self.known
        new = sorted({w for w in words if w not in known}, key=lambda w: (len(w) > CACHED_LETTERS, w))  # those not kept come last
        if new:
            if len(known) + len(new) > CACHE and known:
                self.clear()
                return self.emissions(words)
            base = len(known)
            parts = [word_emissions(new[i : i + 5_000], self.model.weights) for i in range(0, len(new), 5_000)]
            known.update((w, base + i) for i, w in enumerate(new))
            self.passing = [w for w in new if len(w) > CACHED_LETTERS]
            self.emission = np.concatenate([self.emission, *parts])
        return self.emission[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def marginals(self, texts: list[list[str]]) -> np.ndarray:
        em = self.emissions([w for t in texts for w in t])
        return crf.marginals(em, self.model.trans, self.model.first, np.array([len(t) for t in texts]))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language or und, its mean marginal, number of runs of words of one language) of each text."""
        out: list = [("und", 0.0, 0)] * len(texts)
        if not self.model.langs:
            return out
        held, size = [], 0
        # texts of like lengths are labelled together: a block takes as many steps as its longest has words
        for i in sorted((i for i, text in enumerate(texts) if text), key=lambda i: -len(texts[i])):
            words = self.find(texts[i].lower())
            if words:
                held.append((i, words))
                size += len(words)
            if size >= BLOCK:
                self._block(held, out)
                held, size = [], 0
        if held:
            self._block(held, out)
        return out

    def _block(self, held, out):
        gamma = self.marginals([w for _, w in held])
        best = gamma.argmax(axis=1)
        lengths = np.array([len(w) for _, w in held])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        mean = np.add.reduceat(gamma.astype(np.float64), starts, axis=0) / lengths[:, None]
        turn = np.ones(len(best), np.int64)
        turn[1:] = best[1:] != best[:-1]
        turn[starts] = 1
        runs = np.add.reduceat(turn, starts)
        top = mean.argmax(axis=1)
        for k, (i, _) in enumerate(held):
            out[i] = self.model.langs[top[k]], float(min(1.0, mean[k, top[k]])), int(runs[k])


FOUND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("n_runs", pa.int32())])


def identify(docs: DataFrame, model: Model, *, keep: list[str] | None = None) -> DataFrame:
    """keep (columns of docs; doc_id without it), lang_pred, score and n_runs for every row of docs.

    A text that is null or has no letter (or a model without a language) gives und, 0.0 and 0; of languages with equal
    means the first by name counts. Repeated rows give repeated rows. Only text decides, all of it. A column of keep
    that is named as a result gives way to it.
    """
    keep = [F.col(f"`{c}`") for c in keep or ["doc_id"] if c.lower() not in ("lang_pred", "score", "n_runs")]
    shared = Shared(docs.sparkSession, model)
    label = text_udf("language", shared.id, lambda: Labeller(shared.value), lambda own, texts: structs(FOUND, own.predict(texts.to_pylist())), "lang_pred string, score double, n_runs int")
    found = fresh(docs, "found")
    return docs.select(*keep, label("text").alias(found)).select(*keep, f"{found}.*")


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_runs")
