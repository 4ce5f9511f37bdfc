"""Benchmark decontamination: passages of documents that are copies, exact or near, of a benchmark's items.

A SimHash fingerprint is taken of each item, over its weighted word shingles, and of every window of an item's size
in every document. Sizes are rounded down by less than an eighth (to 16 shingles not at all), so that their number grows
with the logarithm of the longest item; an item is fingerprinted from its first shingle over such a size. A multi-index
of Hamming blocks finds the items of that size within RADIUS bits: two fingerprints that differ in no more bits differ
in at most BLOCK_BITS_OFF in one of the BLOCKS at least, and every value of a block is listed with the items within that
distance, so none is missed. Candidates are verified by the exact weighted Jaccard similarity of all shingles of the item
and of as many from the window's first (weight: how often a shingle occurs).

The benchmark is a query set: it goes to the executors in blocks of items, whose size is bounded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, fresh, table, text_udf
from .minhash_dedup import Known, mix

SHINGLE, SIMILAR = 5, 0.8
#: Blocks of 16 bits of a fingerprint, and bits that a block of two fingerprints may differ in. A random fingerprint is
#: a candidate with a probability of 4.2 %.
BLOCKS, BLOCK_BITS_OFF = 4, 3
#: Differing bits up to which every fingerprint is found. A window with a similarity of 0.8 differs in about 10 bits.
RADIUS = BLOCKS * (BLOCK_BITS_OFF + 1) - 1
#: Items, and characters of items, that are sent to the executors at once.
ITEMS_AT_ONCE, CHARS_AT_ONCE = 20_000, 8_000_000
#: Words of documents that are searched at once (a longer text is searched whole), windows at once, and windows whose
#: fingerprints are made at once, so that what is made of them stays in a processor's own cache.
WORDS_AT_ONCE, WINDOWS_AT_ONCE, PRINTS_AT_ONCE = 200_000, 65_536, 4_096
#: Items up to which a group's are compared one and all with a window that may be near one, which takes less time than
#: their lists; and comparisons that are made at once.
FEW, COMPARED_AT_ONCE = 32, 2_000_000
_STEP = np.random.default_rng(77).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFF = np.array([sum(1 << b for b in bits) for n in range(BLOCK_BITS_OFF + 1) for bits in combinations(range(16), n)], np.uint16)
_TABLE = np.arange(BLOCKS) << 16
_VALUES = np.arange(1 << 16)
_MARKS = re.compile(r"[\W_]+")


class Words:
    """64-bit hashes of the words of texts, lower-cased and without marks; tokens of marks only are no words."""

    def __init__(self):
        from xxhash import xxh3_64_intdigest as digest

        def hashed(word: str) -> int:
            plain = word if word.isalnum() else _MARKS.sub("", word)
            return digest(plain) | 1 if plain else 0

        self.known = Known(hashed)

    def __call__(self, text: str | None) -> np.ndarray:
        own = (text or "").lower().split()
        h = np.fromiter(self.known.of(own), np.uint64, len(own))
        return h[h != 0]


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of each SHINGLE consecutive words, in order."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(SHINGLE))
    for i in range(SHINGLE):
        h += mix(words[i : i + n] + _STEP[i]) * _STEP[i]
    return mix(h)


def rounded(size: int) -> int:
    """The size of the windows for items of size shingles."""
    own = 1
    while own + max(1, own // 8) <= size:
        own += max(1, own // 8)
    return own


def sums(hashes: np.ndarray, width: int) -> np.ndarray:
    """Running sums of each of the 64 bits of hashes, with a row of zeros before, in fields that hold the sums of width
    rows. The fields are added as parts of 64-bit numbers: one may run over into the next, but the difference of two
    rows no more than width apart is right in every field."""
    kind = np.uint8 if width < 1 << 8 else np.uint16 if width < 1 << 16 else np.uint32
    bits = np.unpackbits(hashes.view(np.uint8)).astype(kind, copy=False).view(np.uint64).reshape(len(hashes), -1)
    total = np.zeros((len(hashes) + 1, bits.shape[1]), np.uint64)
    np.cumsum(bits, axis=0, out=total[1:])
    return total


def fingerprints(total: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each width consecutive rows of sums: each bit by the majority of the shingles, ties 1."""
    kind, n = np.dtype(f"u{total.shape[1] // 8}"), len(total) - width
    out = np.empty(n, np.uint64)
    for i in range(0, n, PRINTS_AT_ONCE):
        end = min(i + PRINTS_AT_ONCE, n)
        ones = (total[i + width : end + width] - total[i:end]).view(kind)
        out[i:end] = np.packbits(np.greater_equal(ones, kind.type((width + 1) // 2), out=ones.view(bool) if kind.itemsize == 1 else None).ravel()).view(np.uint64)
    return out


def similarity(a: np.ndarray, b: Counter) -> float:
    own = a.tolist()
    if b.keys().isdisjoint(own):
        return 0.0
    c = Counter(own)
    low = sum(min(n, b[s]) for s, n in c.items() if s in b)
    return low / (len(a) + b.total() - low)


class Group:
    """The items of one rounded size: their shingles, fingerprints, and the multi-index of the fingerprints' blocks."""

    def __init__(self):
        self.items, self.bags, self.sizes, self.prints = [], [], [], []

    def close(self) -> Group:
        self.prints, self.sizes = np.array(self.prints, np.uint64), np.array(self.sizes)
        blocks = self.prints.view(np.uint16).reshape(-1, BLOCKS)
        # of every value of every block, the bits it differs in from the nearest item's
        self.least = np.full((BLOCKS, 1 << 16), 16, np.uint8)
        for k, least in enumerate(self.least):
            least[blocks[:, k]] = 0
            for bit in range(16):
                np.minimum(least, least[_VALUES ^ 1 << bit] + np.uint8(1), out=least)
        if len(self.items) <= FEW:
            return self  # lists are not read
        starts, items = [np.zeros(1, np.int64)], []
        for k in range(BLOCKS):
            near = (blocks[:, k, None] ^ _OFF).ravel()
            order = np.argsort(near, kind="stable")
            starts.append(np.cumsum(np.bincount(near, minlength=1 << 16)) + starts[-1][-1])
            items.append((order // len(_OFF)).astype(np.int32))
        # of every value of every block, the place of its list of items
        self.starts, self.listed_items = np.concatenate(starts), np.concatenate(items)
        return self

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, item number) of the pairs within RADIUS, in order. Only those fingerprints are compared
        whose blocks' least differences add up to no more: any item differs in at least so many bits."""
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        apart = self.least[0].take(blocks[:, 0])
        for k in range(1, BLOCKS):
            apart += self.least[k].take(blocks[:, k])
        at = np.flatnonzero(apart <= RADIUS)
        step = max(1, COMPARED_AT_ONCE // len(self.items))
        pairs = [self._compared(prints, at[i : i + step]) for i in range(0, len(at), step)]
        return np.divmod(np.unique(np.concatenate(pairs)) if pairs else at, len(self.items))

    def _compared(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the prints at places at, place * items + item number of the pairs within RADIUS, some more than once."""
        if len(self.items) <= FEW:
            item, place = np.divmod(np.flatnonzero(np.bitwise_count(self.prints[:, None] ^ prints.take(at)) <= RADIUS), len(at))
            return at.take(place) * len(self.items) + item
        slot = (prints.view(np.uint16).reshape(-1, BLOCKS).take(at, axis=0) + _TABLE).ravel()
        first = self.starts.take(slot)
        size = self.starts.take(slot + 1) - first
        stop = np.cumsum(size)
        item = self.listed_items.take(np.repeat(first - stop + size, size) + np.arange(stop[-1]))
        place = np.repeat(np.repeat(at, BLOCKS), size)
        good = np.flatnonzero(np.bitwise_count(prints.take(place) ^ self.prints.take(item)) <= RADIUS)
        return place.take(good) * len(self.items) + item.take(good)


class Index:
    """A block of items, in groups by their number of shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words = Words()
        groups: dict[int, Group] = {}
        for item, text in items:
            h = shingles(self.words(text))
            if not len(h):
                continue
            width = rounded(len(h))
            group = groups.setdefault(width, Group())
            group.items.append(item)
            group.bags.append(Counter(h.tolist()))
            group.sizes.append(len(h))
            group.prints.append(fingerprints(sums(h[:width], width), width)[0])
        self.groups = {width: groups.pop(width).close() for width in sorted(groups)}

    def search(self, texts: list[str | None]) -> list[dict[int, tuple[float, int, int]]]:
        """Of each text, the best window of each item that occurs: (similarity, first word, number of words)."""
        out: list = [{} for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            words = self.words(text)
            if len(words) >= SHINGLE and self.groups:
                held.append((i, words))
                size += len(words)
            if held and (size >= WORDS_AT_ONCE or i == len(texts) - 1):
                self._search(held, out)
                held, size = [], 0
        if held:
            self._search(held, out)
        return out

    def _search(self, held: list, out: list) -> None:
        words = np.concatenate([w for _, w in held])
        owner = np.repeat(np.arange(len(held)), [len(w) for _, w in held])
        begin = np.cumsum([0, *(len(w) for _, w in held)])
        ends = begin[1:][owner]
        h = shingles(words)
        most = max(self.groups)
        for base in range(0, len(h), WINDOWS_AT_ONCE):
            part = h[base : base + WINDOWS_AT_ONCE + most - 1]
            total = sums(part, most)
            for width, group in self.groups.items():
                n = min(WINDOWS_AT_ONCE, len(part) - width + 1)
                if n <= 0:
                    break  # groups are sorted by width
                place, item = group.near(fingerprints(total[: n + width], width))
                place += base
                size = group.sizes[item]
                same = ends[place] >= place + size + SHINGLE - 1  # windows end in the document that they begin in
                for p, k, size in zip(place[same].tolist(), item[same].tolist(), size[same].tolist()):
                    sim = similarity(h[p : p + size], group.bags[k])
                    if sim >= SIMILAR - 1e-12:
                        doc = int(owner[p])
                        found, first = out[held[doc][0]], p - int(begin[doc])
                        best = found.get(group.items[k])
                        if best is None or (-sim, first) < (-best[0], best[1]):
                            found[group.items[k]] = sim, first, size + SHINGLE - 1


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items with an id and a text, a bounded block of them at a time; rows that share an id are parts of one answer."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator()
    block, chars = [], 0
    for r in rows:
        block.append((r["item_id"], r["text"]))
        chars += len(r["text"])
        if len(block) >= ITEMS_AT_ONCE or chars >= CHARS_AT_ONCE:
            yield block
            block, chars = [], 0
    if block:
        yield block


HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32())]))


def hits_of(docs: DataFrame, block: list):
    """An Arrow UDF of the hits of a text among the items of block, by item."""
    shared = Shared(docs.sparkSession, block)
    names = HIT.value_type.names

    def run(index, texts):
        found = index.search(texts.to_pylist())
        return pa.array([[dict(zip(names, (item, *best))) for item, best in sorted(x.items())] for x in found], HIT)

    return text_udf("benchmark", shared.id, lambda: Index(shared.value), run, "array<struct<item_id: bigint, similarity: double, first_word: int, n_words: int>>")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of every item that a row of docs holds (of
    equally similar windows the first).

    Words are compared in lower case and without marks. An item or text of fewer than SHINGLE words, or null, matches
    nothing (so short an item is no passage), an empty benchmark gives no row. Texts are searched whole. Repeated rows
    give repeated rows, a null doc_id is kept, and other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, first_word int, n_words int")
    for block in blocks(benchmark):
        out = out.union(rows.select("doc_id", F.explode(hits_of(docs, block)("text")).alias("hit")).select("doc_id", "hit.*"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item of benchmark (as contaminated() finds them), with all their columns; each
    block of items drops its own. Rows that repeat are judged alike, and a null text stays."""
    columns = docs.columns
    for block in blocks(benchmark):
        found = fresh(docs, "found")
        docs = docs.withColumn(found, F.size(hits_of(docs, block)("text"))).where(F.col(found) == 0).select(*[F.col(f"`{c}`") for c in columns])
    return docs


def op1_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
