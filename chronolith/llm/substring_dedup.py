"""Substring dedup: words in passages of WINDOW words or more that an earlier document has too are removed.

Count-min prefilter: the count of a window is overestimated by that of its minimizer, the least hash of the short
grams inside it, which equal windows share. Each partition counts the documents of its minimizers in the cells of
DEPTH rows; these sketches are merged by stripe, and what is kept is one bit for each cell: two documents or more.
Only windows whose minimizer has that bit in every row are grouped, by two polynomials over independent halves of
128-bit word hashes (words or windows that differ would have to agree in both); no window that two documents share
can be lost. The size of the bits is fixed by CELLS and DEPTH; with more
minimizers than cells the filter lets more through, and the result stays the same.

Two things keep the second pass small. Of rows with equal texts only the one with the least doc_id takes part: in
the others every window is repeated. And each task settles its own windows first: of a hash only the rows of its
least document go on, the rest are removals already, as runs of words. So a passage that is in a third of all
documents is met once for each task, not once for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, discard, materialize, table, tool
from .minhash_dedup import BROADCAST_IDS, Known, mix, with_ids

WINDOW, GRAM = 13, 5
#: Cells in a row of the sketch, rows, and cells in a stripe.
CELLS, DEPTH, STRIPE = 1 << 27, 2, 1 << 16
#: A row: its document, and a hash of both so that rows that share a doc_id stay apart.
KEY = ["doc_id", "row_id"]
#: Windows that a task settles, and cells that it counts, at once at most (but for those of one text).
SETTLED, SKETCHED = 2_000_000, 4_000_000
_B = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_ROW = np.array([0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_SHIFT = np.uint64(64 - (CELLS.bit_length() - 1))


class Words:
    """Of the words of texts, the two halves of their 128-bit hashes (rows 0 and 1)."""

    def __init__(self):
        import xxhash

        self.known = Known(xxhash.xxh3_128_digest)

    def __call__(self, text: str | None) -> np.ndarray:
        own = (text or "").encode("utf-8", "surrogatepass").split()
        return np.frombuffer(b"".join(self.known.of(own)), np.uint64).reshape(-1, 2).T


def rolled(words: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A polynomial of each n consecutive words, modulo 2 ** 64."""
    m = len(words) - n + 1
    h = words[:m].copy()  # contiguous
    for i in range(1, n):
        h *= base
        h += words[i : i + m]
    return h


def minimizers(words: np.ndarray) -> np.ndarray:
    """Of each window, the least hash of its grams."""
    g = mix(rolled(words, GRAM, _B[2]))
    span = WINDOW - GRAM + 1
    best, width = g, 1
    while width < span:
        step = min(width, span - width)
        best = np.minimum(best[: len(best) - step], best[step:])
        width += step
    return best


def cells(values: np.ndarray) -> list[np.ndarray]:
    return [((values * r) >> _SHIFT).astype(np.int64) + k * CELLS for k, r in enumerate(_ROW)]


def partition_sketch(docs: DataFrame) -> DataFrame:
    """stripe, once, often: which cells of it have one document, or more, of a partition (packed 16-bit offsets)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, parts, size = Words(), [], 0
        for batch in batches:
            for text in batch.column("text"):
                w = own(text.as_py())[0]
                if len(w) >= WINDOW:
                    parts.append(np.concatenate(cells(np.unique(minimizers(w)))))
                    size += len(parts[-1])
                if size > SKETCHED:
                    # a cell's two counts go on; the partition's rows for a stripe are summed when sketches are merged
                    yield from packed(pa, parts)
                    parts, size = [], 0
        if parts:
            yield from packed(pa, parts)

    def packed(pa, parts):
        every, n = np.unique(np.concatenate(parts), return_counts=True)
        stripe = every // STRIPE
        cut = np.concatenate([np.flatnonzero(np.diff(stripe, prepend=-1)), [len(every)]])
        offset = (every % STRIPE).astype(np.uint16)
        rows = []
        for a, b in zip(cut[:-1], cut[1:]):
            o, many = offset[a:b], n[a:b] > 1
            rows.append((int(stripe[a]), o[~many].tobytes(), o[many].tobytes()))
        s, once, often = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(once, pa.binary()), pa.array(often, pa.binary())], ["stripe", "once", "often"])

    return docs.select("text").mapInArrow(run, "stripe int, once binary, often binary")


def merged_sketch(sketches: DataFrame) -> DataFrame:
    """stripe, bits: the cells that have two documents or more in all."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, once, often in zip(*(batch.column(c).to_pylist() for c in ("stripe", "once", "often"))):
                c = count.get(s)
                if c is None:
                    c = count[s] = np.zeros(STRIPE, np.uint8)
                o = np.frombuffer(once, np.uint16)
                c[o] = np.minimum(c[o] + 1, 2)
                c[np.frombuffer(often, np.uint16)] = 2
        bits = [(s, np.packbits(c == 2).tobytes()) for s, c in count.items() if (c == 2).any()]
        if bits:
            s, b = zip(*bits)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(b, pa.binary())], ["stripe", "bits"])

    return sketches.repartition("stripe").mapInArrow(run, "stripe int, bits binary")


def settle(h: np.ndarray, g: np.ndarray, row: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows (hash h, g) of a task's rows aren't of the row with the least rank among those with their hash."""
    order = np.lexsort((rank[row], g, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
    least = rank[row[order]][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.zeros(len(order), bool)
    out[order] = rank[row[order]] > least
    return out


def repeated_windows(docs: DataFrame, shared) -> DataFrame:
    """a, b (the window's hash), row_id, doc_id, at (its first word), n: windows that may be repeated (n is 0), and runs
    of n windows that are (a and b are spread at random)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def build():
            bits = np.zeros(CELLS * DEPTH // 8, np.uint8)
            for s, b in shared.value:
                bits[s * STRIPE // 8 : (s + 1) * STRIPE // 8] = np.frombuffer(b, np.uint8)
            return bits

        bits, own = tool("sketch", shared.id, build), Words()
        part: list = []
        size = 0
        for batch in batches:
            for doc, text, code in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("row_id").to_pylist()):
                w, w2 = own(text.as_py())
                if len(w) < WINDOW:
                    continue
                least = minimizers(w)
                one, back = np.unique(least, return_inverse=True)
                hit = np.ones(len(one), bool)
                for c in cells(one):
                    hit &= (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
                at = np.flatnonzero(hit[back])
                if len(at):
                    part.append((doc, code, rolled(w, WINDOW, _B[0])[at], rolled(w2, WINDOW, _B[1])[at], at.astype(np.int32)))
                    size += len(at)
                if size > SETTLED:
                    yield from settled(pa, part)
                    part, size = [], 0
        if part:
            yield from settled(pa, part)

    def settled(pa, part):
        docs, codes = np.array([p[0] for p in part], np.int64), np.array([p[1] for p in part], np.int64)
        row = np.repeat(np.arange(len(part)), [len(p[2]) for p in part])
        h, g, at = (np.concatenate([p[i] for p in part]) for i in (2, 3, 4))
        gone = settle(h, g, row, docs)
        # runs of neighbouring windows of a row that are gone
        i = np.flatnonzero(gone)
        first = np.ones(len(i), bool)
        first[1:] = (row[i[1:]] != row[i[:-1]]) | (at[i[1:]] != at[i[:-1]] + 1)
        start = np.flatnonzero(first)
        n = np.diff(np.append(start, len(i))).astype(np.int32)
        i = i[start]
        spread = mix(codes[row[i]].view(np.uint64) + at[i].astype(np.uint64))
        j = np.flatnonzero(~gone)
        row = np.concatenate([row[i], row[j]])
        columns = [np.concatenate([spread, h[j]]).view(np.int64), np.concatenate([spread, g[j]]).view(np.int64), codes[row], docs[row], np.concatenate([at[i], at[j]]), np.concatenate([n, np.zeros(len(j), np.int32)])]
        for k in range(0, len(row), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in columns], ["a", "b", "row_id", "doc_id", "at", "n"])

    return docs.select("doc_id", "text", "row_id").mapInArrow(run, "a long, b long, row_id long, doc_id long, at int, n int")


def remove_repeats(docs: DataFrame, *, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (if with_text) kept, the words kept joined by spaces, of every row.

    Words are runs of other than space and U+0009 to U+000D, unchanged. A word goes if a window of WINDOW words over
    it also starts in a document with a smaller doc_id, as the input stands. A null text has no words; a null doc_id
    neither removes nor loses words; rows that share a doc_id are the same document and remove nothing from each
    other. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row_id", F.xxhash64("doc_id", "text"))
    # rows whose text an earlier document has too
    texts = rows.where("doc_id is not null").select("doc_id", "row_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    owner = materialize(texts.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.count("*").alias("n")).where("n > 1").drop("n"))  # so that the join of a hot text can be split
    copies = materialize(texts.join(owner, "digest").where("doc_id > lo").select(*KEY).distinct())
    own = with_ids(rows.where("doc_id is not null"), copies, "left_anti", KEY)
    sketch = merged_sketch(partition_sketch(own)).collect()  # CELLS * DEPTH bits at most
    shared = Shared(docs.sparkSession, [(r["stripe"], bytes(r["bits"])) for r in sketch])
    windows = repeated_windows(own, shared)
    lo = F.min("doc_id").over(Window.partitionBy("a", "b"))
    hits = windows.withColumn("lo", lo).where("n > 0 or doc_id > lo").select(*KEY, "at", F.greatest("n", F.lit(1)).alias("n"))
    hits = hits.groupBy(*KEY).agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    whole = copies.select(*KEY, F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"))).alias("runs"))
    hits = materialize(hits.union(whole))
    ids = hits.select(*KEY)
    hint = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    clean = rows.join(hint, KEY, "left_anti").select("doc_id", "text", F.lit(None).cast(hits.schema["runs"].dataType).alias("runs"))
    every = clean.union(rows.join(hint, KEY, "left_semi").join(hits, KEY).select("doc_id", "text", "runs"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                kept = words
                if runs.is_valid:
                    at, n = (runs.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    if at[0] < 0:  # an earlier document has the whole text
                        kept = words if len(words) < WINDOW else []
                    else:
                        cover = np.zeros(len(words) + 1, np.int32)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + n + (WINDOW - 1), -1)
                        kept = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
                data = b" ".join(kept)
                row = len(words), len(words) - len(kept), hashlib.sha256(data).hexdigest()
                out.append((*row, data.decode("utf-8", "surrogatepass")) if with_text else row)
            cols = list(zip(*out)) if out else [()] * (3 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return every.mapInArrow(run, schema)


def op5_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
q AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) AS lo FROM p),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM q WHERE lo < doc_id),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) FILTER (c.i IS NULL) AS kept, count(c.i) AS n_removed
      FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.i = e.i GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
