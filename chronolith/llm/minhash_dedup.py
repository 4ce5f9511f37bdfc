"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

Documents with equal sets are one class. A class is posted under each (coordinate, value) of its signature, and a
pair is a candidate if it collides in at least MATCH of the COORDINATES. Two such pairs of lists must meet in
their prefixes, so only the rarest COORDINATES - MATCH + 1 values of each class (values that nobody shares
included) are merged; the rest of the lists, the long ones, are skipped and counted for candidates only.

A list of n classes isn't expanded to all its pairs: each member is first held against one hub of the list, then
linked classes are contracted, and only lists that still hold several components go on, to another hub and at
last to the pairs between their components. Every candidate pair is thus confirmed, or joins classes that are
connected already, or is refuted by an exact bound: shingles that one document alone has are in no intersection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, slices, table
from .components import connected_components

COORDINATES, MATCH = 64, 38
#: Longs of bits that postings are held against each other by, a bit for each of so many more coordinates, and the
#: equal bits of a candidate pair at least: a pair with similarity of 0.8 has fewer with a probability of about 1 in a million.
LONGS, EQUAL_BITS = 16, 874
CACHE = 300_000
#: Ids that are broadcast at most; beyond it the join shuffles.
BROADCAST_IDS = 500_000
#: Rounds of hubs before the pairs between components of a list are listed one by one, and the pairs for each member
#: of the open lists up to which they are listed at once.
HUBS, LIST = 1, 1
_rng = np.random.default_rng(20240229)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COORD = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = _rng.integers(1, 1 << 63, 64 * LONGS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Known(dict):
    """Values of a function, kept until there are CACHE."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, key):
        value = self[key] = self.function(key)
        return value

    def of(self, keys):
        if len(self) > CACHE:
            self.clear()
        return map(self.__getitem__, keys)


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of texts; a cache of word hashes."""

    def __init__(self, size: int):
        import xxhash

        self.size, self.known = size, Known(xxhash.xxh3_64_intdigest)

    def words(self, text: str | None) -> np.ndarray:
        own = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(self.known.of(own), np.uint64, len(own))

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.words(text)
        k = min(self.size, len(w))
        if not k:
            return w
        n = len(w) - k + 1
        h = np.full(n, np.uint64(k))
        for i in range(k):
            h += mix(w[i : i + n] + _STEP[i]) * _STEP[i]
        return np.unique(mix(h))


def signature(shingles: np.ndarray, by: np.ndarray = _COORD) -> np.ndarray:
    """The least upper halves of the shingles under each coordinate's multiplication."""
    best = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(best, (shingles[i : i + 2048, None] * by).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty), sig (null if empty)."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        own = Shingler(shingle)
        for batch in (part for whole in batches for part in slices(whole)):
            n, digests, sigs = [], [], []
            for text in batch.column("text"):
                s = own(text.as_py())
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "digest", "sig"])
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig array<int>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, shingles (the sorted distinct hashes)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Shingler(shingle)
        for batch in (part for whole in batches for part in slices(whole)):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own(t.as_py()).view(np.int64) for t in batch.column("text")], pa.list_(pa.int64()))], ["doc_id", "shingles"])
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, shingles array<long>")


def with_bits(sets: DataFrame) -> DataFrame:
    """doc_id, bits: the lowest bit of each of 64 * LONGS coordinates, as longs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            bits = [np.packbits((signature(s.values.to_numpy().view(np.uint64), _BITS) & 1).astype(np.uint8)).view(np.int64) for s in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "bits"])

    return sets.mapInArrow(run, "doc_id long, bits array<long>")


def with_ids(df: DataFrame, ids: DataFrame, how: str, column: str | list[str] = "doc_id") -> DataFrame:
    """left_semi or left_anti join on column; ids (materialised) is broadcast only if it is small."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


def postings(classes: DataFrame) -> DataFrame:
    """key, id: of each class with enough shared values, those of its prefix, rarest first."""
    keys = classes.select("id", "digest", F.posexplode("sig").alias("pos", "value")).select(
        "id", "digest", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key")
    )
    often = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    own = keys.join(often, "key").groupBy("id", "digest").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"))
    take = F.size("own") - (MATCH - 1)
    return own.where(take > 0).select("id", F.explode(F.slice("own", F.lit(1), take)).alias("p")).select("p.key", "id").distinct()


def reachable(posted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, id, n, reach, rare of the postings that may be linked with another in their list.

    Shingles that no other posted document has are in no intersection. So of a set of n shingles of which c are shared,
    partners have at most reach = c * (100 + percent) / percent - n shingles, and at least percent of n; a posting whose
    reach is below the least set of its list, or whose set is above the greatest reach, has no partner there. rare is
    the share of unshared shingles in millionths. Rows that share a doc_id get the bounds of all their sets together.
    """
    each = sets.select("doc_id", F.explode("shingles").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count("*").alias("k"), F.min("doc_id").alias("doc_id")).where("k = 1").groupBy("doc_id").agg(F.count("*").alias("alone"))
    size = F.size("shingles").cast("long")
    bounds = sets.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(size).alias("n"), F.max(size).alias("most")).join(alone, "doc_id", "left")
    shared = F.when(F.col("rows") > 1, F.col("most")).otherwise(F.col("n") - F.coalesce("alone", F.lit(0)))
    bounds = bounds.withColumn("c", shared).selectExpr("doc_id as id", "n", f"(c * {100 + percent}) div {percent} - n as reach", "((most - c) * 1000000) div most as rare")
    bounds = materialize(bounds.where(f"100 * reach >= {percent} * n"))
    own = posted.join(bounds, "id")
    ends = own.groupBy("key").agg(F.min("n").alias("least"), F.max("reach").alias("far"), F.count("*").alias("k")).where("k > 1")
    return own.join(ends, "key").where("reach >= least and n <= far").select("key", "id", "n", "reach", "rare")


def collide(a: str, b: str):
    """Whether the documents with sig and bits named with the endings a and b collide as often as a candidate pair."""
    differ = sum((F.bit_count(F.get(f"bits{a}", F.lit(i)).bitwiseXOR(F.get(f"bits{b}", F.lit(i)))) for i in range(LONGS)), F.lit(0))
    hits = F.size(F.filter(F.zip_with(f"sig{a}", f"sig{b}", lambda x, y: x == y), lambda x: x))
    return (differ <= 64 * LONGS - EQUAL_BITS) & (hits >= MATCH)


def colliding(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those that collide."""
    ends = [marks.select(F.col("id").alias(e), F.col("sig").alias(f"sig_{e}"), F.col("bits").alias(f"bits_{e}")) for e in "ab"]
    return pairs.join(ends[0], "a").join(ends[1], (pairs["b"] == ends[1]["b"]) & collide("_a", "_b")).select("a", pairs["b"]).distinct()


def confirm(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the distinct pairs (a, b), those whose sets are as similar as asked."""
    ends = [sets.select(F.col("doc_id").alias(e), F.col("shingles").alias(f"x{e}")) for e in "ab"]
    shared = F.size(F.array_intersect("xa", "xb"))
    alike = 100 * shared >= percent * (F.size("xa") + F.size("xb") - shared)
    return near.join(ends[0], "a").join(ends[1], (near["b"] == ends[1]["b"]) & alike).select("a", near["b"]).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id linked to it), kept (it is the least) for every row of docs.

    Words are runs of other than space and U+0009 to U+000D, with A-Z lower-cased; a shorter text is one shingle; a
    text that is null or without words is linked with nothing. Documents are linked if the intersection of their
    sets is percent of the union or more. A null doc_id is linked with nothing and kept, with a null component_id.
    Rows that share a doc_id are one vertex: linked if any of their texts is. Other columns are not read.
    """
    own = materialize(sketches(docs, shingle))
    real = own.where("doc_id is not null and digest is not null")
    classes = materialize(real.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")))
    posted = materialize(postings(classes))
    used = materialize(posted.select(F.col("id").alias("doc_id")).distinct())
    sets = materialize(shingle_sets(with_ids(docs.where("doc_id is not null"), used, "left_semi"), shingle).distinct())
    lists = materialize(reachable(posted, sets, percent))
    sets = materialize(with_ids(sets, materialize(lists.select(F.col("id").alias("doc_id")).distinct()), "left_semi"))
    marks = materialize(with_bits(sets).withColumnRenamed("doc_id", "id").join(classes.select("id", "sig"), "id"))
    links = _shared_ids(real, classes)
    component = _components(links)
    left = lists
    for wave in range(HUBS + 2):
        at = _at(left, component, "id", "component")
        own_hub = F.struct(F.xxhash64(F.lit(wave), "id") if wave else F.col("rare"), "id")
        each = at.groupBy("key", "component").agg(F.count("*").alias("n_ids"), F.min("rare").alias("rare"), F.min_by(F.struct("id", "n", "reach"), own_hub).alias("hub"))
        sizes = each.groupBy("key").agg(
            F.sum("n_ids").alias("n"),
            ((F.sum("n_ids") * F.sum("n_ids") - F.sum(F.col("n_ids") * F.col("n_ids"))) / 2).alias("pairs"),
            F.max_by(F.struct("hub", F.col("component").alias("of")), F.struct("n_ids", -F.col("rare"), F.xxhash64("hub.id"))).alias("hub"),
        )
        open_ = materialize(sizes.where("pairs > 0"))
        todo = open_.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        if not todo["p"]:
            break
        last = wave > HUBS or todo["p"] <= LIST * todo["n"]
        if last:
            near = _between(at.join(open_.select("key", "hub.of"), "key"), lists, marks)
        else:
            long_ = open_.select("key", F.col("hub.hub.id").alias("hub"), F.col("hub.hub.n").alias("hub_n"), F.col("hub.hub.reach").alias("hub_reach"), "hub.of")
            held = at.join(long_, "key").where("component <> of and n <= hub_reach and hub_n <= reach")
            near = colliding(held.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), marks)
            left = materialize(left.join(long_.select("key"), "key", "left_semi"))
        found = materialize(confirm(near, sets, percent))
        if not found.isEmpty():
            known = links if component is None else component.select(F.col("id").alias("a"), F.col("component").alias("b"))
            component = _components(found if known is None else known.union(found))
        if last:
            break
    named = classes.select("digest", "id")
    if component is not None:
        named = named.join(component, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    else:
        named = named.select("digest", F.col("id").alias("component"))
    out = own.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", linked.alias("component_id"), F.coalesce(F.col("doc_id") == linked, F.lit(True)).alias("kept"))


def _between(at: DataFrame, lists: DataFrame, marks: DataFrame) -> DataFrame:
    """Candidate pairs between the components of each list of at (key, id, component, n, reach, of). Each document outside
    of, the largest component of its list, meets the others. A pair is made in one list only, the first that both are in,
    and only if it collides and each is in the other's reach."""
    keys = lists.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # two prefixes at most, as a rule one
    y = at.select("key", "id", "component", "n", "reach", "of").join(keys, "id").join(marks, "id")
    x = y.where("component <> of")
    y = y.select(F.col("key").alias("key_2"), *[F.col(c).alias(f"{c}_2") for c in ("id", "component", "n", "reach", "keys", "sig", "bits")])
    near = ((F.col("component_2") == F.col("of")) | (F.col("component") < F.col("component_2"))) & (F.col("n") <= F.col("reach_2")) & (F.col("n_2") <= F.col("reach"))
    near = near & collide("", "_2") & (F.array_min(F.array_intersect("keys", "keys_2")) == F.col("key"))
    return x.join(y, (F.col("key") == F.col("key_2")) & near).select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")).distinct()


def _at(ids: DataFrame, component: DataFrame | None, name: str, to: str) -> DataFrame:
    """ids with the component of column name as column to; without links each id is its own."""
    if component is None:
        return ids.withColumn(to, F.col(name))
    return ids.join(component.select(F.col("id").alias(name), F.col("component").alias(to)), name, "left").withColumn(to, F.coalesce(to, name))


def _components(links: DataFrame | None) -> DataFrame | None:
    return None if links is None or links.isEmpty() else connected_components(links)


def _shared_ids(real: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the classes of rows that share a doc_id."""
    again = materialize(real.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return None
    return materialize(real.join(again, "doc_id").join(classes.select("digest", "id"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct())


def op4_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4)
