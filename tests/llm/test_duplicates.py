"""Near duplicates, repeated passages and contamination against brute force."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from chronolith.llm import common, components, decontaminate, minhash_dedup, substring_dedup

DOC = "doc_id long, text string, n_words string, row_id string"


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        text = rng.choices(words, k=rng.randrange(30, 120))
        texts.append(text)
        for _ in range(rng.randrange(0, 9)):
            copy = list(text)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    passage = rng.choices(words, k=20)
    texts += [rng.choices(words, k=30) + passage + rng.choices(words, k=30) for _ in range(30)]
    texts = [rng.choice(" \n").join(t) for t in texts] + ["a b c", "A B C", "a b", "", None, "   ", "same text here now", "same text here now", "x " * 3000]
    rng.shuffle(texts)
    return texts


def truth(rows, k):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), d == find(d)) for d in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rows = list(enumerate(corpus(k)))
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], DOC)
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash_dedup.near_duplicates(docs, shingle=k).collect()}
    assert got == truth(rows, k)


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (5, "a b c d"), (5, "q r s t"), (7, "q r s t"), (7, "q r s t")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs).where("doc_id is not null").collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (7, 3, False)]
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(9)
    text = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(300):
        copy = list(text)
        copy[rng.randrange(150)] = f"x{d}"
        rows.append((d, " ".join(copy)))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4)
    assert {r["component_id"] for r in got.collect()} == {0}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or x in got}


def removed(rows):
    first, out = {}, []
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 12):
            if d is not None:
                key = tuple(w[i : i + 13])
                first[key] = min(first.get(key, d), d)
    for d, w in split:
        gone = {i + k for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for k in range(13)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


def test_repeats_equal_brute_force(spark, monkeypatch):
    rows = list(enumerate(corpus(3))) + [(None, "w " * 20), (None, "w " * 20)]
    rows += [(500, "p " * 20), (500, "q " * 20), (500, "p " * 20), (501, "p " * 20)]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], DOC).repartition(4)
    want = removed(rows)
    assert sorted((tuple(r) for r in substring_dedup.remove_repeats(docs).collect()), key=repr) == want
    monkeypatch.setattr(substring_dedup, "SETTLED", 50)
    monkeypatch.setattr(substring_dedup, "BROADCAST_IDS", -1)
    assert sorted((tuple(r) for r in substring_dedup.remove_repeats(docs).collect()), key=repr) == want
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_contamination(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(20, 60)))) for i in range(30)] + [(90, "two words"), (91, ""), (92, None), (None, "w1 w2")]
    docs, want = [], set()
    for d in range(80):
        text = rng.choices(words, k=60)
        if d % 3 == 0:
            i = rng.randrange(30)
            part = items[i][1].upper().split()
            if d % 2 and len(part) > 55:
                part[20] = "changed"
            text[20:20] = [f"{w}," for w in part]
            want.add((d, i))
        docs.append((d, " ".join(text)))
    docs += [(100, "exactly two, WORDS here"), (101, None), (102, ""), (None, items[0][1]), (103, f"{items[3][1]} {items[3][1]}"), (103, items[3][1])]
    docs += [(104, " ".join(rng.choices(words, k=40_000)) + " " + items[7][1])]
    want |= {(None, 0), (103, 3), (104, 7)}
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    found = decontaminate.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and min(r["similarity"] for r in found) >= 0.8
    assert next(r["first_word"] for r in found if r["doc_id"] == 103) == 0  # of equal windows the first
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 == decontaminate.contaminated(df.limit(0), bench).count()
    assert {r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_every_fingerprint_in_the_radius_is_found():
    index = decontaminate.Index([(i, " ".join(f"u{i}x{j}" for j in range(24))) for i in range(50)])
    group = index.groups[20]
    rng = random.Random(6)
    prints = []
    for _ in range(300):
        p = int(group.prints[rng.randrange(50)])
        for bit in rng.sample(range(64), rng.randrange(0, 30)):
            p ^= 1 << bit
        prints.append(p)
    near = {(i, k) for i, p in enumerate(prints) for k, q in enumerate(group.prints) if (int(q) ^ p).bit_count() <= decontaminate.RADIUS}
    place, item = group.near(np.array(prints, np.uint64))
    assert set(zip(place.tolist(), item.tolist())) == near
    # the index selects: few random fingerprints share a listed block value with an item
    listed = np.diff(group.starts)[(np.random.default_rng(1).integers(0, 1 << 64, 5_000, dtype=np.uint64).view(np.uint16).reshape(-1, 4) + decontaminate._TABLE)]
    assert listed.sum() / 5_000 / 50 < 0.05


@pytest.mark.parametrize("n", [1, 20, decontaminate.FEW, decontaminate.FEW + 1, 300])
def test_few_fingerprints_are_compared_and_none_is_missed(monkeypatch, n):
    rng = random.Random(n)
    group = decontaminate.Group()
    group.items, group.sizes, group.prints = list(range(n)), [20] * n, [rng.getrandbits(64) for _ in range(n)]
    group.close()
    prints = [rng.getrandbits(64) for _ in range(2_000)]
    for distance in range(24):
        for _ in range(10):
            p = group.prints[rng.randrange(n)].item()
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), distance)))
    want = [(i, k) for i, p in enumerate(prints) for k, q in enumerate(group.prints.tolist()) if (p ^ q).bit_count() <= decontaminate.RADIUS]
    compared, compare = [], group._compared
    monkeypatch.setattr(group, "_compared", lambda prints, at: compared.append(at) or compare(prints, at))
    for at_once in (decontaminate.COMPARED_AT_ONCE, 900):
        monkeypatch.setattr(decontaminate, "COMPARED_AT_ONCE", at_once)
        assert list(zip(*(x.tolist() for x in group.near(np.array(prints, np.uint64))))) == want
    # lists of blocks alone have 57 % of random fingerprints compared with some of 20 items
    assert n > 20 or sum((at < 2_000).sum() for at in compared) / 2 < 0.25 * 2_000
    assert [x.tolist() for x in group.near(np.zeros(0, np.uint64))] == [[], []]
    assert hasattr(group, "starts") == (n > decontaminate.FEW)  # lists that are not read take no memory


@pytest.mark.parametrize("most", [61, 255, 256, 700])
def test_fingerprints_of_every_width(monkeypatch, most):
    hashes = np.random.default_rng(most).integers(0, 1 << 64, 3 * most, dtype=np.uint64) | np.uint64(1 << 63 | 0xFFFF)  # fields that run over
    total = decontaminate.sums(hashes, most)
    for width, at_once in ((1, 4_096), (2, 100), (most - 1, 7), (most, 4_096)):
        monkeypatch.setattr(decontaminate, "PRINTS_AT_ONCE", at_once)
        bits = hashes[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
        want = [sum(1 << b for b in range(64) if 2 * int(c[b]) >= width) for c in (bits[i : i + width].sum(axis=0) for i in range(len(hashes) - width + 1))]
        assert decontaminate.fingerprints(total, width).tolist() == want


def test_windows_lack_less_than_an_eighth_of_an_item():
    assert all(decontaminate.rounded(n) == n for n in range(1, 17))
    assert all(0 <= n - decontaminate.rounded(n) < n / 8 for n in range(1, 3000))
    assert len({decontaminate.rounded(n) for n in range(1, 100_000)}) < 100


def test_windows_against_brute_force():
    """All windows and items: fingerprints bit by bit in Python integers, similarity from Counters of word tuples."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([5, 9, 30, 33, 61])))) for i in range(12)]
    texts = []
    for i in range(40):
        part = items[i % 12][1].split()
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = "other"
        texts.append(" ".join(rng.choices(words, k=rng.randrange(20)) + part + rng.choices(words, k=rng.randrange(20))))
    index = decontaminate.Index(items)
    hashed = {}

    def bag(own):
        grams = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
        for g, h in zip(grams, decontaminate.shingles(index.words(" ".join(own))).tolist()):
            hashed[g] = h
        return grams

    def simhash(grams):
        return sum((2 * sum(hashed[g] >> b & 1 for g in grams) >= len(grams)) << b for b in range(64))

    want = []
    for text in texts:
        own, best = text.split(), {}
        grams = bag(own)
        for item, of in items:
            theirs = bag(of.split())
            size, width = len(theirs), decontaminate.rounded(len(theirs))
            ours = simhash(theirs[:width])
            for p in range(len(grams) - size + 1):
                if (simhash(grams[p : p + width]) ^ ours).bit_count() <= decontaminate.RADIUS:
                    a, b = Counter(grams[p : p + size]), Counter(theirs)
                    sim = (a & b).total() / (a | b).total()
                    if sim >= 0.8 and (item not in best or (-sim, p) < (-best[item][0], best[item][1])):
                        best[item] = (sim, p, size + 4)
        want.append(best)
    assert index.search(texts) == want and sum(map(len, want)) > 12


def test_materialize_and_discard(spark):
    df = common.materialize(spark.range(5))
    assert df.count() == 5
    common.discard(df)
