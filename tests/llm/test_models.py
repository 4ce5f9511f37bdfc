"""CRF, language ID, toxicity, secrets, byte pairs and the pipeline."""

import hashlib
import itertools
import os
import random
import re
import zlib
from array import array

import numpy as np
import pytest

import corpus_pipeline
from chronolith.llm import byte_bpe, crf, language_id, queries, secret_scan, toxicity

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_crf_equals_enumeration():
    rng = np.random.default_rng(0)
    trans, first, lengths = rng.normal(size=(3, 3)), rng.normal(size=3), np.array([1, 4, 3])
    em = rng.normal(size=(8, 3))
    gamma, xi, begin, logz = crf.forward_backward(em, trans, first, lengths, pairs=True)
    best = crf.viterbi(em, trans, first, lengths)
    total, at = 0.0, 0
    pairs = np.zeros((3, 3))
    for n in lengths:
        e = em[at : at + n]
        paths = list(itertools.product(range(3), repeat=int(n)))
        s = np.array([first[p[0]] + sum(e[i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
        w = np.exp(s) / np.exp(s).sum()
        total += np.log(np.exp(s).sum())
        for i in range(n):
            assert np.allclose([w[[p[i] == y for p in paths]].sum() for y in range(3)], gamma[at + i])
        for p, x in zip(paths, w):
            for a, b in zip(p, p[1:]):
                pairs[a, b] += x
        assert tuple(best[at : at + n]) == paths[int(s.argmax())]
        at += n
    assert np.allclose(total, logz) and np.allclose(pairs, xi)
    assert len(crf.forward_backward(em[:0], trans, first, np.zeros(0, int))) == 0


def test_marginals_in_parts_equal_whole_sequences():
    rng = np.random.default_rng(3)
    trans, first, lengths = rng.normal(size=(4, 4)) * 3, rng.normal(size=4), np.array([5, 0, 1, 64, 65, 300, 0, 128, 7, 129])
    em = rng.normal(size=(lengths.sum(), 4)) * 20
    want = crf.forward_backward(em, trans, first, lengths)
    for part in (1, 5, 64, 1000):
        assert np.allclose(crf.marginals(em, trans, first, lengths, part=part), want, atol=1e-9)
    assert np.allclose(crf.marginals(em.astype(np.float32), trans, first, lengths), want, atol=1e-3)
    assert len(crf.marginals(em[:0], trans, first, lengths[:0])) == 0 == len(crf.marginals(em[:0], trans, first, np.zeros(2, int)))


def test_language_of_long_texts_and_new_words_in_few_steps(monkeypatch):
    rng = random.Random(5)
    weights = np.random.default_rng(5).normal(size=(language_id.FEATURES, 3)).astype(np.float32)
    model = language_id.Model(["a", "b", "c"], weights, np.eye(3) * 2, np.zeros(3))
    words = ["x", "xx", "xxxx", "\U00010400b", "é" * 70, "a\u0301b", *("".join(rng.choices("abcdeß", k=rng.randrange(1, 12))) for _ in range(6000))]
    em = np.array([weights[language_id.word_features(w)].astype(float).sum(axis=0) for w in words])
    want = crf.forward_backward(em, model.trans, model.first, np.array([len(words) - 3, 3]))
    hashed, steps = [], []
    crc32, rows = zlib.crc32, crf.Layout.rows
    monkeypatch.setattr(language_id.zlib, "crc32", lambda x: hashed.append(x) or crc32(x))
    monkeypatch.setattr(crf.Layout, "rows", lambda self, t: steps.append(t) or rows(self, t))
    got = language_id.Labeller(model).marginals([words[:-3], words[-3:]])
    assert np.allclose(got, want, atol=1e-3)
    assert len(hashed) < 2 * len(words) and len(steps) < len(words) / 10


def _documents(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@needs_data
def test_language_on_held_out_rows(spark):
    docs = _documents(spark)
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 20 and sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, "the thing"), (5, "the of and " * 20_000)], "doc_id long, text string")
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[5][0] == "en" and 0 <= out[None][1] <= 1
    none = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}
    halves = [(lang, next(r["text"] for r in docs.collect() if r["lang"] == lang and len(r["text"]) > 800)[:700]) for lang in ("de", "es")]
    find = language_id.Labeller(model).find
    truth = [lang for lang, text in halves for _ in find(text)]
    gamma = language_id.Labeller(model).marginals([[w for _, text in halves for w in find(text.lower())]])
    right = [model.langs[i] == lang for i, lang in zip(gamma.argmax(axis=1), truth)]
    assert len(right) == len(truth) and sum(right) >= 0.95 * len(right)


def test_toxicity_learns_pairs_that_lines_miss():
    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices([f"w{i}" for i in range(200)], k=20) + ["crooks"] * insult + ["farmers"] * group
        rows.append((int(insult == group), np.array(sorted({t for w in set(words) for t in toxicity.word_terms(w)}), np.uint32)))
    keep = {t for w in ("crooks", "farmers") for t in toxicity.word_terms(w)}
    n = {t: i for i, t in enumerate(sorted(keep))}
    model = toxicity.learn(rows + [(1, np.array(sorted(keep), np.uint32))] * 400 + [(0, np.array(toxicity.word_terms("crooks"), np.uint32))] * 400 + [(0, np.array(toxicity.word_terms("farmers"), np.uint32))] * 400)
    score = lambda *w: model.score(np.array(sorted({model.column[t] for x in w for t in toxicity.word_terms(x) if t in model.column}), int))
    assert score("crooks", "farmers") > 0.6 > 0.4 > max(score("crooks"), score("farmers")) and len(n) >= 4


@needs_data
def test_toxicity_of_odd_rows(spark):
    docs, labels = _documents(spark), _documents(spark, "labels")
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x", 0.5)], "doc_id long, text string, score double")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in toxicity.score_toxicity(odd, model).collect())
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] < 1e-6 for r in toxicity.score_toxicity(odd, none).collect()} == {True}


def base(text):
    out = []
    kinds = [(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]
    for k, (pattern, group, least) in enumerate(kinds):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(out)


def test_base_spans_equal_brute_force():
    rng = random.Random(7)
    bits = ["token", "API_KEY", "Secret", "pass", "word", "passwd", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH", "12345678", "abcdef", "deadbeef", "é", "\n", "ſecret", "toKen", "/x+"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randrange(25)))
        assert [(a, k, b) for a, k, b, _ in secret_scan.base_spans(text)] == base(text), text


@needs_data
def test_secrets_of_rows(spark):
    docs = _documents(spark)
    model = secret_scan.fit(docs)
    texts = [None, "", "see ghp_abcDEF0123456789abcDEF0123456789abcd now", 'token = "24be64439e3e49cf46b2d7c90f3602a3" x', "plain words only. " * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[3], "x")], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(df, model).collect()}
    for i, t in enumerate(texts):
        names = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base(t))
        assert got[i]["base_sha256"] == hashlib.sha256(names.encode()).hexdigest()
    assert got[2]["spans"] == "crf:4:44" and got[4]["spans"] == "" and got[None]["n_assign"] == 1
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(df, model).collect()}
    assert clean[0] is None and clean[2] == "see [SECRET] now" and clean[3] == 'token = "[SECRET]" x' and clean[4] == texts[4]
    assert secret_scan.find_secrets(df.limit(0), secret_scan.fit(docs.limit(0))).count() == 0


def test_byte_pairs_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    data = byte_bpe.rank_file(P.path("byte_bpe_multi_50k.tiktoken"))
    own = byte_bpe.Codec(data, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["", None, "a" * 3000, " " * 999 + "x", "⁇ unknown <unk> ▁", "I'm here\r\n\t 12,345 €"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 600), rng.randrange(0x4E00, 0x4F00), rng.randrange(0x1F600, 0x1F640), 10, 32])) for _ in range(rng.randrange(150))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in byte_bpe.encode_texts(df, data, P.PATTERN).collect():
        text = texts[r["doc_id"]] or ""
        ids = lib.encode_ordinary(text)
        assert list(array("I", bytes(r["ids"]))) == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    with pytest.raises(ValueError):
        byte_bpe.serialise({b"a": 0})


@needs_data
def test_pipeline_stages(spark, tmp_path):
    docs = _documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == corpus_pipeline.COLUMNS
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = out
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the thing of and that", None, None, None)], _documents(spark).schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).count() <= 3


def test_queries_and_sql_agree_on_names():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries.queries()}
