"""URL filters, quality rules and chat formatting against plain Python."""

import hashlib
import random
import re

from chronolith.llm import chat_format, quality_rules, url_filters

RULES = "host string, path string, verdict string"


def judge(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in raw)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls_equal_brute_force(spark):
    rng = random.Random(3)
    labels = ["a", "b", "example", "com", "org"]
    rules = list({(".".join(rng.choices(labels, k=rng.randrange(1, 4))), rng.choice(["/", "", "/x", "/x/", "/x/1"])): rng.choice(["allow", "block"]) for _ in range(40)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = ["http://" + ".".join(rng.choices(labels, k=rng.randrange(1, 5))) + rng.choice(["", "/", "/x", "/x/12", "?q", "#f", "/x?/y"]) for _ in range(300)]
    urls += [None, "", "no scheme", "://", "http://A.ORG/x", "http://org./x", "a://b://c/x"] + ["http://a.org/x"] * 50
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filters.judge_urls(pages, spark.createDataFrame(rules, RULES)).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}


def test_urls_without_rules_rows_or_ids(spark):
    none = spark.createDataFrame([], RULES)
    pages = spark.createDataFrame([(None, "http://a.org/"), (1, "http://a.org/"), (1, "http://a.org/")], "page_id long, url string")
    assert [r["verdict"] for r in url_filters.judge_urls(pages, none).collect()] == ["allow"] * 3
    assert url_filters.judge_urls(pages.limit(0), none).count() == 0
    both = spark.createDataFrame([("org", "/", "allow"), ("org", "/", "block")], RULES)
    assert {r["verdict"] for r in url_filters.judge_urls(pages, both).collect()} == {"block"}


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t ", "a b c", "a a a a a", "x y z x y z", "é\u00a0ü # $ *\n\nline\nline\nline \r\n", "the cat sat on the cat sat on the mat", "w " * 5000, "\x0b".join(map(str, range(200)))]


def test_base_rules_equal_brute_force(spark):
    rng = random.Random(1)
    texts = TEXTS + [rng.choice(" \n").join(rng.choices(["a", "b", "c", "#", "é|"], k=rng.randrange(120))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    ratios = [0] * 64
    rows = quality_rules.judge_quality(docs, ratios).collect()
    for r in rows:
        n = base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and r["kept"] == (not r["base_failed"])


def test_ratio_tells_target_from_the_rest(spark):
    rng = random.Random(5)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    texts = [" ".join(rng.choices(good if i % 2 else bad, k=80)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    table = quality_rules.ratio_table(docs, labels, buckets=4096)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge_quality(docs, table).collect()}
    assert all(kept[i] == bool(i % 2) for i in range(60))
    assert quality_rules.ratio_table(docs, labels.limit(0), buckets=8) == [0] * 8
    assert quality_rules.judge_quality(docs.limit(0), table).count() == 0


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<s>\\<\\\\[/INST]\\"), (2, 0, "assistant", "x"), (2, 1, None, None), (2, 2, "tool[/ROLE]", "é\n"), (None, 0, "system", "s"), (None, 1, "user", "")]
    t = chat_format.Template()
    controls = [c for pair in t.turns.values() for c in pair]
    for text in [r[3] or "" for r in rows] + ["".join(random.Random(i).choices("<[\\/sINT]>", k=30)) for i in range(300)]:
        assert t.restore(t.protect(text)) == text and not any(c in t.protect(text) for c in controls)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.digest_chats(chat_format.format_chats(df)).collect()}
    for conv in (1, 2, None):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(x for role, x in own if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert (got[1]["in_order"], got[2]["in_order"], got[None]["in_order"]) == (True, False, True)
    assert chat_format.digest_chats(chat_format.format_chats(df.limit(0))).count() == 0
