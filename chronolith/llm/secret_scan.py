"""Secret scans: exact base patterns, and a linear-chain conditional random field that adds what they miss.

The field tags every token of a text as begin (B), inside (I) or outside (O) of a secret, from the token's shape, the
words around it and features of the file, and is decoded by Viterbi. What a token and its neighbours add to the scores
is kept for each distinct token. A token whose score for O is so far ahead that no neighbour can make B or I the
better choice is outside on the best path, so the path is found exactly by decoding what lies between such tokens.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import Shared, fresh, structs, table, text_udf
from .minhash_dedup import mix

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

TOKEN = re.compile(r"[^\W_][\w+/.~-]*(?:={1,2}(?!\w))?|[^\w\s]|_")
FEATURES = 1 << 15
#: Distinct tokens that a worker keeps the scores of, characters of the longest of them, and characters of text that
#: are tagged at once (a longer text is tagged whole, by itself). None of these changes a result.
CACHE, CACHED_CHARS, CHARS_AT_ONCE = 120_000, 64, 500_000
#: Documents that the field is trained on (half of them with base spans), those that they are chosen from (about so
#: many), words taken of each, and made-up secrets and other tokens among them.
SAMPLE_DOCS, POOL_DOCS, SAMPLE_WORDS, SYNTHETIC = 1_000, 20_000, 120, 3_000
POSSIBLE = r"(?i)(passw|secret|token|api_?key)[^\n]{0,4}[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
#: Offsets of the neighbours whose words are features.
NEAR, ROOM = (-3, -2, -1, 1), 3
MARKS = "+/=.~_-"


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, where the secret itself begins), sorted. Each kind leftmost and non-overlapping."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_MAP):
        out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]  # a run of 24 or more is a whole maximal run
    return sorted(out)


def number(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


def numbers(kind: int, value: np.ndarray) -> np.ndarray:
    """Feature numbers of values of one kind of feature."""
    return (mix(np.asarray(value).astype(np.uint64) * np.uint64(64) + np.uint64(kind)) % np.uint64(FEATURES)).astype(np.int64)


def kind_of(char: str) -> int:
    """0 digit, 1 upper case, 2 other letter, then each of MARKS, then other characters; below 64."""
    return 0 if char.isdigit() else 1 if char.isupper() else 2 if char.isalpha() else 3 + MARKS.index(char) if char in MARKS else 10 + ord(char) % 54


_KIND = np.array([kind_of(chr(i)) for i in range(128)], np.uint8)
_VOWEL, _HEX_DIGIT = (np.array([chr(i) in x for i in range(128)]) for x in ("aeiouyAEIOUY", "0123456789abcdef"))


def points_of(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all tokens (none empty), how many each has, and where each begins."""
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32), n, np.cumsum(n) - n


def kinds_of(points: np.ndarray) -> np.ndarray:
    kind = _KIND[np.minimum(points, 127)]
    other = np.flatnonzero(points > 127)
    if len(other):
        seen, where = np.unique(points[other], return_inverse=True)
        kind[other] = np.array([kind_of(chr(c)) for c in seen.tolist()], np.uint8)[where]
    return kind


def word_hashes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased tokens, of their first four characters and of their last three."""
    points, n, start = points_of([t.lower() for t in tokens])
    nth = np.arange(len(points)) - np.repeat(start, n)
    placed = mix(points + (nth.astype(np.uint64) << np.uint64(21)))
    last = np.repeat(n, n) - nth
    ends = mix(points + (last.astype(np.uint64) << np.uint64(21)))
    return np.add.reduceat(placed, start), np.add.reduceat(placed * (nth < 4), start), np.add.reduceat(ends * (last <= 3), start)


def token_numbers(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each token, of its whole length: the numbers of its own features (shape with runs shortened to one, or the
    kinds in it where there are more than 12 runs; how often the kind changes; which kinds; shares of digits and vowels;
    distinct characters; hexadecimal; beginning, end, marks, the word itself; one that all have), and the word's hash."""
    points, n, start = points_of(tokens)
    own = np.repeat(np.arange(len(tokens)), n)
    count = lambda what: np.add.reduceat(what, start, dtype=np.int64)
    kind, low = kinds_of(points), np.minimum(points, 127)
    change = np.ones(len(points), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[start] = True
    nth = np.cumsum(change)
    nth -= (nth[start] - 1)[own]
    runs, present = count(change), np.bitwise_or.reduceat(np.uint64(1) << kind.astype(np.uint64), start)
    form = np.add.reduceat(mix(kind + (nth.astype(np.uint64) << np.uint64(6))) * change, start)
    word, begins, ends = word_hashes(tokens)
    distinct = np.bincount(np.unique((own << 21) | points) >> 21, minlength=len(tokens))
    size = np.minimum(n // 4, 12)
    sized = lambda value: value.astype(np.uint64) * np.uint64(16) + size.astype(np.uint64)
    marks = (present >> np.uint64(3)) & np.uint64((1 << len(MARKS)) - 1)
    values = [
        np.where(runs <= 12, form, mix(present)),
        sized(np.minimum(runs // 2, 12)),
        sized(mix(present)),
        4 * count(kind == 0) // n,
        sized(8 * count(_VOWEL[low]) // n),
        sized(np.minimum(distinct // 4, 8)),
        sized(count(_HEX_DIGIT[low]) == n),
        begins,
        sized(ends),
        marks * np.uint64(4) + np.minimum(n // 16, 3).astype(np.uint64),
        word,
        np.zeros(len(tokens), np.int64),
    ]
    return np.stack([numbers(i, v) for i, v in enumerate(values)], axis=1), word


def near_numbers(word: np.ndarray) -> np.ndarray:
    """The features of being the word at each of NEAR; 0 is no word."""
    return np.stack([numbers(20 + j, word) for j in range(len(NEAR))], axis=1)


def pair_numbers(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The feature of two words in a row."""
    return numbers(40, before * np.uint64(3) + last)


def document_numbers(text: str) -> list[int]:
    low = text.lower()
    return [number(f"file {k}") for k in ("key", "secret", "token", "passw", "bearer", "auth") if k in low] + [number(f"file = {min(text.count('='), 4)}")]


def places(sizes: list[int]) -> np.ndarray:
    """Where the tokens of texts of these sizes stand in a row that keeps ROOM places free around every text."""
    sizes = np.asarray(sizes, np.int64)
    return np.arange(sizes.sum()) + np.repeat(np.arange(1, len(sizes) + 1) * ROOM, sizes)


def features_of(texts: list[list[str]], of_file: list[list[int]]) -> list[np.ndarray]:
    """Feature numbers of each token of each text."""
    tokens = [t for text in texts for t in text]
    if not tokens:
        return []
    sizes = [len(t) for t in texts]
    at = places(sizes)
    own, word = token_numbers(tokens)
    row = np.zeros(len(tokens) + (len(texts) + 1) * ROOM, np.uint64)
    row[at] = word
    near = np.stack([numbers(20 + j, row[at + k]) for j, k in enumerate(NEAR)], axis=1)
    both = np.concatenate([own, near, pair_numbers(row[at - 2], row[at - 1])[:, None]], axis=1)
    files = [np.array(f, np.int64) for f, n in zip(of_file, sizes) for _ in range(n)]
    return [np.concatenate(x) for x in zip(both, files)]


def tags(spans: list[tuple[int, int]], secrets: list[tuple[int, int]]) -> list[int]:
    """0 outside, 1 begin, 2 inside of each token, by what of it lies in a secret."""
    out, now = [], None
    for a, b in spans:
        hit = next((s for s in secrets if s[0] < b and a < s[1]), None)
        out.append(0 if hit is None else 2 if hit == now else 1)
        now = hit
    return out


def made_up(rng: random.Random) -> tuple[str, bool]:
    """A token-like string and whether it is a secret."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word, mixed = string.ascii_lowercase, string.ascii_letters + string.digits
    secret = [
        lambda: "ghp_" + pick(mixed, 36),
        lambda: "sk_live_" + pick(mixed, 24),
        lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(mixed, 24),
        lambda: pick(mixed + "+/", 40) + "==",
        lambda: "eyJ" + pick(mixed, 30) + "." + pick(mixed, 40) + "." + pick(mixed + "_-", 40),
        lambda: pick(mixed, rng.randrange(20, 48)),
        lambda: pick("0123456789abcdef", 32),
        lambda: pick(word, rng.randrange(14, 24)),
        lambda: "-".join(pick(word, 4) for _ in range(rng.randrange(3, 6))),
        lambda: pick(string.ascii_uppercase + "234567", 8 * rng.randrange(2, 5)),
        lambda: pick(string.ascii_uppercase, 24),
        lambda: pick(string.digits, rng.randrange(24, 40)),
    ]
    other = [
        lambda: pick(word, 6) + "." + pick(string.digits, 2),
        lambda: pick(string.digits, rng.randrange(1, 17)),
        lambda: f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: f"v{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(20)}",
        lambda: "www." + pick(word, 8) + ".com/" + pick(word, 5) + "/" + pick(string.digits, 3),
        lambda: pick(word, 5) + "_" + pick(word, 6),
        lambda: pick(word, 4) + pick(string.ascii_uppercase, 1) + pick(word, 5),
        lambda: pick(word, 7) + str(rng.randrange(100)),
    ]
    good = rng.random() < 0.5
    return rng.choice(secret if good else other)(), good


def training_rows(texts: list[str], seed: int = 13):
    """Feature numbers, tags and run lengths: the texts tagged by their base spans, and pieces of them with made-up
    tokens put in after an introduction (key words before secrets and others alike; pass phrases are words of the texts)."""
    rng = random.Random(seed)
    tokens, of_file, labels = [], [], []

    def add(text, secrets):
        spans = [m.span() for m in TOKEN.finditer(text)]
        if spans:
            tokens.append([text[a:b] for a, b in spans])
            of_file.append(document_numbers(text))
            labels.extend(tags(spans, secrets))

    for text in texts:
        add(text, [(s[3], s[2]) for s in base_spans(text)])
    split = [t.split() for t in texts if t.strip()]
    keys = ["key: ", "key = \"", "Authorization: Bearer ", "auth=", "pwd: ", "credentials ", "login with ", "pass: "]
    plain = ["call ", "on ", "id ", "see ", "id: ", "n = ", "about ", "with "]
    for i in range(SYNTHETIC if split else 0):
        words = rng.choice(split)
        at = rng.randrange(max(1, len(words) - 12))
        piece = " ".join(words[at : at + 12])
        if base_spans(piece):
            continue
        token, good = made_up(rng)
        if i % 12 == 0:  # a pass phrase, or as many words after another introduction
            good = i % 24 == 0
            token = " ".join(w for w in rng.choice(split)[:200] if w.isalpha() and w.islower() and len(w) < 10)
            token = " ".join(rng.sample(token.split(), min(4, len(token.split()))))
            if not token:
                continue
            intro = rng.choice(["passphrase: ", "pass phrase is ", "mnemonic: "] if good else ["phrase: ", "the phrase is ", "note: "])
        elif token.isalpha() and good:
            intro = rng.choice(keys)
        elif i % 6 == 2:  # words run together are secrets after a key word only
            token, good = "".join(rng.choices(words, k=rng.randrange(2, 5))), rng.random() < 0.3
            intro = rng.choice(keys if good else [*plain, "", ""])
        elif i % 12 == 3:  # a word over and over is none
            token, good, intro = " ".join([rng.choice(words)] * rng.randrange(3, 20)), False, ""
        elif i % 6 == 1:  # an ordinary word after a key word is no secret
            token, good, intro = rng.choice(words), False, rng.choice(keys)
        else:
            intro = rng.choice([*keys, "", ""] if good else [*plain, "", ""])
        cut = rng.randrange(len(piece) + 1) if piece else 0
        head = f"{piece[:cut]} {intro}"
        add(f"{head}{token} {piece[cut:]}", [(len(head), len(head) + len(token))] if good else [])
    return features_of(tokens, of_file), np.array(labels, np.int64), np.array([len(t) for t in tokens], np.int64)


class Model:
    """weights and transitions; gap: by how much the score of O must be ahead to be outside whatever the neighbours are."""

    def __init__(self, weights, trans, first):
        self.weights, self.trans, self.first = weights.astype(np.float32), trans.copy(), first.copy()
        self.trans[0, 2] = self.first[2] = -50.0  # inside does not follow outside
        t, f = self.trans, self.first
        before = max(*(t[a, x] - t[a, 0] for a in range(3) for x in (1, 2)), f[1] - f[0], f[2] - f[0])
        # the next is not I, or it is I and becomes B, with the transition after it
        self.gap_next = before + max(0.0, *(t[x, c] - t[0, c] for x in (1, 2) for c in (0, 1)))
        self.gap_inside = before + max(t[x, 2] - t[0, 1] for x in (1, 2)) + max(0.0, *(t[2, d] - t[1, d] for d in range(3)))


def piece_of(text: str, limit: int) -> str:
    """At most limit words in a row: around the first base span if there is one, else from a place the text decides."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    if len(words) <= limit:
        return text
    spans = base_spans(text)
    at = next((i for i, w in enumerate(words) if w[1] > spans[0][0]), 0) - limit // 2 if spans else zlib.crc32(text.encode("utf-8", "surrogatepass")) % (len(words) - limit + 1)
    at = min(max(at, 0), len(words) - limit)
    return text[words[at][0] : words[at + limit - 1][1]]


def fit(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS, pool: int = POOL_DOCS) -> Model:
    """Learn from pieces of sample_docs documents, of sample_words words each at most, half of them (or all there are)
    such in which a base pattern may occur. They are taken from about pool documents: a fixed fraction by the hash of
    doc_id and text, in the order of that hash. Texts are of any length; labels are the base spans and made-up secrets."""
    rows = docs.where(F.col("text").isNotNull())
    u = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 30))
    part = int((1 << 30) * min(1.0, pool / max(1, rows.count())))
    cut = text_udf("secret pieces", sample_words, lambda: None, lambda _, texts: pa.array([piece_of(t.as_py(), sample_words) for t in texts], pa.string()), "string")
    rows = rows.select("text", u.alias("u")).where(F.col("u") < part).select("u", "text", F.col("text").rlike(POSSIBLE).alias("hit"))
    texts = []
    for hit in (True, False):
        few = rows.where("hit" if hit else "not hit").orderBy("u", "text").limit(sample_docs // 2)
        texts += [r["piece"] for r in few.select("u", cut("text").alias("piece")).collect()]
    features, labels, runs = training_rows(texts)
    if not len(runs):
        return Model(np.zeros((FEATURES, 3)), np.zeros((3, 3)), np.zeros(3))
    return Model(*crf.train(features, labels, runs, FEATURES, 3, epochs=5))


class Scanner:
    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self):
        """known: token to its number; of each number the scores it adds to its own place, those to places by NEAR, and
        the hash of its word. Number 0 is no token."""
        self.known: dict[str, int] = {"": 0}
        self.passing: list[str] = []
        self.word = np.zeros(1, np.uint64)
        self.own, self.near = np.zeros((1, 3), np.float32), self.model.weights[near_numbers(self.word)]

    def numbers(self, tokens: list[str]) -> np.ndarray:
        for t in self.passing:
            del self.known[t]
        n = len(self.known)
        self.own, self.near, self.word, self.passing = self.own[:n], self.near[:n], self.word[:n], []
        known = self.known
        new = sorted(set(tokens).difference(known), key=lambda t: len(t) > CACHED_CHARS)  # those not kept come last
        if new:
            if n + len(new) > CACHE and n > 1:
                self.clear()
                return self.numbers(tokens)
            w = self.model.weights
            own, word = token_numbers(new)
            self.own = np.concatenate([self.own, w[own].sum(axis=1)])
            self.near = np.concatenate([self.near, w[near_numbers(word)]])
            self.word = np.concatenate([self.word, word])
            known.update(zip(new, range(n, n + len(new))))
            self.passing = [t for t in new if len(t) > CACHED_CHARS]
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def emissions(self, texts: list[str], tokens: list[list[str]]) -> np.ndarray:
        """Scores of the tags of every token, text after text."""
        sizes = [len(t) for t in tokens]
        number_of = self.numbers(list(chain.from_iterable(tokens)))
        at = places(sizes)
        ids = np.zeros(len(number_of) + (len(sizes) + 1) * ROOM, np.int64)
        ids[at] = number_of
        em = self.own[number_of]
        for j, k in enumerate(NEAR):
            em += self.near[ids[at + k], j]
        em += self.model.weights[pair_numbers(self.word[ids[at - 2]], self.word[ids[at - 1]])]
        of_file = np.array([self.model.weights[document_numbers(t)].sum(axis=0) for t in texts], np.float32)
        return em + np.repeat(of_file, sizes, axis=0)

    def decode(self, em: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that may be other than O, and their tags on the best path (ties: the lower tag)."""
        m = self.model
        ends = np.cumsum(lengths)
        last, begin = np.zeros(len(em), bool), np.zeros(len(em), bool)
        last[ends - 1] = begin[ends - np.array(lengths)] = True
        lead = em[:, 0] - np.maximum(em[:, 1], em[:, 2])
        turn = np.append(em[1:, 2] - em[1:, 1], 0.0)
        turn[last] = -np.inf
        sure = (lead > m.gap_next + 1e-3) & (lead > m.gap_inside + turn + 1e-3)
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return open_, open_
        head = np.ones(len(open_), bool)
        head[1:] = (open_[1:] != open_[:-1] + 1) | begin[open_[1:]]
        tail = np.append(head[1:], True)
        part = em[open_].astype(np.float64)
        # what stands before and after a run: nothing, or a token that is O
        opens = open_[head]
        part[head] += np.where(begin[opens][:, None], m.first, m.trans[0])
        closes = open_[tail]
        part[tail] += np.where(last[closes][:, None], 0.0, m.trans[:, 0])
        starts = np.flatnonzero(head)
        return open_, crf.viterbi(part, m.trans, np.zeros(3), np.diff(np.append(starts, len(open_))))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Spans of each text as (start, kind, end, where the secret begins), sorted; added ones overlap no base span."""
        out = [base_spans(t) for t in texts]
        tokens = [TOKEN.findall(t) for t in texts]
        held = [i for i, s in enumerate(tokens) if s]
        if not held:
            return out
        lengths = [len(tokens[i]) for i in held]
        at, tag = self.decode(self.emissions([texts[i] for i in held], [tokens[i] for i in held]), lengths)
        start = np.cumsum([0, *lengths])
        spans, now, found = {}, None, []
        for k, y in zip(at[tag > 0].tolist(), tag[tag > 0].tolist()):
            doc = int(np.searchsorted(start, k, side="right")) - 1
            if doc not in spans:
                spans = {doc: [m.span() for m in TOKEN.finditer(texts[held[doc]])]}
            a, b = spans[doc][k - int(start[doc])]
            if y == 2 and now and now[3] == k - 1 and now[0] == held[doc]:
                now[2], now[3] = b, k
            else:
                found.append(now := [held[doc], a, b, k])
        for i, a, b, _ in found:
            while b > a + 1 and texts[i][b - 1] in ".,-":
                b -= 1
            if not any(s[0] < b and a < s[2] for s in out[i]):
                out[i].append((a, 3, b, a))
        return [sorted(x) for x in out]


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def _blocks(texts: list, size: int = CHARS_AT_ONCE) -> Iterator[list]:
    block, n = [], 0
    for text in texts:
        block.append(text or "")
        n += len(block[-1])
        if n >= size:
            yield block
            block, n = [], 0
    if block:
        yield block


FOUND = pa.struct([(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")] + [(n, pa.string()) for n in ("base_sha256", "spans")])


def find_secrets(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end``, in code points) of every row.

    A null text is empty and has no span; repeated rows give repeated rows; other columns are not read. Spans that the
    field adds never overlap a base span, and lose marks at their end.
    """
    shared = Shared(docs.sparkSession, model)

    def run(own, texts):
        rows = []
        for block in _blocks(texts.to_pylist()):
            for spans in own.scan(block):
                base = [s for s in spans if s[1] < 3]
                n = [sum(s[1] == k for s in base) for k in range(3)]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
        return structs(FOUND, rows)

    scan = text_udf("secrets", shared.id, lambda: Scanner(shared.value), run, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    found = fresh(docs, "found")
    return docs.select(F.col("doc_id").cast("long"), scan("text").alias(found)).select("doc_id", f"{found}.*")


def redact(docs: DataFrame, model: Model, *, mark: str = "[SECRET]") -> DataFrame:
    """docs with mark in place of each secret of text (of an assignment: of its value); other columns, null texts
    and the order of columns stay, and rows that repeat are masked alike."""
    shared = Shared(docs.sparkSession, model)

    def run(own, texts):
        out = []
        own_texts = texts.to_pylist()
        for text, spans in zip(own_texts, (s for block in _blocks(own_texts) for s in own.scan(block))):
            if spans:
                parts, end = [], 0
                for a, b in sorted((s[3], s[2]) for s in spans):
                    if a >= end:
                        parts += [text[end:a], mark]
                    end = max(end, b)
                text = "".join([*parts, text[end:]])
            out.append(text)
        return pa.array(out, pa.string())

    clean = text_udf("secrets", shared.id, lambda: Scanner(shared.value), run, "string")
    return docs.select(*[clean("text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op10_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, fit(docs))
