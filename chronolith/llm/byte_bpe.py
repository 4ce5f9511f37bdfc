"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank file.

Every byte is mapped to a visible character, so every token is a piece; its score is its negative rank, and a
sentencepiece BPE model merges the adjacent pair of the highest score first, leftmost on ties, which is the
rule of byte-level BPE. Normalisation is the identity. A text is cut by the pattern, each pre-token is encoded
by itself, and decoding maps the pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, table, tool

#: Entries of the cache of pre-tokens in a worker; it is emptied when full.
CACHE = 200_000
#: Pre-tokens of more characters are not cached.
CACHED_CHARS = 64


def byte_chars() -> list[str]:
    """A character for each byte: itself if visible and not a space, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a line ``base64 rank`` for each token."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One protobuf field: an int as varint, a float as fixed32, else length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """The sentencepiece model, and the rank of each of its piece ids (-1: unknown, which no byte maps to)."""
    chars = byte_chars()
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks the bytes {missing[:8]}")
    pieces = [_field(1, "⁇ unknown") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(chars[b] for b in token)) + _field(2, -float(rank)) + _field(3, 1) for token, rank in ordered]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1) + _field(45, "⁇ unknown")
    normalizer = _field(1, "identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    model = b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)
    return model, [-1, *(rank for _, rank in ordered)]


class Codec:
    """encode() and decode() of whole texts."""

    def __init__(self, data: bytes, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(data)
        model, self.rank_of = serialise(self.ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chars = byte_chars()
        self.to_chars = {b: c for b, c in enumerate(self.chars)}
        self.byte_of = {c: b for b, c in enumerate(self.chars)}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.piece_bytes: dict[int, bytes] = {}

    def _pretoken(self, text: str) -> bytes:
        data = text.encode()
        if (rank := self.ranks.get(data)) is not None:  # a pre-token that is a token is never cut
            ids = (rank,)
        else:
            ids = [self.rank_of[i] for i in self.model.encode(data.decode("latin-1").translate(self.to_chars))]
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as native unsigned 32-bit integers."""
        cache, out = self.cache, []
        for token in self.split(text):
            ids = cache.get(token)
            if ids is None:
                ids = self._pretoken(token)
                if len(token) <= CACHED_CHARS:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[token] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids) -> bytes:
        """The bytes of ids, each through its piece and the inverse of the byte map."""
        known, out = self.piece_bytes, []
        if not known:
            for piece, rank in enumerate(self.rank_of):
                if rank >= 0:
                    known[rank] = bytes(map(self.byte_of.__getitem__, self.model.id_to_piece(piece)))
        out = map(known.__getitem__, ids)
        return b"".join(out)


def codec(data: bytes, pattern: str) -> Codec:
    """A Codec, kept while the worker has no other tool."""
    return tool("codec", (hashlib.sha256(data).digest(), pattern), lambda: Codec(data, pattern))


def rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, data: bytes, pattern: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, if with_ids), ids_sha256, decoded_sha256.

    data is the content of a rank file (about 1 MB, sent to the executors once). A null text is empty and has no
    token; repeated rows give repeated rows; other columns are not read. A text is one value in memory and is
    encoded whole, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(data)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        own = codec(shared.value, pattern)
        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            for text in batch.column("text"):
                raw = own.encode(text.as_py() or "")
                ids = array("I", raw)
                if sys.byteorder == "big":
                    ids.byteswap()
                    raw = ids.tobytes()
                    ids.byteswap()
                row = len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()
                out.append((*row, raw) if with_ids else row)
            kinds = [pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers as P

    data = rank_file(P.path("byte_bpe_multi_50k.tiktoken"))
    return encode_texts(table(spark, sf_dir, "documents"), data, P.PATTERN, with_ids=False)
