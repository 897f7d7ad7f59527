"""Operator 4: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The tokenizer is built from a rank file: the vocabulary is the ranks, the merges follow from them, pieces are the
matches of the given pattern, and each byte stands as one character of the usual byte-to-character table.  The library
encodes each distinct piece of a batch once.

Null texts are empty and make no ids.  Very long texts are encoded whole.  Repeated rows give repeated results, an empty
table an empty result; other columns are neither read nor returned, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of

#: Text bytes given to the library at once.
ENCODE_BYTES = 1 << 19
#: The public pattern that LATIN equals on texts without BEYOND_LATIN characters.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
LATIN = re.compile(rf" ?[{_L}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
BEYOND_LATIN = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]").search


@lru_cache(1)
def byte_chars() -> list[str]:
    """The character that stands for each byte: printable Latin-1 characters for themselves, the others from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """The merge that makes each token, in the order of rank: the pair left when only lower ranks have been merged."""
    chars = byte_chars()
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)), default=(rank, 0))
            if best[0] >= rank:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append(tuple("".join(chars[b] for b in p) for p in parts))
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes pieces (matches of the pattern) with the library and keeps the results of frequent ones."""

    #: Kept pieces; when there are more, all are let go and gathered anew.
    KEPT = 300_000

    def __init__(self, path: str, pattern: str):
        from tokenizers import models

        ranks = read_ranks(path)
        chars = byte_chars()
        vocab = {"".join(chars[b] for b in t): r for t, r in ranks.items()}
        self.library = models.BPE(vocab=vocab, merges=merges_of(ranks), ignore_merges=True, cache_capacity=0)
        self.table = dict(enumerate(chars))
        back = {c: b for b, c in enumerate(chars)}
        self.raw: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for s, r in vocab.items():
            self.raw[r] = bytes(back[c] for c in s)
        self.general = regex.compile(pattern).findall
        self.latin = LATIN.findall if pattern == KNOWN_PATTERN else None
        self.names = [str(i) for i in range(len(self.raw))]
        self.kept = _Kept(self.one)

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches; texts of ASCII and Latin letters alone go by an equal, faster expression."""
        return self.latin(text) if self.latin and not BEYOND_LATIN(text) else self.general(text)

    def encode(self, text: str) -> list[tuple[int, str, bytes, tuple[int, ...]]]:
        """The text's pieces as (number of ids, ids in decimal, decoded bytes, ids)."""
        if len(self.kept) > self.KEPT:
            self.kept.clear()
        return list(map(self.kept.__getitem__, self.pieces(text)))

    def one(self, piece: str) -> tuple[int, str, bytes, tuple[int, ...]]:
        ids = tuple([t.id for t in self.library.tokenize(piece.encode().decode("latin-1").translate(self.table))])
        return len(ids), " ".join([self.names[i] for i in ids]), decode(ids, self.raw), ids


class _Kept(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str):
        self[piece] = out = self.make(piece)
        return out


def uncollected(rows: Iterator) -> Iterator:
    """The rows, without the garbage collector while they are worked on: pieces hold no cycles, and to walk over all kept
    ones costs more than the encoding.  Its state is as before afterwards."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield from rows
    finally:
        if on:
            gc.enable()


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def decode(ids, raw: list[bytes]) -> bytes:
    """The bytes of the ids; a character split over several ids is whole again once they are joined."""
    return b"".join([raw[i] for i in ids])


def offsets_of(ids, raw: list[bytes]) -> list[tuple[int, int]]:
    """The byte span of each id in the text."""
    out, at = [], 0
    for i in ids:
        out.append((at, at := at + len(raw[i])))
    return out


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(id_col long, ids array<int>, decoded binary[, starts array<int>, ends array<int>]): the ids of every whole text and the bytes they decode to."""
    schema = "id long, ids array<int>, decoded binary" + ", starts array<int>, ends array<int>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b, _, _ in uncollected(batches_of(batches, "text", ENCODE_BYTES)):
            ids = [[i for p in c.encode(t) for i in p[3]] for t in b.column(1).fill_null("").to_pylist()]
            cols = [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([decode(x, c.raw) for x in ids], pa.binary())]
            if offsets:
                both = [offsets_of(x, c.raw) for x in ids]
                cols += [pa.array([[y[k] for y in x] for x in both], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "decoded", "starts", "ends"][: len(cols)])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (id_col, n_tokens, ids_sha256, decoded_sha256), hashed where the ids are made so that they are not sent back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b, _, _ in uncollected(batches_of(batches, "text", ENCODE_BYTES)):
            n, a, d = [], [], []
            for t in b.column(1).fill_null("").to_pylist():
                counts, ids, decoded, _ = zip(*c.encode(t), strict=True) if t else ((), (), (), ())
                n.append(sum(counts))
                a.append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                d.append(hashlib.sha256(b"".join(decoded)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
