"""Operator 6: language-model scoring by the likelihood of a subword lattice.

Tokens are the words `[^\\x20\\x09-\\x0D]+` of the text after A-Z are lower-cased, and one end for each text.  The model
gives a word the probability of all its segmentations: every path through the lattice of pieces of an existing
vocabulary (bytes stand for what it lacks), and the path that is the word itself as the corpus has it.  A forward
recursion in log space sums the paths:

    P(word) = (c + V * L(word)) / (N + V),   L(word) = sum over segmentations of the product of q(piece)

with c the word's count, N the number of tokens and V that of distinct tokens in the training texts.  q starts from the
vocabulary's scores (a piece's rank by score, as 1 / (rank + 3)) and takes in how often the pieces are expected in the
distinct training words under it, by ROUNDS forward-backward passes over them.  Words don't share segmentations across spaces, so the text's
log10 probability is the sum over its tokens.

Counts go by ranges of word fingerprints: blocks of documents send their distinct words with counts, each range adds
them up, scores each of its words once, and sends count and probability back to the blocks that asked.  What a task holds
is the words of a block or of a range.  To the driver come N, V and the expected counts of the vocabulary's pieces.

The base score is sum(log10((c + 1) / (N + 1 * (V + 1)))).  Null and empty texts have the end alone; without training
texts all counts are 0 (and the base is log10(1 / 1) = 0 a token); rows that repeat an id are scored each, as are rows
without one, which are never held out; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, own_id, pack_blocks, packed, packed_sorted, parts_of, passes, released, spans, stored, sums, unpack, unpacked, unpacked_sorted, word_hashes, words_of

#: Passes that fit the pieces' probabilities.
ROUNDS = 2
#: What the vocabulary's scores weigh against the expected counts, in pieces.
PRIOR = 1000.0
#: The end of a text among the words' fingerprints.
END = np.uint64(1)
#: Words of more bytes are scored and learned from one at a time.
WIDE = 48


@lru_cache(2)
def vocabulary(path: str) -> tuple[dict[bytes, int], np.ndarray]:
    """Pieces (a leading space marks a word's beginning) and the prior weight of each; ids 0..255 are the single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            piece = sp.id_to_piece(i).replace("▁", " ").encode()
            low = bytes(LOWER[np.frombuffer(piece, np.uint8)])
            if low == piece and b" " not in piece[1:] and len(piece) > 1:
                found.append((-sp.get_score(i), piece))
    out = {bytes([b]): b for b in range(256)}
    for _, piece in sorted(found):
        out.setdefault(piece, len(out))
    rank = np.arange(len(out), dtype=np.float64)
    weight = 1 / (np.maximum(rank - 256, 0) + 3)
    weight[:256] = weight[256:].sum() / 256 / 50 if len(out) > 256 else 1.0
    return out, weight / weight.sum()


class Lattice:
    """Log probabilities of words under piece probabilities."""

    def __init__(self, pieces: dict[bytes, int], q: np.ndarray):
        self.pieces, self.logq = pieces, np.log(q)
        names = list(pieces)
        self.reach = max(map(len, names))
        buf = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum([len(n) for n in names])
        h = spans(sums(buf), ends - [len(n) for n in names], ends)
        order = np.argsort(h)
        self.h, self.id = h[order], order
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.h >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids by fingerprint, -1 for none."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.bits[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.h, h[maybe]), len(self.h) - 1)
        ok = self.h[at] == h[maybe]
        out[maybe[ok]] = self.id[at[ok]]
        return out

    def _arcs(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Per position from the word's beginning (a space stands before it): for each length the piece ids, -1 for none."""
        n = ends - starts
        text = np.full((len(n), int(n.max()) + 1), 0x20, np.uint8)
        for t in range(int(n.max())):
            ok = n > t
            text[ok, t + 1] = buf[starts[ok] + t]
        width = text.shape[1]
        prefix = sums(text.ravel())
        row = np.arange(len(n)) * width
        for t in range(1, width + 1):
            live = np.flatnonzero(n + 1 >= t)
            yield t, live, [(k, self.find(spans(prefix, row[live] + t - k, row[live] + t)) if k > 1 else text[live, t - 1].astype(np.int64)) for k in range(1, min(t, self.reach) + 1)]

    def forward(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log of the marginal probability of each word."""
        out = np.zeros(len(starts))
        n = ends - starts
        for i in np.flatnonzero(n > WIDE):
            out[i] = self.one(buf[starts[i] : ends[i]].tobytes())
        some = np.flatnonzero(n <= WIDE)
        some = some[np.argsort(n[some], kind="stable")]
        for z in range(0, len(some), 20_000):
            own = some[z : z + 20_000]
            alpha = np.full((len(own), int(n[own].max()) + 2), -np.inf)
            alpha[:, 0] = 0
            for t, live, arcs in self._arcs(buf, starts[own], ends[own]):
                best = np.full(len(live), -np.inf)
                for k, ids in arcs:
                    ok = ids >= 0
                    best[ok] = np.logaddexp(best[ok], alpha[live[ok], t - k] + self.logq[ids[ok]])
                alpha[live, t] = best
            out[own] = alpha[np.arange(len(own)), n[own] + 1]
        return out

    def expected(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece in the words, each `counts` times."""
        total = np.zeros(len(self.logq))
        n = ends - starts
        for i in np.flatnonzero((n > WIDE) & (counts > 0)):
            ids, share = self.one_expected(buf[starts[i] : ends[i]])
            np.add.at(total, ids, counts[i] * share)
        some = np.flatnonzero((n <= WIDE) & (counts > 0))
        some = some[np.argsort(n[some], kind="stable")]
        for z in range(0, len(some), 20_000):
            own = some[z : z + 20_000]
            size = n[own] + 1
            width = int(size.max()) + 1
            alpha = np.full((len(own), width), -np.inf)
            alpha[:, 0] = 0
            kept = []
            for t, live, arcs in self._arcs(buf, starts[own], ends[own]):
                best = np.full(len(live), -np.inf)
                for k, ids in arcs:
                    at = np.flatnonzero(ids >= 0)
                    best[at] = np.logaddexp(best[at], alpha[live[at], t - k] + self.logq[ids[at]])
                    kept.append((t, k, live[at], ids[at]))
                alpha[live, t] = best
            whole = alpha[np.arange(len(own)), size]
            beta = np.full((len(own), width), -np.inf)
            beta[np.arange(len(own)), size] = 0
            for t, k, rows, ids in reversed(kept):
                arc = self.logq[ids] + beta[rows, t]
                np.add.at(total, ids, counts[own[rows]] * np.exp(alpha[rows, t - k] + arc - whole[rows]))
                beta[rows, t - k] = np.logaddexp(beta[rows, t - k], arc)
        return total

    def one_expected(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs of a single word of any length: their pieces and how often each is expected."""
        text = np.concatenate([np.array([0x20], np.uint8), word])
        n, prefix, at = len(text), sums(text), np.arange(len(text))
        begins, ends, pieces = [at], [at + 1], [text.astype(np.int64)]
        for k in range(2, min(n, self.reach) + 1):
            ids = self.find(spans(prefix, at[: n - k + 1], at[: n - k + 1] + k))
            ok = np.flatnonzero(ids >= 0)
            begins.append(ok)
            ends.append(ok + k)
            pieces.append(ids[ok])
        a, z, ids = np.concatenate(begins), np.concatenate(ends), np.concatenate(pieces)
        logq = self.logq[ids]

        def recursion(of: np.ndarray, other: np.ndarray) -> np.ndarray:
            """From 0 at position 0: the log sum at each position `of` over the arcs from `other`."""
            order = np.argsort(of, kind="stable")
            first = np.searchsorted(of[order], np.arange(n + 2)).tolist()
            start, log, out = other[order].tolist(), logq[order].tolist(), [0.0] * (n + 1)
            for t in range(1, n + 1):
                terms = [out[start[x]] + log[x] for x in range(first[t], first[t + 1])]
                top = max(terms)
                out[t] = top + math.log(sum(math.exp(x - top) for x in terms))
            return np.array(out)

        alpha = recursion(z, a)
        beta = recursion(n - a, n - z)[::-1]
        return ids, np.exp(alpha[a] + logq + beta[z] - alpha[n])

    def one(self, word: bytes) -> float:
        """The forward recursion for a single word of any length."""
        text = b" " + word
        alpha = [0.0]
        for t in range(1, len(text) + 1):
            terms = [alpha[t - k] + self.logq[i] for k in range(1, min(t, self.reach) + 1) if (i := self.pieces.get(text[t - k : t])) is not None]
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(x - top) for x in terms)))
        return alpha[-1]


def _words(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pass by pass of a block: ids, lower-cased bytes, starts, ends, first word of each row, fingerprints."""
    ids, buf, off = unpack(row["ids"], row["lens"], row["payload"])
    for i, j in passes(off):
        part, o = LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        starts, ends, first = words_of(part, o, NOT_SPACE)
        h = word_hashes(part, starts, ends)
        h[h == END] = np.uint64(2)
        yield ids[i:j], part, starts, ends, first, h


def _held(ids: np.ndarray, mod: int, rest: int, none: int | None) -> np.ndarray:
    return np.array([(none is None or i < none) and zlib.crc32(str(i).encode()) % mod == rest for i in ids.tolist()], bool)


def _collect(row: dict, mod: int, rest: int, none: int | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The block's distinct words: fingerprints, counts in training texts, bytes."""
    hs, cs, ws = [], [], []
    for ids, part, starts, ends, first, h in _words(row):
        train = np.repeat(~_held(ids, mod, rest, none), np.diff(first))
        u, at, inv = np.unique(h, return_index=True, return_inverse=True)
        hs.append(u)
        cs.append(np.bincount(inv, train, len(u)).astype(np.int64))
        raw = part.tobytes()
        ws += [raw[starts[k] : ends[k]] for k in at]
        ends_here = int((~_held(ids, mod, rest, none)).sum())
        hs.append(np.array([END]))
        cs.append(np.array([ends_here]))
        ws.append(b"")
    h, c = np.concatenate(hs), np.concatenate(cs)
    u, at, inv = np.unique(h, return_index=True, return_inverse=True)
    return u, np.bincount(inv, c, len(u)).astype(np.int64), [ws[k] for k in at]


def _joined(words: list[bytes]) -> tuple[bytes, bytes]:
    return zstandard.ZstdCompressor(1).compress(b"".join(words)), packed(np.array([len(w) for w in words], np.int64))


def _split(blob: bytes, lens: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = unpacked(lens, np.int64)
    ends = np.cumsum(n)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), ends - n, ends


def score(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, rest: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text; texts with crc32(id) % mod = rest are not learned from."""
    spark = docs.sparkSession
    blocks, size = pack_blocks(docs, id_col, text_col, "lattice-blocks")
    none = size["none"]
    parts = parts_of(spark, size["bytes"] / 24, 400_000)
    cuts = np.array([(1 << 64) * i // parts for i in range(1, parts)], np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                h, c, words = _collect(r, mod, rest, none)
                at = [0, *np.searchsorted(h, cuts).tolist(), len(h)]
                own = [p for p in range(parts) if at[p + 1] > at[p]]
                text = [_joined(words[at[p] : at[p + 1]]) for p in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), pa.array([r["block"]] * len(own), pa.int64()), *(pa.array(x, pa.binary()) for x in ([packed_sorted(h[at[p] : at[p + 1]]) for p in own], [packed(c[at[p] : at[p + 1]].astype(np.uint32)) for p in own], [t[0] for t in text], [t[1] for t in text]))],
                    ["part", "block", "names", "counts", "words", "lens"],
                )

    def add(t: pa.Table) -> pa.Table:
        """A range's words with their counts, and for each block the places of its words among them."""
        names = [unpacked_sorted(x) for x in t.column("names").to_pylist()]
        flat = np.concatenate(names)
        u, first, inv = np.unique(flat, return_index=True, return_inverse=True)
        c = np.bincount(inv, np.concatenate([unpacked(x, np.uint32) for x in t.column("counts").to_pylist()]), len(u)).astype(np.int64)
        at = np.cumsum([0, *map(len, names)])
        words: list[bytes] = [b""] * len(u)
        which = np.searchsorted(at, first, "right") - 1
        for k in np.unique(which):
            buf, s, e = _split(t.column("words")[k].as_py(), t.column("lens")[k].as_py())
            raw = buf.tobytes()
            for g in np.flatnonzero(which == k):
                i = first[g] - at[k]
                words[g] = raw[s[i] : e[i]]
        blob, lens = _joined(words)
        rows = t.num_rows
        empty = [b""] * rows
        return pa.table({"part": pa.array([t.column("part")[0].as_py()] * (rows + 1), pa.int32()), "block": pa.concat_arrays([pa.array([-1], pa.int64()), t.column("block").combine_chunks()]), "data": pa.array([packed(c), *(packed(inv[at[k] : at[k + 1]].astype(np.uint32)) for k in range(rows))], pa.binary()), "words": pa.array([blob, *empty], pa.binary()), "lens": pa.array([lens, *empty], pa.binary()), "n": pa.array([int(c.sum()), *[0] * rows], pa.int64()), "v": pa.array([int((c > 0).sum()), *[0] * rows], pa.int64())})

    table = stored(blocks.mapInArrow(send, "part int, block long, names binary, counts binary, words binary, lens binary").groupBy("part").applyInArrow(add, "part int, block long, data binary, words binary, lens binary, n long, v long"), "lattice-words")
    released(spark)
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n, v = int(total["n"]), int(total["v"])

    pieces, prior = vocabulary(vocabulary_path)
    own = table.where("block = -1 and v > 0").select("words", "lens", "data")
    q = prior
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(q)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            lattice, got = Lattice(vocabulary(vocabulary_path)[0], now.value), np.zeros(len(now.value))
            for b in batches:
                for r in b.to_pylist():
                    buf, s, e = _split(r["words"], r["lens"])
                    c = unpacked(r["data"], np.int64)
                    ok = (e > s) & (c > 0)
                    got += lattice.expected(buf, s[ok], e[ok], np.ones(int(ok.sum())))
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(got[at])], ["piece", "n"])

        q = prior * PRIOR
        for r in own.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
            q[r["piece"]] += round(r["n"], 3)
        q /= q.sum()
    shared = spark.sparkContext.broadcast(q)

    def answer(t: pa.Table) -> pa.Table:
        """Each of the range's words scored once; count and log10 probability to every block that has it."""
        p, _ = vocabulary(vocabulary_path)
        rows = t.to_pylist()
        head = next(r for r in rows if r["block"] < 0)
        c = unpacked(head["data"], np.int64)
        buf, s, e = _split(head["words"], head["lens"])
        log = np.zeros(len(c))
        ok = e > s
        log[ok] = Lattice(p, shared.value).forward(buf, s[ok], e[ok])
        # log10((c + V * exp(log)) / (N + V)), in log space; an unseen corpus leaves the lattice alone
        with np.errstate(divide="ignore"):
            weight = max(v, 1)
            ten = np.where(ok, np.logaddexp(np.log(c), math.log(weight) + log) - math.log(n + weight), np.log((c + 1) / (n + 1 * (v + 1)))) / math.log(10)
        others = [r for r in rows if r["block"] >= 0]
        place = [unpacked(r["data"], np.uint32) for r in others]
        return pa.table({"block": pa.array([r["block"] for r in others], pa.int64()), "part": pa.array([r["part"] for r in others], pa.int32()), "counts": pa.array([packed(c[x]) for x in place], pa.binary()), "logs": pa.array([packed(ten[x]) for x in place], pa.binary())})

    told = stored(table.groupBy("part").applyInArrow(answer, "block long, part int, counts binary, logs binary"), "lattice-answers")
    released(spark)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        back = sorted(right.to_pylist(), key=lambda r: r["part"])
        c = np.concatenate([np.zeros(0, np.int64), *(unpacked(r["counts"], np.int64) for r in back)])
        log = np.concatenate([np.zeros(0), *(unpacked(r["logs"], np.float64) for r in back)])
        out = []
        for r in left.to_pylist():
            names = np.unique(np.concatenate([[END], *(np.unique(x[5]) for x in _words(r))]))
            base = np.log10((c + 1) / (n + 1 * (v + 1)))
            end = int(np.searchsorted(names, END))
            for ids, _, _, _, first, h in _words(r):
                at = np.searchsorted(names, h)
                add_up = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])  # noqa: B023, E731
                out.append(pa.table({"id": ids, "held_out": _held(ids, mod, rest, none), "n_tokens": np.diff(first) + 1, "n_known": add_up(c[at] > 0).astype(np.int64) + int(c[end] > 0), "train_tokens": np.full(len(ids), n, np.int64), "base_score": add_up(base[at]) + base[end], "score": add_up(log[at]) + log[end]}))
        return pa.concat_tables(out)

    out = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("id", own_id(F.col("id"), none)).withColumnRenamed("id", id_col)
