"""Operator 1: suffix-array dedup of repeated strings by a distributed difference cover, to the depth that matters.

A byte goes if a LENGTH-byte string over it also starts in a document with a smaller id.  Only the first LENGTH bytes of
suffixes count, so the suffix array is needed to that depth alone:

1. Positions whose residue modulo V lies in a difference cover D are sampled.  For any two positions i and j there is a
   shift below V that takes both into the sample, so two equal LENGTH-byte strings hold an equal tuple of
   LENGTH - V + 1 bytes at samples of one alignment.  The tuples are named and sorted; adjacent equal names of
   different documents mark a sample as shared.
2. Recursion on names: shared samples V apart are joined to names of LENGTH + V bytes, sorted again, and compared with
   their neighbours.  A name with an equal one in a smaller document removes its bytes: between two samples of one
   residue, no suffix need be looked at.  The tuple of each shared sample is also drawn out to both sides, by the bytes
   that every string on that side of it must hold; a drawn-out name is wanted, if it stands in a smaller document and
   strings around it are still undecided.
3. Merge of the remaining suffixes: positions around wanted names whose string lies in no removed name - the borders of
   repeats, repeats shorter than LENGTH + V, and what they repeat - get names of their first LENGTH bytes, which are
   sorted and compared.

Documents stand in blocks of consecutive ids.  A name is a 64-bit fingerprint of its bytes (where a false share costs
work and no byte, cut to as many bits as the corpus needs).  A block sends its sorted distinct names by ranges; each range
merges those of all blocks, compares neighbours, and sends back one bit a name, in order.  So what is shuffled follows
the names, and a string that stands in every document is one name of each block.  Ranges hold NAMES names and more where
there are few: a block has no message for a range without names of its own, so messages never outnumber names.

Null and empty texts have no bytes; a document never loses bytes to itself or to a row of the same id; of equal texts
the one with the smallest id stays; rows without an id are documents of their own after all others; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh, own_id, packed, packed_sorted, parts_of, range_blocks, released, row_keys, spans, stored, sums, trimmed, unpack, unpacked, unpacked_sorted

LENGTH = 50
#: Perfect difference covers (fixed values): every residue modulo V is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}
#: Names of the first level in one range.
NAMES = 2 << 20
#: Bytes whose fingerprints are computed at once: what a step holds stays in a core's cache.
STEP = 1 << 17


def cover_for(length: int) -> int:
    """The largest modulus that leaves tuples of at least two fifths of the length."""
    return max([v for v in COVERS if length - v + 1 >= 0.4 * length], default=3)


def fingerprints(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of the `length` bytes at each of the sorted positions."""
    out = np.empty(len(at), np.uint64)
    for lo in range(0, len(buf), STEP):
        a, z = np.searchsorted(at, [lo, lo + STEP])
        if a < z:
            p = at[a:z] - lo
            out[a:z] = spans(sums(buf[lo : lo + STEP + length]), p, p + length)
    return out


def ordered(x: np.ndarray) -> np.ndarray:
    """The stable order of unsigned 64-bit numbers.

    Each is sorted with its place in the low bits, which is far quicker than a sort of places; where 64 bits don't hold
    both, the lowest bits of the numbers are left out, and the runs that this leaves in disorder are sorted again.
    """
    n = len(x)
    if n < 2:
        return np.arange(n)
    k, low = (n - 1).bit_length(), x.min()
    cut = max(0, int(x.max() - low).bit_length() + k - 64)
    key = x - low
    key >>= np.uint64(cut)
    key <<= np.uint64(k)
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << k) - 1)).view(np.int64)
    if cut:
        s = x[order]
        key >>= np.uint64(k)
        open_runs = np.unique(key[:-1][s[1:] < s[:-1]])
        if len(open_runs) > n // 1000 + 100:
            return np.argsort(x, kind="stable")
        for a, z in zip(np.searchsorted(key, open_runs), np.searchsorted(key, open_runs, "right"), strict=True):
            order[a:z] = order[a:z][np.argsort(s[a:z], kind="stable")]
    return order


#: Every table between the steps: what a block knows of itself (part -1), sends to a part, or is told by it.
RECORD = "block long, kind int, part int, data binary"
_RECORD = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
#: Kinds of names: sampled tuples, joined tuples, drawn-out tuples, whole strings; bits that say which drawn-out ones are wanted.
SAMPLE, JOINED, DRAWN, WHOLE, WANTED = range(5)
#: Kinds of what a block keeps: positions of shared samples, of removed joined names, of remaining strings.
SHARED, REMOVED, REST = range(10, 13)


class Names:
    """Names at positions: their sorted distinct values, each position's place among them, and the documents that hold them."""

    def __init__(self, at: np.ndarray, own: np.ndarray, names: np.ndarray):
        order = ordered(names)
        s = names[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        head = np.flatnonzero(new)
        self.at, self.own, self.values = at, own, s[new]
        self.place = np.empty(len(s), np.int32)
        self.place[order] = np.cumsum(new, dtype=np.int32) - 1
        # positions come document by document, so the sort leaves the smallest one first
        self.first = own[order[head]]
        self.last = own[order[np.append(head[1:], len(s)) - 1]] if len(s) else self.first

    def smaller(self, told: np.ndarray) -> np.ndarray:
        """The positions whose name also stands in a smaller document; told: the names that stand in an earlier block."""
        return told[self.place] | (self.own > self.first[self.place])


class Block:
    """The texts of a block."""

    def __init__(self, row: dict, length: int, v: int, bits: int):
        self.ids, self.buf, self.off = unpack(row["ids"], row["lens"], row["payload"])
        self.length, self.v, self.bits, self.tuple, self.half = length, v, bits, length - v + 1, (v - 1) // 2
        # rows of one id count as one document
        self.doc = np.cumsum(np.diff(self.ids, prepend=self.ids[:1]) != 0) if len(self.ids) else np.zeros(0, np.int64)

    def fits(self, at: np.ndarray, size: int) -> np.ndarray:
        """Of sorted positions those with `size` bytes before the end of their row."""
        return at[at + size <= self.per_row(self.off[1:], at)]

    def per_row(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each row's value of x for the sorted positions in that row."""
        return np.repeat(x, np.diff(np.searchsorted(at, self.off)))

    def names(self, at: np.ndarray, size: int, bits: int = 64) -> Names:
        return Names(at, self.per_row(self.doc, at), self.values(at, size, bits))

    def values(self, at: np.ndarray, size: int, bits: int) -> np.ndarray:
        out = fingerprints(self.buf, at, size)
        out >>= np.uint64(64 - bits)
        return out

    def sampled(self) -> np.ndarray:
        at = (np.arange(len(self.buf) // self.v + 1)[:, None] * self.v + np.array(COVERS[self.v])).ravel()
        return self.fits(at[: np.searchsorted(at, len(self.buf))], self.tuple)

    def samples(self) -> Names:
        return self.names(self.sampled(), self.tuple, self.bits)

    def sample_values(self) -> np.ndarray:
        """The sorted distinct names of samples."""
        out = self.values(self.sampled(), self.tuple, self.bits)
        out.sort()
        return out[np.diff(out, prepend=~out[:1]) != 0]

    def joined(self, shared: np.ndarray) -> Names:
        """Shared samples whose next one of the residue is shared too, by length + v bytes."""
        mark = np.zeros(len(self.buf) + self.v + 1, bool)
        mark[shared] = True
        return self.names(self.fits(shared[mark[shared + self.v]], self.length + self.v), self.length + self.v)

    def drawn(self, shared: np.ndarray) -> tuple[Names, np.ndarray]:
        """Shared samples with the bytes that strings around them hold: for strings that begin at most `half` bytes before
        a sample those to its right, for others those to its left.  Strings around a name begin from `lo`, given too, up to it."""
        right = self.fits(shared, self.length - self.half)
        left = shared - self.half - 1
        left = left[left >= self.per_row(self.off[:-1], shared)]
        size = self.half + 1 + self.tuple
        at = np.concatenate([right, left])
        value = np.concatenate([self.values(right, self.length - self.half, self.bits), self.values(left, size, self.bits)])
        lo = np.concatenate([right - self.half, left + self.half + 2 - self.v])
        order = np.argsort(at, kind="stable")
        at = at[order]
        return Names(at, self.per_row(self.doc, at), value[order]), np.maximum(lo, 0)[order]

    def covered(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The mask of what the ranges lo..hi (hi not included) cover; one byte a byte of text, as ranges that touch are one."""
        edge = np.zeros(len(self.buf) + 1, np.int8)
        if len(lo):
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(np.minimum(hi, len(self.buf))[order])
            new = np.flatnonzero(lo[1:] > hi[:-1]) + 1
            edge[lo[np.append(0, new)]] = 1
            edge[hi[np.append(new, len(lo)) - 1]] = -1
        return np.cumsum(edge[:-1], dtype=np.int8).view(bool)

    def decided(self, removed: np.ndarray) -> np.ndarray:
        """Beginnings of strings that lie in one removed name: a smaller document has that whole."""
        return self.covered(removed, removed + self.v + 1)


def _record(block: int, rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([block] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary())))], schema=_RECORD)


def _bits(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + packed(np.packbits(x))


def _unbits(d: bytes) -> np.ndarray:
    return np.unpackbits(unpacked(d[8:], np.uint8), count=int.from_bytes(d[:8], "little")).astype(bool)


def _by_part(values: np.ndarray, bits: int, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted names, for parts that have any."""
    cuts = np.array([(1 << bits) * i // parts for i in range(1, parts)], np.uint64)
    at = [0, *np.searchsorted(values, cuts).tolist(), len(values)]
    return [(p, at[p], at[p + 1]) for p in range(parts) if at[p + 1] > at[p]]


class Told:
    """What a block has kept and been told."""

    def __init__(self, t: pa.Table):
        self.rows = sorted(zip(t.column("kind").to_pylist(), t.column("part").to_pylist(), t.column("data").to_pylist(), strict=True), key=lambda r: r[:2])

    def bits(self, kind: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, bool), *(_unbits(d) for k, _, d in self.rows if k == kind)])

    def positions(self, kind: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(unpacked_sorted(d, np.uint32).astype(np.int64) for k, _, d in self.rows if k == kind)])


def _compare(t: pa.Table) -> pa.Table:
    """Merges the sorted names of a range and compares neighbours; bits go back to each block in its order: of samples
    whether another block has the name, of others whether an earlier one has."""
    out = []
    t = t.sort_by("block")
    for kind in sorted(set(t.column("kind").to_pylist())):
        own = t.filter(pc.equal(t.column("kind"), kind))
        names = [unpacked_sorted(x) for x in own.column("data").to_pylist()]
        at = np.cumsum([0, *map(len, names)])
        flat = np.concatenate(names)
        del names
        order = ordered(flat)
        s = flat[order]
        same = s[1:] == s[:-1]
        bit = np.zeros(len(s), bool)
        bit[1:] = same
        if kind == SAMPLE:
            bit[:-1] |= same
        back = np.empty(len(s), bool)
        back[order] = bit
        out.append(pa.table([own.column("block"), own.column("kind"), own.column("part"), pa.array([_bits(back[at[i] : at[i + 1]]) for i in range(len(at) - 1)], pa.binary())], schema=_RECORD))
    return pa.concat_tables(out)


def _any(left: pa.Table, right: pa.Table) -> pa.Table:
    """The drawn-out names of a range and which of them each block wants: tells all blocks that have a name whether any wants it."""
    names = dict(zip(left.column("block").to_pylist(), map(unpacked_sorted, left.column("data").to_pylist()), strict=True))
    wants = dict(zip(right.column("block").to_pylist(), map(_unbits, right.column("data").to_pylist()), strict=True))
    wanted = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[wants[b]] for b, x in names.items())]))
    # both are sorted: a search costs what the block asks, and not once more all that is wanted
    told = {b: _bits(np.searchsorted(wanted, x, "right") > np.searchsorted(wanted, x)) for b, x in names.items()}
    part = left.column("part")[0].as_py()
    return pa.table([pa.array(names, pa.int64()), pa.array([WANTED] * len(names), pa.int32()), pa.array([part] * len(names), pa.int32()), pa.array(told.values(), pa.binary())], schema=_RECORD)


def analysed(docs: DataFrame, finish: Callable[[Block, np.ndarray], pa.Table], schema: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """finish(block, mask of its removed bytes) for all blocks of documents, as a stored table."""
    spark = docs.sparkSession
    v = cover_for(length)
    blocks, size = range_blocks(docs, id_col, text_col, "suffix-blocks")
    bits = max(32, min(63, math.ceil(math.log2(size["bytes"] + 2)) + 4))
    parts = parts_of(spark, size["bytes"] * len(COVERS[v]) / v, NAMES)

    def sent(values: np.ndarray, kind: int, bits: int) -> list[tuple[int, int, bytes]]:
        return [(kind, p, packed_sorted(values[a:z])) for p, a, z in _by_part(values, bits, parts)]

    def kept(kind: int, at: np.ndarray) -> tuple[int, int, bytes]:
        return kind, -1, packed_sorted(at.astype(np.uint32))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                (r,) = batch.slice(i, 1).to_pylist()
                yield from _record(r["block"], sent(Block(r, length, v, bits).sample_values(), SAMPLE, bits)).to_batches()
                trimmed()

    def stage(known: DataFrame, step: Callable[[Block, Told], pa.Table | list], out: str = RECORD) -> DataFrame:
        """A step of every block with what it knows."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                raise ValueError("no block of this name")
            (r,) = left.to_pylist()
            got = step(Block(r, length, v, bits), Told(right))
            trimmed()
            return got if isinstance(got, pa.Table) else _record(r["block"], got)

        return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, out)

    def join(b: Block, told: Told) -> list:
        n = b.samples()
        shared = n.at[(told.bits(SAMPLE) | (n.first != n.last))[n.place]]
        del n
        return [kept(SHARED, shared), *sent(b.joined(shared).values, JOINED, 64), *sent(b.drawn(shared)[0].values, DRAWN, bits)]

    def ask(b: Block, told: Told) -> list:
        shared = told.positions(SHARED)
        n = b.joined(shared)
        removed = n.at[n.smaller(told.bits(JOINED))]
        n, lo = b.drawn(shared)
        left = np.zeros(len(b.buf) + 1, np.int32)
        np.cumsum(~b.decided(removed), out=left[1:], dtype=np.int32)
        asks = n.smaller(told.bits(DRAWN)) & (left[n.at + 1] > left[lo])
        wanted = np.zeros(len(n.values), bool)
        wanted[n.place[asks]] = True
        return [kept(REMOVED, removed), *((WANTED, p, _bits(wanted[a:z])) for p, a, z in _by_part(n.values, bits, parts))]

    def rest(b: Block, told: Told) -> list:
        n, lo = b.drawn(told.positions(SHARED))
        wanted = told.bits(WANTED)[n.place]
        around = b.covered(lo[wanted], n.at[wanted] + 1) & ~b.decided(told.positions(REMOVED))
        at = b.fits(np.flatnonzero(around), length)
        return [kept(REST, at), *sent(b.names(at, length).values, WHOLE, 64)]

    def end(b: Block, told: Told) -> pa.Table:
        removed = told.positions(REMOVED)
        n = b.names(told.positions(REST), length)
        last = n.at[n.smaller(told.bits(WHOLE))]
        return finish(b, b.covered(removed, removed + length + v) | b.covered(last, last + length))

    def compare(t: pa.Table) -> pa.Table:
        out = _compare(t)
        trimmed()
        return out

    def compared(messages: DataFrame, name: str) -> DataFrame:
        out = stored(messages.where("part >= 0").groupBy("part").applyInArrow(compare, RECORD), name)
        released(spark)
        return out

    def of(df: DataFrame, *kinds: int) -> DataFrame:
        return df.where(F.col("kind").isin(*kinds))

    told = compared(blocks.mapInArrow(sample, RECORD), "suffix-samples")
    second = stored(stage(told, join), "suffix-joined")
    dropped(told)
    released(spark)
    told = compared(second, "suffix-joined-told")
    third = stored(stage(of(second, SHARED).unionByName(told), ask), "suffix-removed")
    dropped(told)
    released(spark)
    told = stored(of(second, DRAWN).groupBy("part").cogroup(of(third, WANTED).groupBy("part")).applyInArrow(_any, RECORD), "suffix-wanted")
    released(spark)
    fourth = stored(stage(of(second, SHARED).unionByName(of(third, REMOVED)).unionByName(told), rest), "suffix-rest")
    dropped(told, second)
    released(spark)
    told = compared(fourth, "suffix-rest-told")
    out = stored(stage(of(third, REMOVED).unionByName(of(fourth, REST)).unionByName(told), end, schema).withColumn("id", own_id(F.col("id"), size["none"])), "suffix-result")
    dropped(blocks, third, fourth, told)
    released(spark)
    return out


def _measures(b: Block, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By row: bytes, removed bytes, maximal removed runs; and the offsets of what is kept."""
    gone = np.zeros(len(b.buf) + 1, np.int32)
    np.cumsum(mask, out=gone[1:], dtype=np.int32)
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    heads = b.off[:-1][b.off[:-1] < len(b.buf)]
    start[heads] = mask[heads]
    runs = np.zeros(len(b.buf) + 1, np.int32)
    np.cumsum(start, out=runs[1:], dtype=np.int32)
    return np.diff(b.off), np.diff(gone[b.off]).astype(np.int64), np.diff(runs[b.off]).astype(np.int64), b.off - gone[b.off]


def report(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (id_col, n_bytes, n_removed, n_spans, kept_sha256)."""

    def finish(b: Block, mask: np.ndarray) -> pa.Table:
        n, removed, runs, kept = _measures(b, mask)
        left = b.buf[~mask].tobytes()
        sha = [hashlib.sha256(left[kept[i] : kept[i + 1]]).hexdigest() for i in range(len(n))]
        return pa.table({"id": b.ids, "n_bytes": n, "n_removed": removed, "n_spans": runs, "kept_sha256": pa.array(sha, pa.string())})

    return analysed(docs, finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, id_col, text_col).withColumnRenamed("id", id_col)


def cut_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, mark binary, spans array of struct(start, end) of removed bytes) of the rows that lose any.

    `mark` is the MD5 of the text as it was, which tells rows of one id apart.
    """

    def finish(b: Block, mask: np.ndarray) -> pa.Table:
        some = np.flatnonzero(_measures(b, mask)[1])
        marks, cut = [], []
        for i in some:
            a, z = b.off[i], b.off[i + 1]
            marks.append(hashlib.md5(b.buf[a:z].tobytes()).digest())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[a:z].astype(np.int8), [0]])))
            cut.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
        return pa.table({"id": b.ids[some], "mark": pa.array(marks, pa.binary()), "spans": pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return analysed(docs, finish, "id long, mark binary, spans array<struct<start: bigint, end: bigint>>", length, id_col, text_col)


def without(text: bytes, spans: list[dict]) -> str:
    """The text without the spans; a character of which a part goes, goes whole."""
    out, at = [], 0
    for s in spans:
        a, z = s["start"], s["end"]
        while a > at and text[a] & 0xC0 == 0x80:
            a -= 1
        while z < len(text) and text[z] & 0xC0 == 0x80:
            z += 1
        out.append(text[at : max(a, at)])
        at = max(at, z)
    return b"".join([*out, text[at:]]).decode()


def deduplicated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with what is left of their texts; other columns as they were."""
    key, spans_col, mark_col, id_name, mark_name = fresh(docs.columns, "__key", "__spans", "__mark", "__cut_id", "__cut_mark")
    own, _ = row_keys(docs, id_col, text_col, name=key)
    cut = cut_spans(own, length, key, text_col).toDF(id_name, mark_name, spans_col).dropDuplicates([id_name, mark_name])
    own = own.withColumn(mark_col, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    d = own.join(cut, (F.col(key) == F.col(id_name)) & (F.col(mark_col) == F.col(mark_name)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], spans_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text_col)
            where = b.column(len(docs_columns))
            texts = b.column(k)
            if where.null_count < len(b):
                rows = [t if s is None or t is None else without(t.encode(), s) for t, s in zip(texts.to_pylist(), where.to_pylist(), strict=True)]
                texts = pa.array(rows, texts.type)
            yield pa.RecordBatch.from_arrays([texts if i == k else b.column(i) for i in range(len(docs_columns))], docs_columns)

    docs_columns = docs.columns
    return d.mapInArrow(run, docs.schema)
