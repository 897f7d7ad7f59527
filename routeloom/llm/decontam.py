"""Operator 8: benchmark decontamination by training suffix arrays.

Each pass over documents (a shard) gets the suffix array of its words: the start positions that can match at all, sorted
by the words that follow, up to the window's length.  Every test suffix (the words of a benchmark item from some word on)
is binary-searched in it; the range it finds holds all its occurrences.  Consecutive occurrences on one diagonal make the
longest verbatim matches with their places.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased.  A window is WINDOW consecutive words of an
item; a shorter item with words is one window; an item without words or with null text has none.  A document is affected
if any word is hit and 20 * hits >= words.

The windows of one slice of the benchmark are broadcast; slices hold at most SLICE_BYTES of its text (a longer item is a
slice of its own), so a benchmark of any size passes in turns, each turn carrying the hits so far with its document.
No document text is shuffled.

Null or empty documents have no words and no hits; repeated rows are judged each for itself; items repeated under
several ids are all named; items without an id are items too, found under a null that counts as one name and is in no digest; empty tables give empty results; columns of other names pass through remove() unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, batches_of, grams, starts_within, text_bytes, word_hashes, words_of

WINDOW = 13
#: Benchmark text in one broadcast.
SLICE_BYTES = 8 << 20
#: Words by which a position is let into the suffix array (fewer, where an item has fewer).
LEAD = 4


def row_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words in order, and the first word of each row."""
    low = LOWER[buf]
    starts, ends, first = words_of(low, off, ALNUM)
    return word_hashes(low, starts, ends), first


class Windows:
    """The test suffixes of a slice of the benchmark: distinct windows as rows of big-endian words, and where they come from."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        buf, off = text_bytes(pa.array(texts, pa.string()))
        words, first = row_words(buf, off)
        rows, self.items, self.names, self.at, lens = [], [], [], [], []
        for i, item in enumerate(ids):
            w = words[first[i] : first[i + 1]]
            n = min(window, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                rows.append(w[k : k + n])
                self.items.append(item)
                self.names.append((item is None, item or "", i if item is None else 0))  # sorts, and tells items without an id apart
                self.at.append(k)
                lens.append(n)
        self.window, self.lens = window, np.array(lens, np.int64)
        self.by_len = {}
        for n in sorted(set(lens)):
            own = [i for i, x in enumerate(lens) if x == n]
            self.by_len[n] = (keys_of(np.array([rows[i] for i in own], np.uint64), n), np.array(own))
        self.lead = min([LEAD, *lens])
        self.leads = np.unique([grams(r[: self.lead], self.lead)[0] for r in rows]) if rows else np.zeros(0, np.uint64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.leads >> np.uint64(44)] = True


def keys_of(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of words as byte strings that sort as the rows do."""
    return np.ascontiguousarray(rows.astype(">u8")).view(f"S{8 * width}").ravel() if len(rows) else np.zeros(0, f"S{8 * width}")


class SuffixArray:
    """The sorted suffixes (to `window` words) at those positions of a shard whose first words begin some test suffix."""

    def __init__(self, words: np.ndarray, first: np.ndarray, w: Windows):
        lead = grams(words, w.lead)
        at = np.flatnonzero(w.bits[lead >> np.uint64(44)] & starts_within(first, w.lead)) if len(lead) else np.zeros(0, np.int64)
        at = at[np.isin(lead[at], w.leads)] if len(at) else at
        end = first[np.searchsorted(first, at, "right")]  # the end of the row
        rows = np.zeros((len(at), w.window), np.uint64)
        for k in range(w.window):
            ok = at + k < end
            rows[ok, k] = words[at[ok] + k]
        keys = keys_of(rows, w.window)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.left = keys[order], at[order], (end - at)[order]

    def find(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """All (position, window) where a window stands, by binary search of every window."""
        where, which = [], []
        for n, (keys, own) in w.by_len.items():
            lo = np.searchsorted(self.keys, keys, "left")
            # the last suffix that begins with the key: the key with all later words at their largest
            high = np.full((len(keys), 8 * w.window), 255, np.uint8)
            high[:, : 8 * n] = np.frombuffer(keys.tobytes(), np.uint8).reshape(len(keys), 8 * n)
            hi = np.searchsorted(self.keys, high.view(f"S{8 * w.window}").ravel(), "right")
            size = hi - lo
            if size.sum():
                pos = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                win = np.repeat(own, size)
                ok = self.left[pos] >= n
                where.append(self.at[pos[ok]])
                which.append(win[ok])
        return (np.concatenate(where), np.concatenate(which)) if where else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def slices(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[tuple[list[str | None], list[str | None]]]:
    """The benchmark's rows, a bounded number of bytes at a time (rows come to the driver partition by partition)."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if ids and size + len(r[1] or "") * 4 > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "") * 4
    yield ids, texts


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs and `__hits`: struct(n_words long, spans array of struct(start, end) of hit words, items array of item ids)."""
    hits = T._parse_datatype_string("struct<n_words: bigint, spans: array<struct<start: bigint, end: bigint>>, items: array<string>>")
    out = docs
    for ids, texts in slices(benchmark, item_col, item_text, slice_bytes):
        had = "__hits" in out.columns
        schema = out.schema if had else T.StructType([*out.schema.fields, T.StructField("__hits", hits)])
        shared = docs.sparkSession.sparkContext.broadcast(Windows(ids, texts, window))
        out = out.mapInArrow(_finder(shared, text_col, had), schema)
    return out


def _finder(shared, text_col: str, had: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b, buf, off in batches_of(batches, text_col):
            words, first = row_words(buf, off)
            where, which = SuffixArray(words, first, w).find(w)
            row = np.searchsorted(first, where, "right") - 1
            order = np.lexsort((which, where))
            where, which, row = where[order], which[order], row[order]
            at = np.searchsorted(row, np.arange(len(b) + 1))
            before = b.column(b.schema.get_field_index("__hits")).to_pylist() if had else None
            out = []
            for i in range(len(b)):
                old = before[i] if had else None
                a, z = at[i], at[i + 1]
                pairs = [(int(p - first[i]), int(p - first[i] + n)) for p, n in zip(where[a:z], w.lens[which[a:z]], strict=True)]
                found = {w.items[k] for k in which[a:z]}
                if old:
                    pairs += [(s["start"], s["end"]) for s in old["spans"]]
                    found |= set(old["items"])
                out.append({"n_words": int(first[i + 1] - first[i]), "spans": [{"start": s, "end": e} for s, e in merged(pairs)], "items": sorted(found, key=lambda x: (x is None, x or ""))})
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
            cols = [c for c, f in zip(b.columns, b.schema.names, strict=True) if f != "__hits"]
            names = [f for f in b.schema.names if f != "__hits"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, kind)], [*names, "__hits"])

    return run


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _digest(h):
    n_hit = F.aggregate(h["spans"], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return n_hit, (n_hit > 0) & (20 * n_hit >= h["n_words"])


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest run of hit words."""
    d = with_hits(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), benchmark, "text", **how)
    h = F.col("__hits")
    n_hit, bad = _digest(h)
    return d.select(
        F.col("id").alias(id_col),
        h["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", h["items"]), 256).alias("items_sha256"),
        bad.alias("contaminated"),
        F.coalesce(F.array_max(F.transform(h["spans"], lambda s: s["end"] - s["start"])), F.lit(0)).cast("long").alias("longest_run"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents that are not affected, with their columns as they were."""
    d = with_hits(docs, benchmark, text_col, **how)
    return d.where(~_digest(F.col("__hits"))[1]).drop("__hits")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The longest verbatim matches: (id_col, item_id, doc_word, item_word, n_words), each maximal to both sides."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for ids, texts in slices(benchmark, item_col, item_text, slice_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Windows(ids, texts, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            w = shared.value
            for b, buf, off in batches_of(batches, "text"):
                words, first = row_words(buf, off)
                where, which = SuffixArray(words, first, w).find(w)
                rows = []
                own = np.searchsorted(first, where, "right") - 1
                hits = sorted((int(r), w.names[k], int(p - first[r]) - w.at[k], w.at[k], int(w.lens[k])) for p, k, r in zip(where, which, own, strict=True))
                for r, item, diagonal, at, n in hits:
                    if rows and rows[-1][:3] == [r, item, diagonal] and at <= rows[-1][4]:
                        rows[-1][4] = at + n
                    else:
                        rows.append([r, item, diagonal, at, at + n])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[x[0]].as_py() for x in rows], pa.int64()), pa.array([None if x[1][0] else x[1][1] for x in rows], pa.string()), *(pa.array(v, pa.int64()) for v in ([x[2] + x[3] for x in rows], [x[3] for x in rows], [x[4] - x[3] for x in rows]))],
                    ["id", "item_id", "doc_word", "item_word", "n_words"],
                )

        part = d.mapInArrow(run, "id long, item_id string, doc_word long, item_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def digest_of(items: list[str]) -> str:
    """The digest column of report() for a list of items, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
