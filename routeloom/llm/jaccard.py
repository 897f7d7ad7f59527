"""Operator 7: n-gram Jaccard self-join by size, light sets by subsets and heavy sets by inverted lists.

A document's set holds the distinct WORDS-word shingles of its lower-cased words (64-bit fingerprints).  Documents of
equal sets are one class; the join runs over the classes' representatives (their smallest id).

A link with a set of n shingles has ceil(PERCENT * n / 100) of them in common at least, so a set misses few of its own.
Light sets (size up to a boundary) enumerate all subsets of the sizes that an intersection can have: two of them are
linked if and only if they share such a subset that is large enough for both sizes, so no pair needs another look, and a
chain from the smallest member of each subset's list connects what is linked.  Heavy sets scan inverted lists of their
rarest shingles: in one global order (how many documents hold a shingle, then its fingerprint) linked sets share a shingle
within their first n - ceil(PERCENT * n / 100) + 1.  The boundary is the size at which the records cost least: the subsets
of all sets up to it, against the entries of larger sets (and of those light ones that can link with them) in the lists
and the lengths of the lists that the larger ones scan.

Lists are scanned without forming all pairs of a list: first each list's members against its smallest one; after the
links so found are joined to components, only members of different components of a list are still compared, by length
and position first, then exactly on whole sets.  A pair that shares a list is thus compared or known to be connected.
Components of a list meet by classes of size, each PERCENT of the next, so that a list of many sizes is split.

How many documents hold a shingle is counted by parts of the fingerprint range: blocks of documents send their sorted
distinct fingerprints (cut to as many bits as the corpus needs), and get the counts back in the same order.

Null and empty texts have empty sets, are linked with nothing, and are components of their own; rows that repeat an id
count as that id, whose links are those of all its texts; rows without an id are documents of their own after all others (ids of their classes and components are
null where no row has one); empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, dropped, fresh, grams, mixed, own_id, pack_blocks, packed, packed_sorted, parts_of, passes, released, row_keys, stored, unpack, unpacked, unpacked_sorted, word_hashes, words_of
from .components import components

#: Bytes of sets that are compared with one set in a task.
HELD = 8 << 20


def need(n: int, percent: int) -> int:
    """How many of n shingles a link has in common at least."""
    return -(-percent * n // 100)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each row."""
    out = []
    for i, j in passes(off):
        part, o = LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        starts, ends, first = words_of(part, o, NOT_SPACE)
        words = word_hashes(part, starts, ends)
        whole = grams(words, k)
        for r in range(j - i):
            a, z = first[r], first[r + 1]
            if z - a >= k:
                out.append(np.unique(whole[a : z - k + 1]))
            elif z > a:
                out.append(mixed(grams(words[a:z], int(z - a)) + np.uint64(z - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_bytes(s: np.ndarray) -> bytes:
    """A set's fingerprints, for exact comparison of two sets."""
    return np.ascontiguousarray(s).tobytes()


def set_of(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def subsets(n: int, percent: int) -> int:
    """How many subsets a light set of n shingles enumerates."""
    return sum(math.comb(n, g) for g in range(n - need(n, percent) + 1))


def light_keys(s: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(size, key) of every subset that a link of the set can have in common."""
    m = [int(x) for x in mixed(s)]
    total, mask = sum(m), (1 << 63) - 1
    out = []
    for gone in range(len(m) - need(len(m), percent) + 1):
        out += [(len(m) - gone, (total - sum(c)) & mask) for c in combinations(m, gone)]
    return out


def _signatures(blocks: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, buf, off = unpack(r["ids"], r["lens"], r["payload"])
                sets = shingle_sets(buf, off, k)
                one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                two = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, np.full(len(ids), r["block"], np.int64), n, one, two)], ["id", "block", "n", "one", "two"])

    return blocks.mapInArrow(run, "id long, block long, n long, one long, two long")


def _cuts(parts: int, bits: int) -> np.ndarray:
    return np.array([(1 << bits) * i // parts for i in range(1, parts)], np.uint64)


def _names(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct cut fingerprints of all sets, how many sets hold each, and the place of each set's members among them."""
    flat = np.concatenate(sets) >> np.uint64(64 - bits) if sets else np.zeros(0, np.uint64)
    names, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    return names, counts, place


def _counted(blocks: DataFrame, k: int, bits: int, parts: int) -> DataFrame:
    """(block, part, counts): in how many documents each of a block's names stands, in the order of the names."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                _, buf, off = unpack(r["ids"], r["lens"], r["payload"])
                names, counts, _ = _names(shingle_sets(buf, off, k), bits)
                at = [0, *np.searchsorted(names, _cuts(parts, bits)).tolist(), len(names)]
                rows = [(p, packed_sorted(names[at[p] : at[p + 1]]), packed(counts[at[p] : at[p + 1]].astype(np.uint32))) for p in range(parts) if at[p + 1] > at[p]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([r["block"]] * len(rows), pa.int64()), pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.binary())], ["part", "block", "names", "counts"])

    def count(t: pa.Table) -> pa.Table:
        names = [unpacked_sorted(x) for x in t.column("names").to_pylist()]
        own = np.concatenate([unpacked(x, np.uint32) for x in t.column("counts").to_pylist()]).astype(np.int64)
        flat = np.concatenate(names)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=flat[order[0]] + np.uint64(1)))
        total = np.add.reduceat(own[order], first)
        back = np.empty(len(flat), np.uint32)
        back[order] = np.minimum(np.repeat(total, np.diff(np.append(first, len(flat)))), 2**32 - 1)
        at = np.cumsum([0, *map(len, names)])
        return pa.table({"block": t.column("block"), "part": t.column("part"), "data": pa.array([packed(back[at[i] : at[i + 1]]) for i in range(len(names))], pa.binary())})

    return blocks.mapInArrow(send, "part int, block long, names binary, counts binary").groupBy("part").applyInArrow(count, "block long, part int, data binary")


def _candidates(blocks: DataFrame, told: DataFrame, k: int, bits: int, percent: int) -> DataFrame:
    """Of every representative: size, the shingles of its prefix that other documents hold too, their positions, and its set."""
    empty = {"id": pa.int64(), "n": pa.int64(), "tokens": pa.list_(pa.int64()), "pos": pa.list_(pa.int32()), "set": pa.binary()}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in empty}
        rows = sorted(zip(right.column("part").to_pylist(), right.column("data").to_pylist(), strict=True), key=lambda x: x[0])
        reps = np.frombuffer(b"".join(d for p, d in rows if p < 0), np.int64)
        df = np.concatenate([np.zeros(0, np.uint32), *(unpacked(d, np.uint32) for p, d in rows if p >= 0)])
        for r in left.to_pylist():
            ids, buf, off = unpack(r["ids"], r["lens"], r["payload"])
            sets = shingle_sets(buf, off, k)
            place = _names(sets, bits)[2]
            at = np.cumsum([0, *map(len, sets)])
            wanted = np.isin(ids, reps)
            seen = set()
            for i in np.flatnonzero(wanted):
                s = sets[i]
                mark = (int(ids[i]), int(s.sum(dtype=np.uint64)))
                if not len(s) or mark in seen:
                    continue
                seen.add(mark)
                own = df[place[at[i] : at[i + 1]]]
                order = np.lexsort((s, own))[: len(s) - need(len(s), percent) + 1]
                pos = np.flatnonzero(own[order] > 1)
                if len(pos):  # a set without a shared shingle there has no link
                    out["id"].append(int(ids[i]))
                    out["n"].append(len(s))
                    out["tokens"].append(s[order[pos]].view(np.int64))
                    out["pos"].append(pos.astype(np.int32))
                    out["set"].append(set_bytes(s))
        return pa.table({c: pa.array(out[c], kind) for c, kind in empty.items()})

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "id long, n long, tokens array<bigint>, pos array<int>, set binary")


def _verified(pairs: DataFrame, cands: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets pass; the partners of a set come in shares of about HELD bytes."""
    sets = cands.select("id", "set")
    right = pairs.join(cands.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    shares = pairs.join(cands.select(F.col("id").alias("b"), F.col("n").alias("m")), "b").groupBy("a").agg(F.ceil(F.sum("m") * 8 / F.lit(HELD)).cast("int").alias("shares"))
    left = sets.withColumnsRenamed({"id": "a", "set": "x"}).join(shares, "a").select("a", "x", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    right = right.join(shares, "a").select("a", "b", "y", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    d = right.join(left, ["a", "share"]).select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, raw, s = None, None, None
        for b in batches:
            a, o = b.column(0).to_pylist(), b.column(1).to_pylist()
            ok = []
            for i in range(len(b)):
                x = b.column(2)[i].as_buffer()
                if a[i] != last or not x.equals(raw):
                    last, raw = a[i], x
                    s = set_of(x)
                t = set_of(b.column(3)[i].as_buffer())
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(a, ok, strict=True) if y], pa.int64()), pa.array([x for x, y in zip(o, ok, strict=True) if y], pa.int64())], ["a", "b"])

    return d.mapInArrow(run, "a long, b long")


def _may(percent: int):
    """Length and position filters on columns n, m (sizes) and i, j (positions of a common shingle)."""
    n, m = F.col("n"), F.col("m")
    most = F.least(n - F.col("i"), m - F.col("j"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (100 * most >= percent * (n + m - most))


def boundary(cands: DataFrame, posts: DataFrame, percent: int) -> int:
    """The largest light size: the least of the records of both halves (see above).

    Sizes with more subsets than all lists have records can't be light, so that few sizes reach the driver.
    """
    lens = posts.groupBy("token").agg(F.count("*").alias("members")).where("members > 1")
    scans = posts.join(lens, "token").groupBy("n").agg(F.sum("members").alias("scan"))
    by_size = cands.groupBy("n").agg(F.count("*").alias("sets"), F.sum(F.size("tokens")).alias("posts")).join(scans, "n", "left").select("n", "sets", "posts", F.coalesce("scan", F.lit(0)).alias("scan"))
    by_size = stored(by_size, "jaccard-sizes")
    total = by_size.agg(F.sum(F.col("posts") + F.col("scan"))).first()[0] or 0
    most = 0
    while subsets(most + 1, percent) <= total:
        most += 1
    rows = by_size.where(F.col("n") <= most + 1).collect()
    dropped(by_size)

    def cost(x: int) -> int:
        least = need(x + 1, percent)  # smaller sets link with no heavy one
        return sum(subsets(r["n"], percent) * r["sets"] if r["n"] <= x else r["scan"] for r in rows) + sum(r["posts"] for r in rows if r["n"] >= least)

    return min(range(most + 1), key=lambda x: (cost(x), -x))


def _light_edges(cands: DataFrame, most: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, *k) for i, n, s in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True) for k in light_keys(set_of(s), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["id", "n", "size", "key"])

    keys = cands.where(F.col("n") <= most).select("id", "n", "set").mapInArrow(run, "id long, n long, size long, key long")
    first = keys.groupBy("key", "size").agg(F.min(F.struct("n", "id")).alias("p"), F.count("*").alias("c")).where("c > 1").select("key", "size", F.col("p.n").alias("m"), F.col("p.id").alias("a"))
    both = keys.join(first, ["key", "size"])
    return both.where((100 * F.col("size") >= percent * (F.col("n") + F.col("m") - F.col("size"))) & (F.col("a") != F.col("id"))).select("a", F.col("id").alias("b")).distinct()


def join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", light: int | None = None) -> DataFrame:
    """One row a document: (id_col, n_shingles long, class_id long - the smallest id of an equal set, component_id long).

    `light` sets the boundary in place of the costs.
    """
    spark = docs.sparkSession
    blocks, size = pack_blocks(docs, id_col, text_col, "jaccard-blocks")
    bits = max(40, min(63, math.ceil(math.log2(size["bytes"] + 2)) + 10))
    parts = parts_of(spark, size["bytes"] / 6, 2 << 20)
    sigs = stored(_signatures(blocks, words), "jaccard-signatures")
    reps = sigs.where("n > 0").groupBy("one", "two", "n").agg(F.min(F.struct("id", "block")).alias("r")).select("one", "two", "n", F.col("r.id").alias("rep"), F.col("r.block").alias("block"))
    counts = stored(_counted(blocks, words, bits, parts), "jaccard-counts")
    released(spark)

    def ids(t: pa.Table) -> pa.Table:
        return pa.table({"block": t.column("block")[:1], "part": pa.array([-1], pa.int32()), "data": pa.array([np.ascontiguousarray(t.column("rep").to_numpy()).tobytes()], pa.binary())})

    told = counts.unionByName(reps.select("block", "rep").groupBy("block").applyInArrow(ids, "block long, part int, data binary"))
    cands = stored(_candidates(blocks, told, words, bits, percent), "jaccard-candidates")
    dropped(blocks, counts)
    released(spark)

    posts = cands.select("id", "n", F.explode(F.arrays_zip("tokens", "pos")).alias("t")).select("id", "n", F.col("t.tokens").alias("token"), F.col("t.pos").alias("i"))
    x = boundary(cands, posts, percent) if light is None else light
    posts = posts.where(F.col("n") >= need(x + 1, percent))
    heads = posts.groupBy("token").agg(F.min(F.struct("id", "n", "i")).alias("p"), F.count("*").alias("members")).where("members > 1")
    lists = stored(posts.join(heads, "token"), "jaccard-lists")
    edges = _light_edges(cands, x, percent)
    # an id of several texts ties their classes
    twice = sigs.where("n > 0").groupBy("id").agg(F.min("one").alias("lo"), F.max("one").alias("hi")).where("lo != hi")
    edges = edges.unionByName(sigs.join(twice, "id", "left_semi").join(reps, ["one", "two", "n"]).select(F.col("rep").alias("a"), F.col("id").alias("b")))

    # each list's members against its smallest one (pairs of two light sets are done)
    heavy = F.greatest("n", "m") > x
    tried = lists.select("id", "n", "i", F.col("p.id").alias("a"), F.col("p.n").alias("m"), F.col("p.i").alias("j")).where((F.col("a") != F.col("id")) & heavy & _may(percent))
    tried = stored(tried.select("a", F.col("id").alias("b")).distinct(), "jaccard-tried")
    edges = stored(edges.unionByName(_verified(tried, cands, percent)), "jaccard-edges")
    found = components(edges)

    # members of different components of a list
    at = lists.select("token", "id", "n", "i").join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    mixed_lists = at.select("token", "c").distinct().groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    # a set of class s links with sets of the classes s - 1, s and s + 1 alone
    at = at.withColumn("s", F.floor(F.log(F.col("n").cast("double")) / F.lit(1.001 * math.log(100 / percent))).cast("int") if percent < 100 else F.col("n").cast("int"))
    at = stored(at.join(mixed_lists, "token", "left_semi"), "jaccard-mixed")
    near = at.groupBy("token", "s", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("i")).alias("rest"), F.count("*").alias("size"))
    other = near.select("token", *[F.col(k).alias(v) for k, v in (("s", "s2"), ("c", "d"), ("lo", "lo2"), ("hi", "hi2"), ("rest", "rest2"), ("size", "size2"))])
    other = other.withColumn("s", F.explode(F.array(F.col("s2"), F.col("s2") - 1)))  # a pair meets at its smaller class
    may = (100 * F.col("hi") >= percent * F.col("lo2")) & (100 * F.col("hi2") >= percent * F.col("lo")) & ((100 + percent) * F.least("rest", "rest2") >= percent * (F.col("lo") + F.col("lo2")))
    once = (F.col("s") < F.col("s2")) | (F.col("c") < F.col("d"))
    meet = near.join(other, ["token", "s"]).where((F.col("c") != F.col("d")) & once & may & (F.greatest("hi", "hi2") > x))
    # the members of the smaller component are spread out, and meet those of the larger one under the filters
    first = F.col("size") <= F.col("size2")
    meet = meet.select("token", F.when(first, F.struct("c", "s")).otherwise(F.struct(F.col("d").alias("c"), F.col("s2").alias("s"))).alias("u"), F.when(first, F.struct(F.col("d").alias("c"), F.col("s2").alias("s"))).otherwise(F.struct("c", "s")).alias("v"))
    meet = meet.select("token", F.col("u.c").alias("c"), F.col("u.s").alias("s"), F.col("v.c").alias("d"), F.col("v.s").alias("r"))
    left = at.join(meet, ["token", "c", "s"]).select("token", "d", "r", F.col("id").alias("a"), "n", "i")
    right = at.select(F.col("token").alias("token2"), F.col("c").alias("d2"), F.col("s").alias("r2"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"))
    pairs = left.join(right, (F.col("token") == F.col("token2")) & (F.col("d") == F.col("d2")) & (F.col("r") == F.col("r2")) & heavy & _may(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "jaccard-pairs")
    final = components(_verified(pairs, cands, percent).unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b"))))

    classes = reps.select("one", "two", "n", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left").select("one", "two", "n", F.col("rep"), F.coalesce("component", "rep").alias("component"))
    own = lambda c: own_id(c, size["none"])
    out = sigs.join(classes, ["one", "two", "n"], "left").select(own(F.col("id")).alias("id"), F.col("n").alias("n_shingles"), own(F.coalesce("rep", "id")).alias("class_id"), own(F.coalesce("component", "id")).alias("component_id"))
    out = stored(out, "jaccard-result")
    dropped(sigs, cands, lists, tried, edges, found, at, pairs, final)
    released(spark)
    return out.withColumnRenamed("id", id_col)


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that have the smallest id of their component, with their columns as they were; one of a component without ids."""
    key, first = fresh(docs.columns, "__key", "__first")
    own, _ = row_keys(docs, id_col, text_col, name=key)
    kept = join(own, words, percent, key, text_col).where(F.col(key) == F.col("component_id")).select(F.col(key).alias(first)).distinct()
    return own.join(kept, own[key] == kept[first], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
