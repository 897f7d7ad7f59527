"""Operator 2: exact top-k search by inner product with a pivot-distance index.

Vectors are quantised to integers (floor of scale * x).  One more coordinate, sqrt(M^2 - |x|^2) with M the largest norm,
puts all rows at distance M from the origin, so that the largest inner product is the smallest distance.  Each row's key
is its nearest pivot and its distance from it; a pivot's rows fall into annuli of equal width, and an annulus of many
rows into blocks by a hash of the id.  A query first searches the annulus it lies in (and, while it has fewer than k
rows, those next to it outward), which bounds its k-th best score from below; then every further annulus whose distance
bound - by the triangle inequality | d(q, p) - r |, and by half the difference of the distances to two pivots - still
allows that score is searched, and the others are not.  The result is exact: bounds have a margin for rounding, and
scores are integer sums.

Only the pivots (at most MAX_PIVOTS, chosen from a sample of at most SAMPLE rows by a few rounds of Lloyd's algorithm) and
the directory of annuli (at most MAX_PIVOTS * RINGS rows) reach the driver and are broadcast; the index holds every row.

Vectors that are null, or hold null or non-finite components, and rows without an id take no part.  Shorter vectors
count as filled up with zeros.  Equal rows tie and go by id; rows that repeat a query's id are the query's own.  Empty
tables give empty results.  Scores are sums of long integers; vectors too long for that are an error.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, released, stored

SAMPLE = 4096
MAX_PIVOTS = 256
RINGS = 64
#: Rows of one block and queries of one group that meet in a task.
BLOCK = 4096


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id long, v array<long>) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x)).alias("v"))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(n) and (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    """Rows with the coordinate that makes their norm sqrt(top)."""
    x = v.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))[:, None]])


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T))


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """k centres by Lloyd's algorithm from evenly spaced sample rows."""
    p = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(8):
        near = distances(sample, p).argmin(1)
        p = np.array([sample[near == i].mean(0) if (near == i).any() else p[i] for i in range(k)])
    return p


def search(df: DataFrame, queries: str, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query id, rank int, id, score long): the k best other rows of each row for which the SQL condition `queries` on the column `id` holds, as columns query_id, rank, <id_col>, score."""
    spark = df.sparkSession
    every = stored(quantised(df, id_col, vec_col, scale).withColumn("q", F.coalesce(F.expr(queries), F.lit(False))), "topk-rows")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    s = every.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("top"), F.count_if("q").alias("nq")).first()
    n, dim, top = s["n"], s["dim"] or 0, s["top"] or 0.0
    exact = top < 2**52  # then every partial sum of a product is an exact double
    if top >= 2**62:
        raise OverflowError("scores of these vectors don't fit long integers")
    out = "query_id long, rank int, id long, score long"
    if not n or not dim:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)

    rows = every.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v")
    sample = lifted(matrix(rows, dim), top)
    pivots = choose_pivots(sample, min(len(sample), MAX_PIVOTS, max(1, math.isqrt(n) // 6)))
    width = max(2 * math.sqrt(top) / RINGS, 1e-9) if top else 1.0

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(lifted(matrix(b.column(1), dim), top), pivots)
            cell = d.argmin(1)
            r = d[np.arange(len(cell)), cell]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(np.floor(r / width).astype(np.int32)), pa.array(r)], ["id", "v", "q", "cell", "ring", "r"])

    index = every.mapInArrow(keyed, "id long, v array<bigint>, q boolean, cell int, ring int, r double")
    index = stored(index, "topk-index")
    found = index.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).orderBy("cell", "ring").collect()
    cells, rings, sizes, lo, hi = (np.array([x[c] for x in found]) for c in ("cell", "ring", "n", "lo", "hi"))
    blocks = -(-sizes // BLOCK)
    groups = max(1, -(-s["nq"] // BLOCK))

    # the index by (annulus, block); queries come in groups of about BLOCK
    ann = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"cell": int(c), "ring": int(r), "ann": i, "blocks": int(z)} for i, (c, r, z) in enumerate(zip(cells, rings, blocks, strict=True))])), "array<struct<cell int, ring int, ann int, blocks int>>")))
    held = index.join(F.broadcast(ann), ["cell", "ring"]).select("id", "v", "ann", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    asked = index.where("q").select("id", "v", F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(groups)).cast("int").alias("grp")).dropDuplicates(["id"])

    margin = 1e-6 * (1 + math.sqrt(top)) * 4

    def lower(q: np.ndarray) -> np.ndarray:
        """For each query and annulus, a distance that no row of it is nearer than."""
        x = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
        d = distances(x, pivots)
        near = d.min(1)[:, None]
        dc = d[:, cells]
        return np.maximum(np.maximum(dc - hi, lo - dc), np.maximum(0.0, (dc - near) / 2)) - margin

    def visits(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column(1), dim)
            low = lower(q)
            if first:
                # annuli in the order of their bounds until they hold more than k rows
                order = np.argsort(low, 1, kind="stable")
                before = np.cumsum(sizes[order], 1) - sizes[order]
                mask = np.zeros(low.shape, bool)
                np.put_along_axis(mask, order, before <= k, 1)
            else:
                floor = b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                seen = np.zeros(low.shape, bool)
                at = b.column(4)
                for i in range(len(b)):
                    seen[i, at[i].as_py()] = True
                best = ((q.astype(np.float64) ** 2).sum(1)[:, None] + top - np.maximum(low, 0.0) ** 2) / 2
                mask = (best >= floor[:, None] - 1e-6 * (1 + top)) & ~seen
            i, a = np.nonzero(mask)
            rep = blocks[a]
            i, a = np.repeat(i, rep), np.repeat(a, rep)
            block = np.arange(len(a)) - np.repeat(np.cumsum(rep) - rep, rep)
            step = max(1, (8 << 20) // (8 * dim))
            for z in range(0, len(i), step):
                t = pa.array(i[z : z + step])
                yield pa.RecordBatch.from_arrays([b.column(0).take(t), b.column(1).take(t), b.column(2).take(t), pa.array(a[z : z + step].astype(np.int32)), pa.array(block[z : z + step].astype(np.int32))], ["id", "v", "grp", "ann", "block"])

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best rows of a block for each query that visits it."""
        names = ["query_id", "id", "score", "ann"]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int32() if c == "ann" else pa.int64()) for c in names})
        ids, qid = left.column("id").to_numpy(), right.column("id").to_numpy()
        x, q = matrix(left.column("v"), dim), matrix(right.column("v"), dim)
        out = []
        for z in range(0, len(q), 512):
            own = qid[z : z + 512]
            s = (q[z : z + 512].astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if exact else q[z : z + 512] @ x.T
            low = np.iinfo(np.int64).min
            s[own[:, None] == ids[None]] = low
            m = min(k, s.shape[1])
            kth = np.partition(s, s.shape[1] - m, 1)[:, s.shape[1] - m]
            i, j = np.nonzero((s >= kth[:, None]) & (s > low))
            order = np.lexsort((ids[j], -s[i, j], i))
            i, j = i[order], j[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
            i, j = i[rank < k], j[rank < k]
            out.append((own[i], ids[j], s[i, j]))
        a, b, c = (np.concatenate(y) for y in zip(*out, strict=True))
        return pa.table({"query_id": a, "id": b, "score": c, "ann": np.full(len(a), key[0].as_py(), np.int32)})

    def run(want: DataFrame) -> DataFrame:
        keys = ["ann", "block", "grp"]
        visited = want.select(*[F.col(k).alias(k) for k in keys]).distinct()  # a block goes to the groups of queries that visit it, and to no other
        return held.join(visited, ["ann", "block"]).groupBy(*keys).cogroup(want.groupBy(*keys)).applyInArrow(meet, "query_id long, id long, score long, ann int")

    schema = "id long, v array<bigint>, grp int, ann int, block int"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    start = stored(asked.mapInArrow(lambda it: visits(it, True), schema), "topk-start")
    one = stored(run(start), "topk-one")
    floors = one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    state = asked.join(floors, asked["id"] == floors["query_id"], "left").join(start.groupBy("id").agg(F.collect_set("ann").alias("seen")), "id", "left")
    state = state.select("id", "v", "grp", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.coalesce("seen", F.array().cast("array<int>")).alias("seen"))
    two = run(stored(state.mapInArrow(lambda it: visits(it, False), schema), "topk-more"))
    ranked = one.unionByName(two).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = stored(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"), "topk-result")
    dropped(every, index, start, one)
    released(spark)
    return out

