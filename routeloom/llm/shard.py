"""Operator 10 [native]: sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `nodes` points of a ring; a key - the text, so that equal texts go together - belongs to the arc that
ends at the next point clockwise.  A shard takes no more than its bound; keys beyond it continue clockwise to the next
point whose shard has room.  The bounds are floor(rows / shards), and one more for the first rows % shards of the shards
in ring order, so that counts are at most one apart (law `rows`).  A group of equal texts stands on one shard but where
a bound cuts it, as it must any group larger than that.

Points lie on a grid of FINE steps.  Rows are counted by step (at most FINE numbers, however large the table) and, in
steps of more than SHARE rows, by random shares of them, so that the rows of one text are no single task.  A row's rank in
its arc is its place in its share after the counts of the shares before; the counts of the arcs give each arc its segments
(shard, from, to, first slot).  The plan of the segments is made on the driver from the shards * nodes counts of the arcs.

Rows are numbered once and written down, so that every step sees the same numbers and equal rows are told apart.  Null
and repeated ids are rows as any other; a null text is an empty one, has size 16 and the checksum of no bytes; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes that every row weighs besides its text.
ROW_BYTES = 16
#: Steps of the ring.
FINE = 1 << 16
#: Rows of a step that are ranked together.
SHARE = 50_000


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(step, shard) of the ring's points clockwise; of two points on one step the smaller shard's stands."""
    at: dict[int, int] = {}
    for s in range(shards):
        for k in range(nodes):
            at.setdefault(int.from_bytes(hashlib.md5(f"{s}/{k}".encode()).digest()[:4], "big") * FINE >> 32, s)
    return sorted(at.items())


def segments(counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[dict]:
    """Keys of each arc by rank: first to the arc's own shard, then what it can't take clockwise to shards with room."""
    total, order = sum(counts.values()), list(dict.fromkeys(s for _, s in points))
    order += [s for s in range(shards) if s not in order]
    room = {s: total // shards + (i < total % shards) for i, s in enumerate(order)}
    used = dict.fromkeys(order, 0)
    out, over = [], []

    def put(arc: int, at: int, n: int, shard: int) -> int:
        k = min(n, room[shard])
        if k:
            out.append({"arc": arc, "lo": at, "hi": at + k, "shard": shard, "slot0": used[shard]})
            room[shard] -= k
            used[shard] += k
        return k

    for arc, (_, shard) in enumerate(points):
        if (k := put(arc, 0, n := counts.get(arc, 0), shard)) < n:
            over.append((arc, k, n))
    clockwise = [[s for _, s in points], order]
    for arc, at, n in over:
        for s in [*clockwise[0][arc + 1 :], *clockwise[0][: arc + 1], *clockwise[1]]:
            if at == n:
                break
            at += put(arc, at, n - at, s)
    return out


def table_of(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table from a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def assign(docs: DataFrame, shards: int = 40, nodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int) for every row."""
    spark = docs.sparkSession
    points = ring(shards, nodes)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    step = F.floor(h * F.lit(FINE) / F.lit(1 << 32)).cast("int")
    rows = stored(docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), step.alias("step"), F.monotonically_increasing_id().alias("n")), "shard-rows")

    # an arc's steps: after the point before it, up to its own; the last steps of the ring belong to the first point
    arcs = [{"arc": i, "a": points[i - 1][0] + 1 if i else 0, "b": p} for i, (p, _) in enumerate(points)]
    arcs += [{"arc": 0, "a": points[-1][0] + 1, "b": FINE - 1}] if points[-1][0] < FINE - 1 else []
    steps = table_of(spark, arcs, "arc int, a int, b int").select("arc", F.explode(F.sequence("a", "b")).alias("step"))
    counts = stored(rows.groupBy("step").count().join(F.broadcast(steps), "step"), "shard-counts")  # at most FINE rows
    by_arc = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("count").alias("n")).collect()}
    plan = table_of(spark, segments(by_arc, points, shards), "arc int, lo bigint, hi bigint, shard int, slot0 bigint")

    shares = counts.select("step", "arc", F.ceil(F.col("count") / F.lit(SHARE)).alias("shares"))
    dealt = rows.join(F.broadcast(shares), "step").withColumn("share", F.pmod(F.xxhash64("n"), F.col("shares"))).drop("shares")
    sizes = dealt.groupBy("arc", "step", "share").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("arc").orderBy("step", "share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("step", "share", before.alias("base"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("step", "share").orderBy("text_crc32", "size", "id", "n")) - 1)
    placed = ranked.join(bases, ["step", "share"]).withColumn("r", F.col("r") + F.col("base"))
    placed = placed.join(F.broadcast(plan), (placed["arc"] == plan["arc"]) & (placed["r"] >= plan["lo"]) & (placed["r"] < plan["hi"]))
    out = placed.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot0") + F.col("r") - F.col("lo")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    return out
