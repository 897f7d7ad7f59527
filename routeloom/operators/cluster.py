"""Spherical K-means over a DataFrame of (ord long, v array<double>).

All restarts go through one job an iteration: partitions send sums of their members by (restart, cluster), and the
point farthest from each centroid for clusters that end up empty.  The driver holds restarts * k * d numbers, and a few
for each partition while starts are drawn.  Draws follow numpy's RandomState by the row order `ord`.  All sums are of
integers (units of 2 ** -40), which no order changes, so a seed gives the same result at any partitioning and size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..settings import DEFAULT_SEED, N_CLUSTERS

RESTARTS, MAX_ITER, TOLERANCE = 10, 100, 1e-6
#: Rows of a partition, and units that sums are counted in.
PART_ROWS = 50_000
UNITS = float(1 << 40)


def in_units(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNITS).astype(np.int64)


@dataclass
class SphericalKMeans:
    k: int = N_CLUSTERS
    seed: int = DEFAULT_SEED
    restarts: int = RESTARTS
    max_iter: int = MAX_ITER
    tolerance: float = TOLERANCE
    centroids: list[list[float]] | None = field(default=None)

    def fit(self, df: DataFrame, starts: np.ndarray | None = None) -> SphericalKMeans:
        """Fits on all rows; an error for fewer rows than clusters, unequal lengths, or a zero or undefined norm.

        `starts` (restarts, k, d), unit vectors, stand in for drawn ones.
        """
        shape = df.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
        if shape["n"] < self.k:
            raise ValueError(f"{shape['n']} rows are fewer than {self.k} clusters")
        if shape["lo"] != shape["hi"] or shape["lo"] < 1:
            raise ValueError("vectors must have one length")
        parts = -(-shape["n"] // PART_ROWS)
        x = df.select("ord", vectors.unit(F.col("v")).alias("v")).repartitionByRange(parts, "ord").sortWithinPartitions("ord").withColumn("part", F.spark_partition_id()).persist()
        try:
            starts = self._starts(x, shape["n"]) if starts is None else np.array(starts, np.float64)
            if starts.shape != (self.restarts, self.k, shape["lo"]):
                raise ValueError("starts must have the shape (restarts, clusters, length of a vector)")
            best, top = None, -np.inf
            final, total = self._iterate(x, starts)
            for r in range(self.restarts):
                if total[r] > top:
                    best, top = final[r], total[r]
            self.centroids = best.tolist()
        finally:
            x.unpersist()
        return self

    def predict(self, v: Column) -> Column:
        """The index of the nearest centroid; an error for a zero norm."""
        if self.centroids is None:
            raise RuntimeError("not fitted")
        return vectors.nearest(vectors.unit(v), self.centroids)

    def predict_one(self, x: list[float] | np.ndarray) -> int:
        """The index of the centroid nearest to a single vector."""
        if self.centroids is None:
            raise RuntimeError("not fitted")
        v = np.asarray(x, np.float64)
        if v.ndim != 1:
            raise ValueError("one vector is wanted")
        if not np.linalg.norm(v) > 0:
            raise ValueError("zero-norm or NaN vector")
        return int((np.array(self.centroids) @ v).argmax())

    def _starts(self, x: DataFrame, n: int) -> np.ndarray:
        rngs = [np.random.RandomState(self.seed + r) for r in range(self.restarts)]
        first = [int(g.randint(0, n)) for g in rngs]
        rank = self._ranked(x)
        rows = self._by_rank(rank, first)
        chosen = [[rows[f]] for f in first]
        for _ in range(1, self.k):
            c = np.array(chosen)  # restarts, so far, d

            def weights(v: np.ndarray, c=c) -> np.ndarray:
                return np.stack([in_units(np.maximum(0.0, 1.0 - (v @ c[r].T).max(1)) ** 2) for r in range(len(c))], 1)

            def sums(batches: Iterator[pd.DataFrame], weights=weights) -> Iterator[pd.DataFrame]:
                total: dict[int, np.ndarray] = {}
                for b in batches:
                    for part, own in b.groupby("part"):
                        total[part] = total.get(part, 0) + weights(np.array(own["v"].tolist())).sum(0)
                yield pd.DataFrame({"part": list(total), "w": [w.tolist() for w in total.values()]})

            parts = sorted(rank.mapInPandas(sums, "part int, w array<long>").collect(), key=lambda p: p["part"])  # ranges of ord, in order
            before = [[0] * self.restarts]
            for p in parts:
                before.append([a + b for a, b in zip(before[-1], p["w"], strict=True)])
            found, wanted = {}, {}
            for r, g in enumerate(rngs):
                u = g.random_sample()
                if not before[-1][r]:  # all rows are starts already
                    found[r] = min(n - 1, int(u * n))
                    continue
                t = min(int(u * before[-1][r]), before[-1][r] - 1)
                i = next(i for i in range(len(parts)) if t < before[i + 1][r])
                wanted.setdefault(parts[i]["part"], []).append((r, t - before[i][r]))

            def locate(batches: Iterator[pd.DataFrame], wanted=wanted, weights=weights) -> Iterator[pd.DataFrame]:
                passed: dict[int, np.ndarray] = {}
                for b in batches:
                    for part, own in b.groupby("part"):  # rows of a part come in the order of ord
                        w = weights(np.array(own["v"].tolist()))
                        before = passed.get(part, np.zeros(w.shape[1], np.int64))
                        cum = before + np.cumsum(w, 0)
                        passed[part] = cum[-1]
                        here = [(r, int(own["rank"].iloc[int(np.searchsorted(cum[:, r], t, "right"))])) for r, t in wanted[part] if before[r] <= t < cum[-1, r]]
                        if here:
                            yield pd.DataFrame(here, columns=["r", "rank"])

            if wanted:
                found |= {x["r"]: x["rank"] for x in rank.where(F.col("part").isin(list(wanted))).mapInPandas(locate, "r int, rank long").collect()}
            rows = self._by_rank(rank, list(found.values()))
            for r in range(self.restarts):
                chosen[r].append(rows[found[r]])
        c = np.array(chosen)
        return c / np.linalg.norm(c, axis=2, keepdims=True)

    def _ranked(self, x: DataFrame) -> DataFrame:
        """Rows numbered from 0 in the order of ord (counts by partition, then a running number in each)."""
        counts = {r["part"]: r["n"] for r in x.groupBy("part").agg(F.count("*").alias("n")).collect()}
        base, at = {}, 0
        for p in sorted(counts):
            base[p], at = at, at + counts[p]
        offset = F.element_at(F.create_map(*[F.lit(y) for kv in base.items() for y in kv]), F.col("part"))
        return x.withColumn("rank", (offset + F.row_number().over(Window.partitionBy("part").orderBy("ord")) - 1).cast("long"))

    def _by_rank(self, rank: DataFrame, ranks: list[int]) -> dict[int, np.ndarray]:
        return {r["rank"]: np.array(r["v"]) for r in rank.where(F.col("rank").isin(sorted(set(ranks)))).select("rank", "v").collect()}

    def _iterate(self, x: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, live = self.k, list(range(self.restarts))
        for _ in range(self.max_iter):
            step = lloyd_partials(x, centroids[live])
            moved = []
            for j, r in enumerate(live):
                new = np.zeros_like(centroids[r])
                for c in range(k):
                    s, n, worst = step[j, c]
                    mean = s / n if n else s
                    size = np.linalg.norm(mean)
                    new[c] = mean / size if n and size > 0 else worst
                new /= np.linalg.norm(new, axis=1, keepdims=True)
                if np.linalg.norm(new - centroids[r], axis=1).max() >= self.tolerance:
                    moved.append(r)
                centroids[r] = new
            live = moved
            if not live:
                break
        return centroids, total_similarity(x, centroids)


def lloyd_partials(x: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, int, np.ndarray]]:
    """By (restart, cluster): the sum of the members, their number, and the row least similar to the old centroid."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v, o = np.array(b["v"].tolist()), b["ord"].to_numpy()
            out = []
            for r, c in enumerate(centroids):
                s = v @ c.T
                label = s.argmax(1)
                for j in range(len(c)):
                    m = label == j
                    w = np.lexsort((o, s[:, j]))[0]
                    out.append((r, j, in_units(v[m]).sum(0).tolist(), int(m.sum()), float(s[w, j]), int(o[w]), v[w].tolist()))
            yield pd.DataFrame(out, columns=["r", "j", "s", "n", "low", "at", "worst"])

    p = x.mapInPandas(partial, "r int, j int, s array<long>, n long, low double, at long, worst array<double>")
    length = F.max(F.size("s"))
    sums = p.select("r", "j", F.posexplode("s").alias("pos", "x")).groupBy("r", "j", "pos").agg((F.sum(F.col("x").cast("decimal(38,0)")).cast("double") / F.lit(UNITS)).alias("x")).groupBy("r", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z["x"]).alias("s"))
    rest = p.groupBy("r", "j").agg(F.sum("n").alias("n"), F.min_by("worst", F.struct("low", "at")).alias("worst"), length.alias("d"))
    return {(q["r"], q["j"]): (np.array(q["s"]), q["n"], np.array(q["worst"])) for q in sums.join(rest, ["r", "j"]).collect()}


def total_similarity(x: DataFrame, centroids: np.ndarray) -> list[float]:
    """By restart: the sum over rows of the similarity to the nearest centroid."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.array(b["v"].tolist())
            yield pd.DataFrame([(r, int(in_units((v @ c.T).max(1)).sum())) for r, c in enumerate(centroids)], columns=["r", "s"])

    got = {q["r"]: q["s"] for q in x.mapInPandas(partial, "r int, s long").groupBy("r").agg((F.sum(F.col("s").cast("decimal(38,0)")).cast("double") / F.lit(UNITS)).alias("s")).collect()}
    return [got[r] for r in range(len(centroids))]


def group_centroids(df: DataFrame, group: str) -> DataFrame:
    """(group, centroid): the unit vector of the mean of each group's unit vectors - one step of the algorithm."""
    x = df.select(group, F.posexplode(vectors.unit(F.col("v"))).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("x"))
    mean = x.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z["x"]).alias("m"))
    return mean.select(group, vectors.unit(F.col("m")).alias("centroid"))
