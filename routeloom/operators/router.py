"""Capability matrix, role assignment, calibration and routing."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..settings import DEFAULT_SEED, EMBEDDING_MODEL, MIN_CLUSTER_WARN, N_CLUSTERS, ROLES, UNDERSIZED
from .cluster import SphericalKMeans


def role_table(spark: SparkSession) -> DataFrame:
    """(role, role_ord)."""
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(r) for r in ROLES])).alias("role_ord", "role")).select("role", "role_ord")


def clusters_of(spark: SparkSession, k: int) -> DataFrame:
    return spark.range(k).select(F.col("id").cast("int").alias("cluster"))


def sizes(assigned: DataFrame, k: int) -> DataFrame:
    """(cluster, size) for every cluster, empty ones too."""
    n = assigned.groupBy("cluster").agg(F.count("*").alias("size"))
    return clusters_of(assigned.sparkSession, k).join(n, "cluster", "left").select("cluster", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def category_counts(assigned: DataFrame) -> DataFrame:
    """(cluster, category, n)."""
    return assigned.groupBy("cluster", F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


def capability(scored: DataFrame, k: int) -> DataFrame:
    """(cluster, role, mean_score) for all clusters and roles from (cluster, role, score); 0 where there is none."""
    spark = scored.sparkSession
    every = clusters_of(spark, k).crossJoin(F.broadcast(role_table(spark)))  # k rows times three roles
    mean = scored.groupBy("cluster", "role").agg(F.avg("score").alias("mean_score"))
    return every.join(mean, ["cluster", "role"], "left").select("cluster", "role", "role_ord", F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"))


def assignment(matrix: DataFrame) -> DataFrame:
    """(cluster, role): general unless a specialist is strictly better; of two the better, of equal ones math."""
    p = matrix.groupBy("cluster").pivot("role", ROLES).agg(F.first("mean_score"))
    g, m, c = (F.col(r) for r in ROLES)
    role = F.when((c > g) & (c > m), "code").when(m > g, "math").when(c > g, "code").otherwise("general")
    return p.select("cluster", role.alias("role"))


def undersized(size: DataFrame, least: int) -> DataFrame:
    """(cluster, message) of clusters with too few items."""
    return size.where(F.col("size") < least).select("cluster", F.format_string(UNDERSIZED.format(least=least), "cluster", "size").alias("message"))


def duplicate_ids(items: DataFrame) -> DataFrame:
    return items.groupBy(F.col("id").cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1")


@dataclass
class Router:
    """Embeds questions, clusters them, learns which role handles which cluster, and routes."""

    embed: Callable[[DataFrame, str, str], DataFrame] = vectors.hash_embed
    embedding_name: str = EMBEDDING_MODEL
    k: int = N_CLUSTERS
    seed: int = DEFAULT_SEED
    centroids: list[list[float]] | None = None
    matrix: dict[int, dict[str, float]] | None = None
    roles: dict[int, str] | None = None

    def calibrate(self, items: DataFrame, scores: Callable[[DataFrame], DataFrame] | DataFrame, min_cluster_warn: int = MIN_CLUSTER_WARN) -> dict:
        """Learns from items (ord, id, question, category) and their scores (id, role, score), each item once a role.

        `scores` is that table, or makes it from items x roles.  Returns the calibration summary.
        """
        n = items.count()
        if n < self.k:
            raise ValueError(f"at least {self.k} items are needed")
        twice = duplicate_ids(items).head()
        if twice:
            raise ValueError(f"Duplicate item id: {twice['id']!r}")
        spark = items.sparkSession
        v = self.embed(items, "ord", "question").persist()
        model = SphericalKMeans(self.k, self.seed).fit(v)
        placed = items.join(v.select("ord", model.predict(F.col("v")).alias("cluster")), "ord").persist()
        table = scores if isinstance(scores, DataFrame) else scores(items.crossJoin(F.broadcast(role_table(spark))))
        table = table.select(F.col("id").cast("string").alias("id"), "role", F.col("score").cast("double").alias("score")).persist()
        both = placed.select(F.col("id").cast("string").alias("id"), "cluster").join(table, "id")
        matrix = capability(both, self.k).persist()
        self.centroids = model.centroids
        self.matrix = {c: {} for c in range(self.k)}
        for r in matrix.orderBy("cluster", "role_ord").collect():
            self.matrix[r["cluster"]][r["role"]] = r["mean_score"]
        self.roles = {r["cluster"]: r["role"] for r in assignment(matrix).orderBy("cluster").collect()}
        size = sizes(placed, self.k)
        told = [r["message"] for r in undersized(size, min_cluster_warn).orderBy("cluster").collect()]
        for message in told:
            warnings.warn(message, UserWarning, stacklevel=2)
        counts: dict[int, dict[str, int]] = {c: {} for c in range(self.k)}
        for r in category_counts(placed).orderBy("cluster", "category").collect():
            counts[r["cluster"]][r["category"]] = r["n"]
        item_scores: dict[str, dict[str, float]] = {}
        for r in table.join(items.select(F.col("id").cast("string").alias("id"), "ord"), "id").orderBy("ord", "role").toLocalIterator():
            item_scores.setdefault(r["id"], {})[r["role"]] = r["score"]
        out = {"n_items": n, "cluster_sizes": [r["size"] for r in size.orderBy("cluster").collect()], "capability_matrix": self.matrix, "assignment": self.roles, "cluster_category_counts": counts, "item_scores": item_scores, "warnings": told}
        for d in (v, placed, table, matrix):
            d.unpersist()
        return out

    def route_vectors(self, v: Column) -> tuple[Column, Column]:
        """(cluster, role) of a vector column."""
        if self.centroids is None or self.roles is None:
            raise RuntimeError("the router is not calibrated")
        cluster = vectors.nearest(vectors.unit(v), self.centroids)
        return cluster, F.element_at(F.array(*[F.lit(self.roles[c]) for c in range(self.k)]), cluster + 1)

    def route(self, items: DataFrame, key: str = "ord", question: str = "question") -> DataFrame:
        """items with `cluster` and `routed`."""
        if self.centroids is None:
            raise RuntimeError("the router is not calibrated")
        cluster, role = self.route_vectors(F.col("v"))
        return items.join(self.embed(items, key, question).select(key, cluster.alias("cluster"), role.alias("routed")), key)
