"""Metrics of routed records: (ord, category, routed, scores map<string, double>, baseline)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import correct, mcnemar_p, proportion, row_oracle
from ..settings import ROLES


def violations(records: DataFrame) -> DataFrame:
    """Records whose role is unknown or whose baseline isn't the general role's score."""
    ok = F.col("routed").isin(ROLES) & (F.col("baseline") == F.try_element_at("scores", F.lit("general"))) & F.try_element_at("scores", F.col("routed")).isNotNull()
    return records.where(~F.coalesce(ok, F.lit(False)))


def flags(records: DataFrame) -> DataFrame:
    """Records with routed_ok, baseline_ok, oracle_ok and ok_<role>."""
    return records.withColumns(
        {
            "category": F.coalesce("category", F.lit("unknown")),
            "routed_ok": F.coalesce(correct(F.try_element_at("scores", F.col("routed"))), F.lit(False)),
            "baseline_ok": correct(F.col("baseline")),
            "oracle_ok": row_oracle(F.col("scores")),
            **{f"ok_{r}": F.coalesce(correct(F.try_element_at("scores", F.lit(r))), F.lit(False)) for r in ROLES},
        }
    )


def overall(records: DataFrame) -> DataFrame:
    """One row: n, routed, baseline, always_<role> (proportions), oracle (k, n, acc), delta, mcnemar, routing_counts."""
    a = flags(records).agg(
        F.count("*").alias("n"),
        F.count_if("routed_ok").alias("rk"),
        F.count_if("baseline_ok").alias("bk"),
        F.count_if("oracle_ok").alias("ok"),
        F.count_if(F.col("routed_ok") & ~F.col("baseline_ok")).alias("b"),
        F.count_if(~F.col("routed_ok") & F.col("baseline_ok")).alias("c"),
        *[F.count_if(f"ok_{r}").alias(f"k_{r}") for r in ROLES],
        *[F.count_if(F.col("routed") == r).alias(f"to_{r}") for r in ROLES],
    )
    n = F.col("n")
    return a.select(
        "n",
        proportion(F.col("rk"), n).alias("routed"),
        proportion(F.col("bk"), n).alias("baseline"),
        *[proportion(F.col(f"k_{r}"), n).alias(f"always_{r}") for r in ROLES],
        F.struct(F.col("ok").alias("k"), n.alias("n"), F.try_divide(F.col("ok").cast("double"), n).alias("acc")).alias("oracle"),
        F.try_divide((F.col("rk") - F.col("bk")).cast("double"), n).alias("delta"),
        F.struct("b", "c", mcnemar_p(F.col("b"), F.col("c")).alias("p")).alias("mcnemar"),
        F.struct(*[F.col(f"to_{r}").alias(r) for r in ROLES]).alias("routing_counts"),
    )


def per_category(records: DataFrame) -> DataFrame:
    """(category, n, routed_acc, baseline_acc)."""
    return flags(records).groupBy("category").agg(F.count("*").alias("n"), F.avg(F.col("routed_ok").cast("double")).alias("routed_acc"), F.avg(F.col("baseline_ok").cast("double")).alias("baseline_acc"))


def compute(records: DataFrame) -> dict:
    """The nested metrics; an error for no records or bad ones."""
    if records.isEmpty():
        raise ValueError("records must not be empty")
    bad = violations(records).select("ord").head()
    if bad:
        raise ValueError(f"record {bad[0]}: unknown role, or a baseline that isn't the general score")
    m = overall(records).first().asDict(recursive=True)
    m["always"] = {r: m.pop(f"always_{r}") for r in ROLES}
    order = flags(records).groupBy("category").agg(F.min("ord").alias("o"))
    m["per_category"] = {r["category"]: {k: r[k] for k in ("n", "routed_acc", "baseline_acc")} for r in per_category(records).join(order, "category").orderBy("o").collect()}
    return m
