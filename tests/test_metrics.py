import pytest
from pyspark.sql import functions as F

from routeloom.functions import stats
from routeloom.operators import metrics

ROWS = [(1, "math", "math", 0.0, 1.0, 0.0), (2, "general", "general", 1.0, 0.0, 0.0), (3, "code", "code", 1.0, 0.0, 0.0)]


def records(spark, rows=ROWS):
    d = spark.createDataFrame(rows, "ord long, category string, routed string, g double, m double, c double")
    return d.select("ord", "category", "routed", F.create_map(F.lit("general"), "g", F.lit("math"), "m", F.lit("code"), "c").alias("scores"), F.col("g").alias("baseline"))


def test_mcnemar_of_large_counts(spark):
    """The sum from the largest term against the plain one, at counts on both sides of the border."""
    from math import exp, lgamma, log

    def plain(b, c):
        n, m = b + c, min(b, c)
        return min(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * log(2)) for i in range(m + 1)))

    rows = [(20_000, 20_400), (20_001, 20_400), (30_000, 30_500), (50_000, 50_000), (10**9, 10**9 + 100_000)]
    got = [r[0] for r in spark.createDataFrame(rows, "b long, c long").select(stats.mcnemar_p(F.col("b"), F.col("c"))).collect()]
    for (b, c), p in zip(rows[:4], got, strict=False):
        assert p == pytest.approx(plain(b, c), rel=1e-6)
    assert got[4] == pytest.approx(0.02535, rel=1e-2)  # the normal limit


def test_wilson(spark):
    d = spark.createDataFrame([(8, 10), (0, 0), (0, 10), (10, 10), (0, 9), (6, 9)], "k long, n long")
    got = [(r[0].lo, r[0].hi) for r in d.select(stats.wilson(F.col("k"), F.col("n"))).collect()]
    assert 0.48 < got[0][0] < 0.50 and 0.93 < got[0][1] < 0.95
    assert got[1] == (0.0, 1.0) and got[2][0] == 0.0 and got[3][1] == 1.0
    assert got[4][1] == pytest.approx(0.29915275) and got[5] == pytest.approx((0.35419735, 0.87941840))
    for k in (-1, 11):
        with pytest.raises(Exception, match="0..total"):
            spark.createDataFrame([(k, 10)], "k long, n long").select(stats.wilson(F.col("k"), F.col("n"))).collect()


def test_mcnemar(spark):
    d = spark.createDataFrame([(0, 0), (5, 5), (0, 10), (3, 9), (700, 700), (100, 1400)], "b long, c long")
    got = [r[0] for r in d.select(stats.mcnemar_p(F.col("b"), F.col("c"))).collect()]
    assert got[:4] == pytest.approx([1.0, 1.0, 0.001953125, 0.14599609375])
    assert got[4] == 1.0 and 0 < got[5] < 1e-200


def test_compute(spark):
    m = metrics.compute(records(spark))
    assert (m["n"], m["routed"]["k"], m["baseline"]["k"], m["oracle"]["k"], m["delta"]) == (3, 2, 2, 3, 0.0)
    assert m["mcnemar"] == {"b": 1, "c": 1, "p": 1.0} and m["routing_counts"] == {"general": 1, "math": 1, "code": 1}
    assert list(m["per_category"]) == ["math", "general", "code"] and m["per_category"]["math"] == {"n": 1, "routed_acc": 1.0, "baseline_acc": 0.0}


def test_errors(spark):
    with pytest.raises(ValueError, match="empty"):
        metrics.compute(records(spark).where("false"))
    with pytest.raises(ValueError, match="record 1"):
        metrics.compute(records(spark, [(1, "math", "art", 0.0, 1.0, 0.0)]))
    with pytest.raises(ValueError, match="record 1"):
        metrics.compute(records(spark, ROWS[:1]).withColumn("baseline", F.lit(1.0)))
