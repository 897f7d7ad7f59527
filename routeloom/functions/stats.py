"""Statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import ROLES


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(lo, hi): the Wilson interval, clamped to [0, 1]; (0, 1) for n = 0; an error for k outside 0..n."""
    k, n = k.cast("double"), n.cast("double")
    safe = F.when(n > 0, n)
    p, z2 = k / safe, z * z
    mid, half = p + z2 / (2 * safe), z * F.sqrt(p * (1 - p) / safe + z2 / (4 * safe * safe))
    low = F.greatest(F.lit(0.0), (mid - half) / (1 + z2 / safe))
    high = F.least(F.lit(1.0), (mid + half) / (1 + z2 / safe))
    bad = (k < 0) | (k > n) | (n < 0)
    lo = F.when(bad, F.raise_error(F.lit("successes must lie in 0..total")).cast("double")).otherwise(F.coalesce(low, F.lit(0.0)))
    return F.struct(lo.alias("lo"), F.coalesce(high, F.lit(1.0)).alias("hi"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series, for arguments above some thousands."""
    return (x - 0.5) * F.log(x) - x + 0.5 * F.log(F.lit(2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x * x * x)


#: Smaller discordant counts up to this one are summed from their first term.
FEW = 20_000


def mcnemar_p(b: Column, c: Column) -> Column:
    """The exact two-sided McNemar p-value: twice the binomial tail up to the smaller count, summed in log space.

    Beyond FEW terms the sum runs downward from the largest one, which Stirling's series gives, over 9 * sqrt(n) terms;
    what is left out is below e**-160 of it.
    """
    n, m = (b + c).cast("double"), F.least(b, c).cast("long")
    first = n * F.log(F.lit(0.5))

    def up(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i)
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    ids = F.when((m > 0) & (m <= FEW), F.sequence(F.lit(1).cast("long"), F.least(m, F.lit(FEW).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    few = F.aggregate(ids, F.struct(first.alias("t"), F.exp(first).alias("s")), up, lambda a: a["s"])
    k = m.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + first

    def down(a: Column, i: Column) -> Column:
        t = a["t"] * i / (n - i + 1)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    reach = F.when(m > FEW, F.sequence(m, F.greatest(F.lit(1).cast("long"), m - (9 * F.sqrt(n)).cast("long")), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    many = F.exp(top) * F.aggregate(reach, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), down, lambda a: a["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.when(m <= FEW, few).otherwise(many)))


def proportion(k: Column, n: Column) -> Column:
    """struct(k, n, acc, ci_lo, ci_hi)."""
    ci = wilson(k, n)
    return F.struct(k.cast("long").alias("k"), n.cast("long").alias("n"), F.try_divide(k.cast("double"), n.cast("double")).alias("acc"), ci["lo"].alias("ci_lo"), ci["hi"].alias("ci_hi"))


def correct(score: Column) -> Column:
    """Whether a score is a full one."""
    return score == F.lit(1.0)


def row_oracle(scores: Column) -> Column:
    """Whether any role has a full score; a missing role counts as 0."""
    return F.greatest(*[F.coalesce(F.try_element_at(scores, F.lit(r)), F.lit(0.0)) for r in ROLES]) == 1.0
