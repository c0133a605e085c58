"""Statistics that stay defined: correlations of constants, HAC means, multiple tests, normal tail and quantile."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import col


def safe_corr(x, y) -> Column:
    """Pearson correlation of complete pairs as an aggregate; NULL if a side is constant."""
    x, y = col(x).cast("double"), col(y).cast("double")
    ok = x.isNotNull() & y.isNotNull()
    x, y = F.when(ok, x), F.when(ok, y)
    # corr() of a constant raises, so a constant side becomes NULL beforehand by its own spread
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    # regr_sxy and friends are plain sums and never divide
    return F.when(varied, F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))))


def normal_tail_two_sided(t) -> Column:
    """erfc(|t| / sqrt 2) by a continued rational approximation (error below 1.2e-7)."""
    z = F.abs(col(t)) / math.sqrt(2.0)
    u = 1.0 / (1.0 + 0.5 * z)
    # Coefficients of the Chebyshev fit to erfc.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly: Column = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = F.lit(k) + u * poly
    return u * F.exp(-z * z + poly)


def chi2_tail_column(x, k: int) -> Column:
    """P(chi-square with k degrees > x) in closed form: a finite sum, and for odd k the normal tail; null stays null."""
    x = F.greatest(col(x), F.lit(0.0))
    half = x / 2.0
    start = 0.5 if k % 2 else 0.0
    terms = [half ** (start + j) / math.gamma(start + j + 1) for j in range(k // 2)] if k > 1 else []
    rest = F.exp(-half) * sum(terms, F.lit(0.0))
    return F.least(normal_tail_two_sided(F.sqrt(x)) + rest if k % 2 else rest, F.lit(1.0))


def normal_cdf(x: float) -> float:
    return NormalDist().cdf(x)


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def newey_west(df: DataFrame, value: str, keys: list[str], order: str, lags: int | None = None) -> DataFrame:
    """keys, n, mean, naive_t, nw_se, nw_t, nw_p: mean test with Bartlett weights over `lags` (bounded by n - 1; None: 3).

    One window for the order, then one grouped sum per lag; no series is collected.
    """
    top = 3 if lags is None else max(lags, 0)
    rows = df.where(F.col(value).isNotNull()).select(*keys, order, F.col(value).cast("double").alias("x"))
    both = Window.partitionBy(*keys)
    rows = rows.withColumn("m", F.avg("x").over(both)).withColumn("n", F.count("*").over(both)).withColumn("e", F.col("x") - F.col("m"))
    w = both.orderBy(order)
    rows = rows.select("*", *(F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, top + 1)))
    g = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.first("m").alias("mean"), F.stddev_samp("x").alias("sd"), F.sum(F.col("e") * F.col("e")).alias("g0"), *(F.sum(F.col("e") * F.col(f"e{k}")).alias(f"g{k}") for k in range(1, top + 1)))
    used = F.least(F.lit(top), F.col("n") - 1)
    lrv = F.col("g0") / F.col("n")
    for k in range(1, top + 1):
        lrv = lrv + F.when(used >= k, 2.0 * (1.0 - k / (used + 1.0)) * F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / F.col("n")).otherwise(0.0)
    se = F.sqrt(F.greatest(lrv, F.lit(0.0)) / F.col("n"))
    out = g.withColumn("nw_se", se).withColumn("nw_t", F.try_divide(F.col("mean"), F.when(F.col("nw_se") > 1e-15, F.col("nw_se"))))
    naive = F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n"))
    return out.select(*keys, "n", "mean", naive.alias("naive_t"), "nw_se", "nw_t", normal_tail_two_sided("nw_t").alias("nw_p"))


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str] | None = None, name: str = "q_value") -> DataFrame:
    """df with q-values within keys; NULL p-values get NULL and don't count."""
    keys = keys or []
    some = F.col(p).isNotNull()
    w = Window.partitionBy(*keys, some)
    raw = F.col(p) * F.count(p).over(w) / F.row_number().over(w.orderBy(p))
    out = df.withColumn("__raw", F.when(some, raw))
    down = Window.partitionBy(*keys, some).orderBy(F.col(p).desc(), F.col("__raw").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(name, F.when(some, F.least(F.min("__raw").over(down), F.lit(1.0)))).drop("__raw")


def sample_skew(x) -> Column:
    """Bias-corrected skewness as an aggregate."""
    n = F.count(col(x)).cast("double")
    return F.when(n > 2, F.skewness(col(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x) -> Column:
    """Bias-corrected kurtosis (3 for a normal) as an aggregate."""
    n = F.count(col(x)).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(x)) + 6) + 3)
