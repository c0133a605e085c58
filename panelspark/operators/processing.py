"""Cross-sectional processing in long form: every factor and date in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from ..functions.stats import safe_corr
from ..functions.windows import average_rank, global_average_ranks

MAD_SCALE = 1.4826


def long_form(df: DataFrame, factors: list[str], keep: list[str]) -> DataFrame:
    """keep, factor, value: one row for each factor."""
    pairs = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("value")) for f in factors))
    return df.select(*keep, F.explode(pairs).alias("__p")).select(*keep, "__p.factor", "__p.value")


def wide_form(df: DataFrame, factors: list[str], keep: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keep).pivot("factor", factors).agg(F.first(value))


def winsorize_mad(df: DataFrame, value: str = "value", keys: list[str] | None = None, n: float = 3.0, name: str = "winsorized") -> DataFrame:
    """df with values clipped to median -+ n * 1.4826 * MAD within keys, and clipped (whether the row was)."""
    keys = keys or ["trade_date", "factor"]
    w, half = Window.partitionBy(*keys), F.lit(0.5)
    rows = df.withColumn("__m", F.percentile(value, half).over(w))
    rows = rows.withColumn("__d", F.percentile(F.abs(F.col(value) - F.col("__m")), half).over(w))  # the same partitioning
    lo, hi = (F.col("__m") + s * n * MAD_SCALE * F.col("__d") for s in (-1, 1))
    x = F.when(F.coalesce(F.col("__d"), F.lit(0.0)) > 0, F.greatest(F.least(F.col(value), hi), lo)).otherwise(F.col(value))
    x = F.when(F.col(value).isNotNull(), x)
    moved = F.abs(x - F.col(value)) > 1e-8 + 1e-5 * F.abs(F.col(value))
    return rows.withColumn(name, x).withColumn("clipped", F.coalesce(moved, F.lit(False))).drop("__m", "__d")


def zscore(value: str | Column, keys: list[str]) -> Column:
    """By population deviation within keys; no spread gives NULL."""
    x = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*keys)
    spread = F.stddev_pop(x).over(w)
    return F.when(spread > 1e-12 * (1 + F.abs(F.avg(x).over(w))), (x - F.avg(x).over(w)) / spread)


def residual(df: DataFrame, value: str, size: str, industry: str, keys: list[str], by_industry: Column, by_size: Column, name: str) -> DataFrame:
    """df with the residual of value within keys; by_industry and by_size say for each row's group what it is regressed on.

    By Frisch, Waugh and Lovell: demean value and size within industry, regress
    one on the other. No matrix is built, groups of all kinds run in one plan,
    and every window keeps to the partitioning by keys.
    """
    ok = F.col(value).isNotNull() & (~by_industry | F.col(industry).isNotNull()) & (~by_size | F.col(size).isNotNull())
    rows = df.withColumn("__y", F.when(ok, F.col(value))).withColumn("__s", F.when(ok & by_size, F.col(size))).withColumn("__c", F.when(by_industry, F.col(industry)))
    full, cell = Window.partitionBy(*keys), Window.partitionBy(*keys, "__c")
    rows = rows.withColumn("__n", F.count("__y").over(full)).withColumn("__y", F.col("__y") - F.avg("__y").over(cell)).withColumn("__s", F.col("__s") - F.avg("__s").over(cell))
    sy, ss = F.sum(F.col("__s") * F.col("__y")).over(full), F.sum(F.col("__s") * F.col("__s")).over(full)
    rows = rows.withColumn("__b", F.when(ss > 1e-12, sy / ss).otherwise(0.0))
    left = F.when(F.col("__n") >= 3, F.col("__y") - F.col("__b") * F.coalesce("__s", F.lit(0.0)))
    return rows.withColumn(name, F.when(by_industry | by_size, left).otherwise(F.col(value))).drop("__y", "__s", "__c", "__n", "__b")


def neutralize(df: DataFrame, value: str = "value", size: str = "size", industry: str = "industry_code", keys: list[str] | None = None, mode: str = "industry_size", name: str = "neutral") -> DataFrame:
    """Residual of value on [1, z(size), industry dummies] within keys, over complete rows (three at least); mode none keeps the value."""
    return residual(df, value, size, industry, keys or ["trade_date", "factor"], F.lit("industry" in mode), F.lit("size" in mode), name)


def step_summary(df: DataFrame, steps: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, step, n, mean, std, min, q25, median, q75, max and clipped rows of each processing step."""
    keys = keys or ["trade_date", "factor"]
    long = df.select(*keys, "clipped", F.explode(F.array(*(F.struct(F.lit(s).alias("step"), F.col(s).alias("x")) for s in steps))).alias("p")).select(*keys, "clipped", "p.step", "p.x")
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = long.groupBy(*keys, "step").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), q.alias("q"), F.max("x").alias("max"), F.count_if(F.col("clipped") & (F.col("step") != "raw")).alias("clipped_count"))
    return g.select(*keys, "step", "n", "mean", "std", "min", *(F.col("q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75"))), "max", "clipped_count")


def process(df: DataFrame, factors: list[str], modes: dict[str, str] | None = None, n: float = 3.0, size: str = "size", industry: str = "industry_code") -> DataFrame:
    """(trade_date, ts_code, factor): raw, winsorized, neutral, standardized, clipped of all factors at once."""
    kind = {f: (modes or {}).get(f, "industry" if f == "size" else "industry_size") for f in factors}
    slim = df.select("trade_date", "ts_code", F.col(industry).alias("__industry"), F.col(size).cast("double").alias("__size"), *(f for f in factors))
    rows = long_form(slim, factors, ["trade_date", "ts_code", "__industry", "__size"]).withColumnRenamed("value", "raw")
    of = lambda part: F.col("factor").isin(*(f for f in factors if part in kind[f])) if any(part in k for k in kind.values()) else F.lit(False)
    rows = winsorize_mad(rows, "raw", n=n)
    rows = residual(rows, "winsorized", "__size", "__industry", ["trade_date", "factor"], of("industry"), of("size"), "neutral")
    rows = rows.withColumn("standardized", zscore("neutral", ["trade_date", "factor"]))
    return rows.select("trade_date", "ts_code", F.col("__industry").alias(industry), "factor", "raw", "winsorized", "clipped", "neutral", "standardized")


def mask_low_coverage(df: DataFrame, factors: list[str], least: float = 0.3) -> DataFrame:
    """Factors NULL on dates where too few rows have them."""
    w = Window.partitionBy("trade_date")
    return df.withColumns({f: F.when(F.count(f).over(w) / F.count(F.lit(1)).over(w) >= least, F.col(f)) for f in factors})


def factor_correlation(df: DataFrame, factors: list[str], method: str = "spearman", per_date: bool = False) -> DataFrame:
    """(left, right, corr): ranks pooled over all dates and each factor's own rows, or within dates and averaged."""
    keys = ["trade_date"] if per_date else []
    rows = df.select("trade_date", "ts_code", *factors)
    if method == "spearman":
        rows = rows.select("trade_date", "ts_code", *(average_rank(f, keys).alias(f) for f in factors)) if per_date else global_average_ranks(rows, factors, ["trade_date", "ts_code"])
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i:]]
    g = rows.groupBy(*keys).agg(*(safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    if per_date:
        g = g.agg(*(F.avg(f"`{a}|{b}`").alias(f"{a}|{b}") for a, b in pairs))
    return g.select(F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs))).alias("p")).select("p.*")


def coverage(df: DataFrame, factors: list[str], by: list[str]) -> DataFrame:
    """by, factor, rows, present and coverage; NULL groups are groups."""
    g = df.groupBy(*by).agg(F.count("*").alias("rows"), *(F.count(f).alias(f) for f in factors))
    long = g.select(*by, "rows", F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("present")) for f in factors))).alias("p"))
    return long.select(*by, "p.factor", "rows", "p.present", safe_divide("p.present", "rows").alias("coverage"))
