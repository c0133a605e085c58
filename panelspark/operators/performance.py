"""Performance, benchmark-relative measures, attribution and compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from ..functions.windows import drawdown, rolling

YEAR = 252


def returns_of(nav: DataFrame, value: str = "nav", date: str = "date", keys: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(keys or [])).orderBy(date)
    return nav.withColumn("ret", safe_divide(value, F.lag(value).over(w)) - 1)


def compounded(r: str = "ret") -> Column:
    """Product of 1 + r, less one, as an aggregate."""
    return F.product(1 + F.coalesce(F.col(r), F.lit(0.0))) - 1


def periodic_returns(df: DataFrame, unit: str, r: str = "ret", date: str = "date", keys: list[str] | None = None) -> DataFrame:
    """Compounded returns by month ('MM') or year ('YYYY')."""
    return df.groupBy(*(keys or []), F.trunc(date, unit).alias("period")).agg(compounded(r).alias("period_return"))


def monthly_matrix(df: DataFrame, r: str = "ret", date: str = "date") -> DataFrame:
    """A row a year, a column a month."""
    return df.groupBy(F.year(date).alias("year")).pivot("m", list(range(1, 13))).agg(compounded(r)) if "m" in df.columns else monthly_matrix(df.withColumn("m", F.month(date)), r, date)


def monthly_win_rate(df: DataFrame, r: str = "ret", date: str = "date", keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return periodic_returns(df, "MM", r, date, keys).groupBy(*keys).agg(F.avg((F.col("period_return") > 0).cast("double")).alias("monthly_win_rate"))


def performance(df: DataFrame, keys: list[str], nav: str = "nav", date: str = "date", rf: float = 0.0, per_year: int = YEAR, holdings: str | None = None) -> DataFrame:
    """Total and annual return, volatility, Sharpe, Sortino, drawdown, Calmar, win rate, days; from the first holding on if asked.

    total return is last / first - 1; years are rows / per_year, one period at least.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    rows = returns_of(df.select(*keys, date, nav, *([holdings] if holdings else [])), nav, date, keys)
    if holdings:
        rows = rows.withColumn("__a", F.max((F.col(holdings) > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__a = 1")
    rows = rows.withColumn("dd", drawdown(nav, w))
    short = F.when(F.col("ret").isNotNull(), F.least(F.col("ret") - rf / per_year, F.lit(0.0)))
    g = rows.groupBy(*keys).agg(
        F.min_by(nav, date).alias("first"), F.max_by(nav, date).alias("last"), F.count("*").alias("days"), F.stddev_samp("ret").alias("sd"), F.avg(short * short).alias("down"),
        F.min("dd").alias("max_drawdown"), F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double"))).alias("win_rate"), compounded("ret").alias("grown"),
    )
    years = F.greatest(F.col("days") / per_year, F.lit(1.0 / per_year))
    g = g.withColumn("total_return", safe_divide("last", "first") - 1).withColumn("annual_return", F.pow(F.greatest(F.col("total_return") + 1, F.lit(0.0)), 1 / years) - 1)
    g = g.withColumn("annual_vol", F.col("sd") * F.sqrt(F.lit(float(per_year))))
    return g.select(
        *keys, "total_return", "annual_return", "annual_vol", safe_divide(F.col("annual_return") - rf, "annual_vol").alias("sharpe"),
        safe_divide(F.col("annual_return") - rf, F.sqrt("down") * F.sqrt(F.lit(float(per_year)))).alias("sortino"), "max_drawdown", safe_divide("annual_return", F.abs("max_drawdown")).alias("calmar"), "win_rate", "days",
    )


def relative_performance(df: DataFrame, keys: list[str], r: str = "ret", b: str = "bench_ret", per_year: int = YEAR) -> DataFrame:
    """beta, annual alpha, tracking error and information ratio of aligned returns."""
    rows = df.where(F.col(r).isNotNull() & F.col(b).isNotNull()).withColumn("x", F.col(r) - F.col(b))
    g = rows.groupBy(*keys).agg(safe_divide(F.covar_samp(r, b), F.var_samp(b)).alias("beta"), F.avg(r).alias("mr"), F.avg(b).alias("mb"), F.avg("x").alias("mx"), F.stddev_samp("x").alias("sx"))
    te = F.col("sx") * F.sqrt(F.lit(float(per_year)))
    return g.select(*keys, "beta", ((F.col("mr") - F.col("beta") * F.col("mb")) * per_year).alias("alpha"), te.alias("tracking_error"), safe_divide(F.col("mx") * per_year, te).alias("information_ratio"))


def rolling_risk(df: DataFrame, keys: list[str], r: str = "ret", date: str = "date", n: int = 63, per_year: int = YEAR, least: int | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(date)
    vol = rolling(F.stddev_samp, r, n, least, w) * F.sqrt(F.lit(float(per_year)))
    return df.select(*keys, date, vol.alias("rolling_vol"), safe_divide(rolling(F.avg, r, n, least, w) * per_year, vol).alias("rolling_sharpe"))


def yearly_performance(df: DataFrame, keys: list[str], nav: str = "nav", date: str = "date", per_year: int = YEAR) -> DataFrame:
    rows = returns_of(df, nav, date, keys).withColumn("year", F.year(date))
    rows = rows.withColumn("dd", drawdown(nav, Window.partitionBy(*keys, "year").orderBy(date)))
    g = rows.groupBy(*keys, "year").agg(compounded("ret").alias("year_return"), F.stddev_samp("ret").alias("sd"), F.min("dd").alias("max_drawdown"), F.count("*").alias("days"))
    vol = F.col("sd") * F.sqrt(F.lit(float(per_year)))
    return g.select(*keys, "year", "year_return", vol.alias("annual_vol"), safe_divide("year_return", vol).alias("sharpe"), "max_drawdown", "days")


def exposure(weights: DataFrame, industry: DataFrame, weight: str = "weight") -> DataFrame:
    """Industry weights by date; assets without an industry under NULL."""
    return weights.join(industry, "ts_code", "left").groupBy("trade_date", "industry_code").agg(F.sum(weight).alias("exposure"))


def active_exposure(own: DataFrame, bench: DataFrame) -> DataFrame:
    """Full outer difference of industry weights, missing sides 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    b = bench.withColumnRenamed("exposure", "__b")
    return own.join(b, ["trade_date", "industry_code"], "full_outer").select("trade_date", "industry_code", z("exposure").alias("exposure"), z("__b").alias("bench_exposure"), (z("exposure") - z("__b")).alias("active"))


def contributions(weights: DataFrame, returns: DataFrame, weight: str = "weight", r: str = "ret") -> DataFrame:
    """weight * return of the same date."""
    return weights.join(returns.select("trade_date", "ts_code", r), ["trade_date", "ts_code"]).select("trade_date", "ts_code", weight, r, (F.col(weight) * F.col(r)).alias("contribution"))


def attribution(contrib: DataFrame, group: DataFrame, by: str) -> DataFrame:
    return contrib.join(group.select("ts_code", by), "ts_code", "left").groupBy(by).agg(F.sum("contribution").alias("contribution"), F.avg("weight").alias("mean_weight"), F.count("*").alias("rows"))


def top_contributors(contrib: DataFrame, n: int) -> DataFrame:
    """The n largest and the n smallest sums of contributions."""
    g = contrib.groupBy("ts_code").agg(F.sum("contribution").alias("contribution"))
    top = g.orderBy(F.col("contribution").desc(), "ts_code").limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(g.orderBy("contribution", "ts_code").limit(n).withColumn("side", F.lit("bottom")))


def cost_attribution(nav: DataFrame, gross: str = "gross_ret", cost: str = "cost_ret", net: str = "ret") -> DataFrame:
    """Gross, cost and net sums and compounded, with the residual that compounding leaves."""
    g = nav.agg(compounded(gross).alias("gross_return"), F.sum(cost).alias("cost_sum"), compounded(net).alias("net_return"))
    return g.withColumn("residual", F.col("gross_return") - F.col("cost_sum") - F.col("net_return"))


def compliance(positions: DataFrame, industry: DataFrame, *, max_weight: float, max_industry: float, min_holdings: int, max_cash: float) -> DataFrame:
    """(trade_date, rule, value, limit, passed): holding count, single name, industry and cash."""
    held = positions.where(F.col("weight") > 0)
    day = held.groupBy("trade_date").agg(F.count("*").alias("n"), F.max("weight").alias("w"), F.sum("weight").alias("s"))
    top = exposure(held, industry).groupBy("trade_date").agg(F.max("exposure").alias("i"))
    rows = day.join(top, "trade_date")
    rule = lambda name, value, limit, ok: F.struct(F.lit(name).alias("rule"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit"), ok.alias("passed"))
    cash = 1 - F.col("s")
    eps = 1e-9
    checks = F.array(rule("min_holdings", F.col("n"), min_holdings, F.col("n") >= min_holdings), rule("max_weight", F.col("w"), max_weight, F.col("w") <= max_weight + eps), rule("max_industry", F.col("i"), max_industry, F.col("i") <= max_industry + eps), rule("max_cash", cash, max_cash, cash <= max_cash + eps))
    return rows.select("trade_date", F.explode(checks).alias("c")).select("trade_date", "c.*")


def compliance_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("rule").agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("violations"), F.max("value").alias("largest"), F.first("limit").alias("limit"))


def unfilled_summary(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("status") != "filled").groupBy("reason").agg(F.count("*").alias("orders"), F.sum(F.col("quantity") - F.col("filled_quantity")).alias("open_quantity"))
