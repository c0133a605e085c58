"""Information coefficients, quantile groups, inference, regimes, selection and walk-forward scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from ..functions.stats import benjamini_hochberg, newey_west, safe_corr
from ..functions.windows import average_rank, cumulative_return, dealt, first_rank_bucket, membership_turnover, rolling
from .joins import lookup


def daily_ic(df: DataFrame, target: str, keys: list[str] | None = None, value: str = "value", method: str = "spearman", least: int = 3) -> DataFrame:
    """keys, ic and n: rank (or Pearson) correlation of complete pairs; too few pairs or a constant side gives NULL. keys hold the date."""
    keys = keys or ["trade_date", "factor"]
    rows = df.where(F.col(value).isNotNull() & F.col(target).isNotNull()).select(*keys, F.col(value).alias("x"), F.col(target).alias("y"))
    if method == "spearman":
        rows = dealt(rows, keys).select(*keys, average_rank("x", keys).alias("x"), average_rank("y", keys).alias("y"))
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr("x", "y").alias("ic"))
    return g.select(*keys, F.when(F.col("n") >= least, F.col("ic")).alias("ic"), "n")


def ic_summary(ic: DataFrame, keys: list[str]) -> DataFrame:
    """mean, std, icir, hit_rate, t_stat and count of non-NULL ICs."""
    g = ic.where(F.col("ic").isNotNull()).groupBy(*keys).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"), F.count("*").alias("count"))
    ir = safe_divide("ic_mean", "ic_std")
    return g.select(*keys, "ic_mean", "ic_std", ir.alias("icir"), "hit_rate", (ir * F.sqrt("count")).alias("t_stat"), "count")


def annual_ic(ic: DataFrame, keys: list[str]) -> DataFrame:
    return ic_summary(ic.withColumn("year", F.year("trade_date")), [*keys, "year"])


def rolling_ic(ic: DataFrame, keys: list[str], window: int = 12) -> DataFrame:
    """Rolling mean and ICIR with max(3, window // 2) values at least."""
    w, least = Window.partitionBy(*keys).orderBy("trade_date"), max(3, window // 2)
    mean, std = rolling(F.avg, "ic", window, least, w), rolling(F.stddev_samp, "ic", window, least, w)
    return ic.select(*keys, "trade_date", mean.alias("rolling_ic"), safe_divide(mean, std).alias("rolling_icir")).where("rolling_ic is not null")


def ic_decay(df: DataFrame, horizons: dict[int, str], value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """IC summary by factor and horizon; horizons: number -> forward return column."""
    keys = keys or ["factor"]
    pairs = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(c).alias("y")) for h, c in horizons.items())))
    rows = df.select("trade_date", *keys, value, pairs.alias("p")).select("trade_date", *keys, value, "p.horizon", "p.y")
    return ic_summary(daily_ic(rows, "y", ["trade_date", *keys, "horizon"], value), [*keys, "horizon"])


def market_regime(series: DataFrame, value: str) -> DataFrame:
    """Labels from the whole sample's quantiles (a diagnostic: it looks ahead)."""
    q = series.agg(F.percentile(value, F.array(F.lit(0.3), F.lit(0.7))).alias("q"))
    x = F.col(value)
    return series.join(F.broadcast(q)).withColumn("regime_in_sample", F.when(x <= F.col("q")[0], "bear").when(x <= F.col("q")[1], "range").when(x.isNotNull(), "bull")).drop("q")


def regime_ic(ic: DataFrame, regimes: DataFrame, keys: list[str]) -> DataFrame:
    return ic_summary(ic.join(lookup(regimes.select("trade_date", "regime_in_sample")), "trade_date"), [*keys, "regime_in_sample"])


def group_returns(df: DataFrame, target: str, q: int = 5, value: str = "value", keys: list[str] | None = None, tie: str = "ts_code") -> DataFrame:
    """keys, Q1..Qq mean returns and spread Qq - Q1; fewer than q distinct values give no row."""
    keys = keys or ["trade_date", "factor"]
    rows = df.where(F.col(value).isNotNull() & F.col(target).isNotNull())
    rows = rows.withColumn("g", first_rank_bucket(value, q, keys, tie, least_distinct=q)).where("g is not null")
    wide = rows.groupBy(*keys).pivot("g", list(range(1, q + 1))).agg(F.avg(target))
    return wide.select(*keys, *(F.col(str(i)).alias(f"Q{i}") for i in range(1, q + 1)), (F.col(str(q)) - F.col("1")).alias("spread"))


def groups_of(df: DataFrame, q: int = 5, value: str = "value", keys: list[str] | None = None, tie: str = "ts_code") -> DataFrame:
    keys = keys or ["trade_date", "factor"]
    rows = df.where(F.col(value).isNotNull())
    return rows.withColumn("group", first_rank_bucket(value, q, keys, tie, least_distinct=q)).where("group is not null")


def non_overlapping(df: DataFrame, dates: DataFrame, target: str, end: str = "target_return_end_date", **how) -> DataFrame:
    """Group returns on declared dates whose labels end before the next one starts; overlap raises."""
    rows = df.join(lookup(dates.select("trade_date").distinct()), "trade_date", "left_semi")
    spans = rows.groupBy("trade_date").agg(F.max(end).alias("__end")).withColumn("__next", F.lead("trade_date").over(Window.orderBy("trade_date")))
    if spans.where(F.col("__end") >= F.col("__next")).limit(1).count():
        raise ValueError("labels overlap")
    return group_returns(rows, target, **how)


def group_counts(groups: DataFrame, keys: list[str]) -> DataFrame:
    return groups.groupBy(*keys, "group").agg(F.count("*").alias("n"))


def cumulative_groups(wide: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(keys or [])).orderBy("trade_date")
    return wide.select(*(keys or []), "trade_date", *(cumulative_return(c, w).alias(c) for c in columns))


def group_turnover(groups: DataFrame, keys: list[str] | None = None, first: float | None = None) -> DataFrame:
    return membership_turnover(groups, [*(keys or []), "group"], "trade_date", "ts_code", first)


def monotonicity(wide: DataFrame, q: int, keys: list[str]) -> DataFrame:
    """Share of rising steps and rank correlation of the groups' mean returns with their number."""
    means = wide.groupBy(*keys).agg(*(F.avg(f"Q{i}").alias(f"Q{i}") for i in range(1, q + 1)))
    long = means.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("g"), F.col(f"Q{i}").alias("m")) for i in range(1, q + 1)))).alias("p")).select(*keys, "p.g", "p.m").where("m is not null")
    w = Window.partitionBy(*keys).orderBy("g")
    long = long.select(*keys, "g", "m", (F.col("m") > F.lag("m").over(w)).cast("double").alias("up"), average_rank("m", keys).alias("r"))
    return long.groupBy(*keys).agg(F.avg("up").alias("rising_share"), safe_corr("g", "r").alias("rank_corr"))


def factor_inference(ic: DataFrame, keys: list[str], lags: int, order: str = "trade_date") -> DataFrame:
    """HAC mean test by key with q-values over the keys."""
    return benjamini_hochberg(newey_west(ic, "ic", keys, order, lags), "nw_p")


def select_factors(summary: list[dict], correlation: dict[tuple[str, str], float], least_ic: float = 0.01, least_icir: float = 0.05, most_corr: float = 0.85) -> list[dict]:
    """Greedy choice over a summary of at most some dozen factors: by |IC|, skipping weak and redundant ones, with reasons."""
    out, kept = [], []
    for row in sorted(summary, key=lambda r: (-abs(r["ic_mean"] or 0.0), r["factor"])):
        name, ic, ir = row["factor"], abs(row["ic_mean"] or 0.0), abs(row["icir"] or 0.0)
        close = max(((abs(correlation.get((name, k), correlation.get((k, name), 0.0)) or 0.0), k) for k in kept), default=(0.0, ""))
        why = "low_ic" if ic < least_ic else "low_icir" if ir < least_icir else f"correlated_with_{close[1]}" if close[0] > most_corr else "selected"
        if why == "selected":
            kept.append(name)
        out.append({"factor": name, "selected": why == "selected", "reason": why})
    return out


def walk_forward(ic: DataFrame, dates: DataFrame, coverage: DataFrame, *, train_months: int = 24, validation_months: int = 6, least_dates: int = 6, least_ic: float = 0.01, least_coverage: float = 0.3, max_factors: int = 12) -> DataFrame:
    """(test_date, factor): train and validation IC, coverage, direction, selection, weight and anomaly flags.

    A label's end depends on the date alone, so daily ICs are worked out once and
    every window is a mean over them. ic: trade_date, label_end, factor, ic.
    """
    t = lookup(dates.select(F.col("trade_date").alias("test_date")).distinct())
    v0, t0 = F.add_months("test_date", -validation_months), F.add_months("test_date", -(train_months + validation_months))
    d = F.col("trade_date")
    rows = ic.where("ic is not null").join(t, (d >= t0) & (d < F.col("test_date")))  # the windows bound the join by date
    in_train = (d < v0) & (F.col("label_end") < v0)
    in_valid = (d >= v0) & (F.col("label_end") < F.col("test_date"))
    g = rows.groupBy("test_date", "factor").agg(F.avg(F.when(in_train, F.col("ic"))).alias("train_ic"), F.count_if(in_train).alias("train_dates"), F.avg(F.when(in_valid, F.col("ic"))).alias("validation_ic"))
    g = g.join(coverage.select(F.col("trade_date").alias("test_date"), "factor", "coverage"), ["test_date", "factor"], "left")
    agree = F.col("validation_ic").isNull() | (F.signum("validation_ic") == F.signum("train_ic"))
    good = (F.col("train_dates") >= least_dates) & (F.col("coverage") >= least_coverage) & (F.abs("train_ic") >= least_ic) & agree
    g = g.withColumn("eligible", F.coalesce(good, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("test_date", "eligible").orderBy(F.abs("train_ic").desc(), "factor"))
    g = g.withColumn("selected", F.col("eligible") & (rank <= max_factors))
    strength = F.when(F.col("selected"), F.abs("train_ic"))
    w = Window.partitionBy("test_date")
    weight = safe_divide(strength, F.sum(strength).over(w))
    flags = F.concat_ws(";", F.when(F.abs("train_ic") > 0.3, "extreme_train_ic"), F.when(F.coalesce("coverage", F.lit(0.0)) < least_coverage, "low_coverage"), F.when(F.col("train_dates") < least_dates, "insufficient_train_dates"), F.when(F.coalesce(F.max(F.col("selected").cast("int")).over(w), F.lit(0)) == 0, "no_factor_selected"))
    return g.select("test_date", "factor", "train_ic", "train_dates", "validation_ic", "coverage", F.signum("train_ic").alias("direction"), "selected", weight.alias("weight"), flags.alias("anomalies"))


def weighted_scores(panel: DataFrame, weights: DataFrame, value: str = "value") -> DataFrame:
    """(trade_date, ts_code): sum of weight * direction * value over factors that are there, by the weight of those."""
    w = weights.where("selected").select(F.col("test_date").alias("trade_date"), "factor", "weight", "direction")
    rows = panel.join(w, ["trade_date", "factor"]).where(F.col(value).isNotNull())
    return rows.groupBy("trade_date", "ts_code").agg(safe_divide(F.sum(F.col("weight") * F.col("direction") * F.col(value)), F.sum("weight")).alias("score"), F.count("*").alias("factors"))


def forecast_scores(df: DataFrame, keys: list[str], actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """rmse, mae, direction accuracy, rank correlation and n."""
    rows = df.where(F.col(actual).isNotNull() & F.col(forecast).isNotNull()).withColumn("e", F.col(actual) - F.col(forecast))
    rows = rows.withColumn("ra", average_rank(actual, keys)).withColumn("rf", average_rank(forecast, keys))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.avg((F.signum(actual) == F.signum(forecast)).cast("double")).alias("direction_accuracy"), safe_corr("ra", "rf").alias("rank_corr"))


def monthly_quintiles(df: DataFrame, target: str, benchmark: DataFrame, q: int = 5, least: int = 10, cost: float = 0.0015, value: str = "value", tie: str = "ts_code") -> DataFrame:
    """(trade_date, factor): spread, long-only, relative to the benchmark's log return, turnover of the top group (first 1.0), cost and net.

    benchmark: trade_date, log_ret of the interval that the target covers. Dates with fewer than `least` rows have none.
    """
    keys = ["trade_date", "factor"]
    rows = df.where(F.col(value).isNotNull() & F.col(target).isNotNull()).withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("__n") >= least)
    rows = rows.withColumn("group", first_rank_bucket(value, q, keys, tie)).where(F.col("group").isin(1, q))
    g = rows.groupBy(*keys).agg(F.avg(F.when(F.col("group") == q, F.col(target))).alias("long_only"), F.avg(F.when(F.col("group") == 1, F.col(target))).alias("short_side"))
    moved = membership_turnover(rows.where(F.col("group") == q), ["factor"], "trade_date", tie, 1.0).select("factor", "trade_date", "turnover")
    out = g.join(moved, keys).join(lookup(benchmark.select("trade_date", "log_ret")), "trade_date", "left")
    return out.select(*keys, (F.col("long_only") - F.col("short_side")).alias("spread"), "long_only", (F.col("long_only") - F.col("log_ret")).alias("relative"), "turnover", (F.col("turnover") * cost).alias("cost"), (F.col("long_only") - F.col("turnover") * cost).alias("net"))


def monthly_states(series: DataFrame, dates: DataFrame) -> DataFrame:
    """(signal_date): sum of log returns, last and mean state from the month's start to the signal. series: date, log_ret, breadth, dispersion."""
    s = lookup(dates.select(F.col("trade_date").alias("signal_date")).distinct())
    rows = series.join(s, (F.trunc("date", "MM") == F.trunc("signal_date", "MM")) & (F.col("date") <= F.col("signal_date")))
    return rows.groupBy("signal_date").agg(F.sum("log_ret").alias("log_ret"), F.max_by("breadth", "date").alias("last_breadth"), F.avg("dispersion").alias("mean_dispersion"), F.count("*").alias("days"))
