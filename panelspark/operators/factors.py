"""The registered factors as column expressions over an asset's rows, and the panel that carries them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import log_size, reciprocal, safe_divide, sentiment_score
from ..functions.windows import by_entity, keep_one, lagged_return, rolling
from .joins import as_of, attach_timing, event_availability, forward_return_by_calendar, trailing_event_sum


@dataclass(frozen=True)
class Factor:
    name: str
    category: str
    direction: int
    window: int
    inputs: tuple[str, ...]
    neutralize: str = "industry_size"


REGISTRY: dict[str, Factor] = {}
BUILDERS: dict[str, Callable[[], Column]] = {}


def register(name: str, category: str, direction: int, window: int, inputs: str, neutralize: str = "industry_size", build: Callable[[], Column] | None = None) -> None:
    """Adds a factor; users may add their own, with `build` giving its column."""
    REGISTRY[name] = Factor(name, category, direction, window, tuple(inputs.split()), neutralize)
    if build is not None:
        BUILDERS[name] = build


# Names, directions and windows of the factor catalogue.
for _name, _direction, _window in (("mom_20", 1, 20), ("mom_60_skip5", 1, 60), ("mom_120", 1, 120), ("rev_5", 1, 5), ("rev_20", 1, 20), ("vol_20", -1, 20), ("vol_60", -1, 60), ("beta_60", -1, 60), ("idio_vol_60", -1, 60)):
    register(_name, "price", _direction, _window, "adj_close return_1d")
for _name, _direction in (("turnover_20", -1), ("turnover_chg_20", 1), ("amount_mom_20", 1), ("amihud_20", -1)):
    register(_name, "liquidity", _direction, 20, "turnover_rate amount return_1d")
register("size", "value", -1, 0, "total_mv", "industry")
for _name in ("bp", "ep", "sp", "cfp"):
    register(_name, "value", 1, 0, "pb pe_ttm ps operating_cash_flow total_mv")
for _name, _direction in (("roe", 1), ("roa", 1), ("gross_margin", 1), ("gross_margin_stability", 1), ("debt_ratio", -1), ("asset_turnover", 1), ("revenue_yoy", 1), ("profit_yoy", 1), ("roe_delta", 1)):
    register(_name, "quality", _direction, 4 if _name == "gross_margin_stability" else int(_name == "roe_delta"), _name)
for _name, _window in (("mf_5", 5), ("mf_20", 20), ("large_order_mf_20", 20)):
    register(_name, "flow", 1, _window, "net_mf_amount amount")
register("event_sentiment_20", "event", 1, 20, "news_event", "none")


def add_prices(bar: DataFrame) -> DataFrame:
    """adj_close and return_1d (against the asset's row before)."""
    out = bar.withColumn("adj_close", F.col("close") * F.col("adj_factor"))
    return out.withColumn("return_1d", safe_divide("adj_close", F.lag("adj_close").over(by_entity())) - 1)


def price_factors(df: DataFrame) -> DataFrame:
    """df (adj_close, return_1d, amount, turnover_rate) with the price and liquidity factors. Two shuffles: by date, then by asset."""
    r, m = F.col("return_1d"), F.col("market_return")
    out = df.withColumn("market_return", F.avg("return_1d").over(Window.partitionBy("trade_date")))
    mean = lambda x, n, k: rolling(F.avg, x, n, k)
    out = out.select(
        "*",
        lagged_return("adj_close", 20).alias("mom_20"), lagged_return("adj_close", 60, 5).alias("mom_60_skip5"), lagged_return("adj_close", 120).alias("mom_120"),
        (-lagged_return("adj_close", 5)).alias("rev_5"), (-lagged_return("adj_close", 20)).alias("rev_20"),
        rolling(F.stddev_samp, "return_1d", 20, 10).alias("vol_20"), rolling(F.stddev_samp, "return_1d", 60, 30).alias("vol_60"),
        mean("turnover_rate", 20, 10).alias("turnover_20"), mean("amount", 20, 10).alias("__amount_20"),
        mean(safe_divide(F.abs(r), "amount"), 20, 10).alias("amihud_20"),
        mean(r * m, 60, 30).alias("__xy"), mean(r, 60, 30).alias("__x"), mean(m, 60, 30).alias("__y"), mean(m * m, 60, 30).alias("__yy"),
    )
    w = by_entity()
    out = out.withColumns({
        "turnover_chg_20": safe_divide("turnover_20", F.lag("turnover_20", 20).over(w)) - 1,
        "amount_mom_20": safe_divide("__amount_20", F.lag("__amount_20", 20).over(w)) - 1,
        "beta_60": safe_divide(F.col("__xy") - F.col("__x") * F.col("__y"), F.col("__yy") - F.col("__y") * F.col("__y")),
    })
    out = out.withColumn("idio_vol_60", rolling(F.stddev_samp, r - F.col("beta_60") * m, 60, 30))
    return out.drop("__amount_20", "__xy", "__x", "__y", "__yy")


def flow_factors(df: DataFrame) -> DataFrame:
    """df with mf_5, mf_20 and large_order_mf_20 (NULL without the large-order column)."""
    flow = lambda c: safe_divide(c, "amount")
    large = flow("large_order_net_mf_amount") if "large_order_net_mf_amount" in df.columns else F.lit(None).cast("double")
    return df.select("*", rolling(F.sum, flow("net_mf_amount"), 5, 3).alias("mf_5"), rolling(F.sum, flow("net_mf_amount"), 20, 10).alias("mf_20"), rolling(F.sum, large, 20, 10).alias("large_order_mf_20"))


def report_factors(fin: DataFrame) -> DataFrame:
    """Financial rows with the factors that run over reports: roe_delta, gross_margin_stability, roa, asset_turnover (where absent)."""
    order = [F.col(c).desc_nulls_last() for c in ("ann_date", "report_period", "revision_date", "revision_id") if c in fin.columns]
    w = Window.partitionBy("ts_code").orderBy("usable_date")
    last = keep_one(fin, ["ts_code", "usable_date"], order)
    out = last.withColumn("roe_delta", F.col("roe") - F.lag("roe").over(w)).withColumn("gross_margin_stability", -rolling(F.stddev_samp, "gross_margin", 4, 2, w))
    for name, top, bottom in (("roa", "net_profit", "total_assets"), ("asset_turnover", "operating_revenue", "total_assets")):
        if name not in out.columns:
            out = out.withColumn(name, safe_divide(top, bottom) if {top, bottom} <= set(out.columns) else F.lit(None).cast("double"))
    return out


def fundamental_factors(df: DataFrame, fin: DataFrame) -> DataFrame:
    """df with the last report usable at each date (whole row) and cfp."""
    rows = report_factors(fin)
    names = ["roe", "roa", "gross_margin", "gross_margin_stability", "debt_ratio", "asset_turnover", "revenue_yoy", "profit_yoy", "roe_delta", "operating_cash_flow", "report_period", "ann_date"]
    out = as_of(df, rows.select("ts_code", "usable_date", *(n for n in names if n in rows.columns and n not in df.columns)), "ts_code", "trade_date", "usable_date")
    for n in names[:9]:
        if n not in out.columns:
            out = out.withColumn(n, F.lit(None).cast("double"))
    cash = safe_divide("operating_cash_flow", "total_mv") if {"operating_cash_flow", "total_mv"} <= set(out.columns) else F.lit(None).cast("double")
    return out.withColumn("cfp", cash)


def value_factors(df: DataFrame) -> DataFrame:
    ps = reciprocal("ps") if "ps" in df.columns else F.lit(None).cast("double")
    return df.select("*", log_size("total_mv").alias("size"), reciprocal("pb").alias("bp"), reciprocal("pe_ttm").alias("ep"), ps.alias("sp"))


def event_factor(df: DataFrame, news: DataFrame, calendar: DataFrame, days: int = 20) -> DataFrame:
    """df with event_sentiment_20: trailing sum of score * confidence by availability, 0 without events; the last row of an event id counts."""
    e = keep_one(news, ["event_id"], [F.col("publish_time").desc_nulls_last(), F.col("publish_date").desc()]) if "event_id" in news.columns else news
    e = event_availability(e.withColumn("__score", sentiment_score("sentiment", F.col("confidence"))), calendar)
    daily = trailing_event_sum(e, df.select("trade_date").distinct(), "__score", days, name="event_sentiment_20").select(F.col("stock_code").alias("ts_code"), "trade_date", "event_sentiment_20")
    return df.join(daily, ["ts_code", "trade_date"], "left").fillna(0.0, ["event_sentiment_20"])


def apply_directions(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Factors with direction -1 turned, so that larger is better."""
    flip = {n: -F.col(n) for n in (names or REGISTRY) if n in df.columns and REGISTRY[n].direction == -1}
    return df.withColumns(flip) if flip else df


def build_panel(tables: dict[str, DataFrame], horizons: tuple[int, ...] = (5, 10, 20, 60), universe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The factor panel: prices and forward returns over all rows, then the universe, then rolling factors over what is left."""
    calendar = tables["trade_calendar"].where("is_open").select("trade_date")
    bar = add_prices(tables["daily_bar"])
    for h in horizons:
        bar = forward_return_by_calendar(bar, calendar, "adj_close", h)
    if universe is not None:
        bar = universe(bar)
    key = ["trade_date", "ts_code"]
    out = bar.join(tables["daily_basic"], key, "left")
    if "industry" in tables:
        out = out.join(tables["industry"].select(*key, "industry_code"), key, "left")
    out = flow_factors(price_factors(value_factors(out)))
    if "financial_indicator" in tables:
        out = fundamental_factors(out, tables["financial_indicator"])
    if "news_event" in tables:
        out = event_factor(out, tables["news_event"], calendar)
    out = attach_timing(out, calendar, horizons[min(2, len(horizons) - 1)])
    for name, build in BUILDERS.items():
        out = out.withColumn(name, build())
    return apply_directions(out)


def registered(names: list[str] | None = None, categories: list[str] | None = None) -> list[Factor]:
    """Registry lookup by name or category; unknown names raise."""
    if unknown := sorted(set(names or ()) - set(REGISTRY)):
        raise KeyError(f"unknown factors: {unknown}")
    return [f for f in REGISTRY.values() if (names is None or f.name in names) and (categories is None or f.category in categories)]
