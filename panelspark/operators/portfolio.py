"""Portfolio construction, trade costs, the weight-space backtest."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from ..functions.windows import cumulative_return
from .joins import lookup, positions


@dataclass(frozen=True)
class Costs:
    """Shares of traded value, and the least commission of an order."""

    commission_buy: float = 0.0003
    commission_sell: float = 0.0003
    stamp_sell: float = 0.0005
    slippage: float = 0.0005
    impact: float = 0.0002
    least_commission: float = 5.0

    def scaled(self, k: float) -> Costs:
        return Costs(self.commission_buy * k, self.commission_sell * k, self.stamp_sell * k, self.slippage * k, self.impact * k, self.least_commission * k)


def trade_cost(notional, side, c: Costs) -> Column:
    """Commission with its minimum, stamp tax on sells, slippage and impact; nothing for nothing."""
    x, s = F.abs(F.col(notional) if isinstance(notional, str) else notional), F.col(side) if isinstance(side, str) else side
    fee = F.greatest(x * F.when(s == "sell", c.commission_sell).otherwise(c.commission_buy), F.lit(c.least_commission))
    return F.when(x > 0, fee + F.when(s == "sell", x * c.stamp_sell).otherwise(0.0) + x * (c.slippage + c.impact)).otherwise(0.0)


def rank_portfolio(scores: DataFrame, top: int, max_weight: float, min_holdings: int = 1) -> DataFrame:
    """Equal weights of the best by score (ties by code); dates with too few names, or names that can't fill the book, have none."""
    w = Window.partitionBy("trade_date").orderBy(F.col("score").desc(), "ts_code")
    best = scores.where("score is not null").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top)
    n = F.count("*").over(Window.partitionBy("trade_date"))
    out = best.withColumn("__n", n).where((F.col("__n") >= min_holdings) & (F.col("__n") * max_weight >= 1 - 1e-12))
    return out.withColumn("target_weight", 1.0 / F.col("__n")).drop("__r", "__n")


def infeasible_dates(scores: DataFrame, top: int, max_weight: float, min_holdings: int = 1) -> DataFrame:
    n = F.least(F.count("*"), F.lit(top))
    g = scores.where("score is not null").groupBy("trade_date").agg(n.alias("n"))
    return g.withColumn("reason", F.when(F.col("n") < min_holdings, "too_few_holdings").when(F.col("n") * max_weight < 1 - 1e-12, "max_weight_too_small")).where("reason is not null")


def cap_industries(weights: DataFrame, cap: float, max_weight: float, rounds: int = 100) -> DataFrame:
    """Industry weights at most cap: over-weight industries shrink, the excess goes to names with room in the others, by room; a fixed point per date."""

    def settle(day: pd.DataFrame) -> pd.DataFrame:
        w, group = day["target_weight"].to_numpy(float).copy(), day["industry_code"].fillna("").to_numpy()
        for _ in range(rounds):
            total = pd.Series(w).groupby(group).sum()
            over = total[total > cap + 1e-12]
            if over.empty:
                break
            for g, s in over.items():
                w[group == g] *= cap / s
            room = (max_weight - w).clip(min=0)
            room[[total[g] >= cap - 1e-12 for g in group]] = 0
            spare = 1 - w.sum()
            if room.sum() <= 0 or spare <= 1e-12:
                break
            w += room * min(1.0, spare / room.sum())
        return day.assign(target_weight=w)

    return weights.groupBy("trade_date").applyInPandas(settle, weights.schema)


def rebalance_costs(targets: DataFrame, c: Costs) -> DataFrame:
    """(trade_date, buy, sell, turnover, cost) of consecutive weight vectors; names that leave count as sold."""
    dates = targets.select("trade_date").distinct().withColumn("__next", F.lead("trade_date").over(Window.orderBy("trade_date")))
    now = targets.select("trade_date", "ts_code", F.col("target_weight").alias("w"))
    before = now.join(lookup(dates), "trade_date").where("__next is not null").select(F.col("__next").alias("trade_date"), "ts_code", F.col("w").alias("p"))
    d = now.join(before, ["trade_date", "ts_code"], "full_outer").select("trade_date", (F.coalesce("w", F.lit(0.0)) - F.coalesce("p", F.lit(0.0))).alias("d"))
    g = d.groupBy("trade_date").agg(F.sum(F.greatest("d", F.lit(0.0))).alias("buy"), F.sum(F.greatest(-F.col("d"), F.lit(0.0))).alias("sell"))
    cost = F.col("buy") * c.commission_buy + F.col("sell") * (c.commission_sell + c.stamp_sell) + (F.col("buy") + F.col("sell")) * (c.slippage + c.impact)
    return g.select("trade_date", "buy", "sell", ((F.col("buy") + F.col("sell")) / 2).alias("turnover"), cost.alias("cost"))


def weight_backtest(targets: DataFrame, returns: DataFrame, calendar: DataFrame, c: Costs) -> DataFrame:
    """(trade_date, gross, cost, ret, nav): a signal acts from the next session until the next signal does; weights don't drift."""
    ahead = positions(calendar, {"effective": 1}).drop("position")
    signals = targets.select("trade_date").distinct().join(lookup(ahead), "trade_date").where("effective is not null")
    w = Window.orderBy("effective")
    spans = signals.select("trade_date", "effective", F.lead("effective").over(w).alias("until"))
    days = calendar.select(F.col("trade_date").alias("day")).distinct().join(lookup(spans), (F.col("day") >= F.col("effective")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    held = days.join(targets.select("trade_date", "ts_code", "target_weight"), "trade_date")
    r = returns.select(F.col("trade_date").alias("day"), "ts_code", "ret")
    gross = held.join(r, ["day", "ts_code"], "left").groupBy("day").agg(F.sum(F.col("target_weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"))
    cost = rebalance_costs(targets, c).join(lookup(spans.select("trade_date", "effective")), "trade_date").select(F.col("effective").alias("day"), "cost")
    out = gross.join(lookup(cost), "day", "left").withColumn("cost", F.coalesce("cost", F.lit(0.0))).withColumn("ret", F.col("gross") - F.col("cost"))
    return out.select(F.col("day").alias("trade_date"), "gross", "cost", "ret", cumulative_return("ret", Window.orderBy("day")).alias("nav"))


def scale_exposure(targets: DataFrame, scalars: DataFrame) -> DataFrame:
    """Weights times the date's scalar, 1 where there is none."""
    s = scalars.select("trade_date", F.col("scalar").alias("__s"))
    return targets.join(lookup(s), "trade_date", "left").withColumn("target_weight", F.col("target_weight") * F.coalesce("__s", F.lit(1.0))).drop("__s")


def benchmark_industries(members: DataFrame, industry: DataFrame) -> DataFrame:
    """Industry weights of a benchmark's members by date: normalised, equal if all weights are zero."""
    w = Window.partitionBy("trade_date")
    total, n = F.sum(F.coalesce("weight", F.lit(0.0))).over(w), F.count("*").over(w)
    m = members.withColumn("__w", F.when(total > 0, F.coalesce("weight", F.lit(0.0)) / total).otherwise(safe_divide(F.lit(1.0), n)))
    return m.join(industry, "ts_code", "left").groupBy("trade_date", "industry_code").agg(F.sum("__w").alias("exposure"))
