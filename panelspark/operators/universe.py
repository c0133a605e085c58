"""Tradability flags and the universe filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import exchange_limit_rate
from ..functions.windows import by_entity, rolling
from .joins import active_members, lookup, outside_intervals, positions


def yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def mark_tradability(bar: DataFrame, free_days: int = 0) -> DataFrame:
    """bar with can_buy, can_sell and block reasons at the open.

    Limits are those supplied, else previous close * (1 +- board rate). The
    first free_days rows of an asset have no limit. An unknown limit doesn't
    block. Rows in a delisting period (in_delisting, optional) can't be bought.
    """
    w = by_entity()
    has = lambda c, kind: F.col(c) if c in bar.columns else F.lit(None).cast(kind)
    rate = exchange_limit_rate("ts_code", "trade_date", has("is_st", "boolean"))
    before = F.lag("close").over(w)
    free = F.row_number().over(w) <= free_days
    up = F.when(~free, F.coalesce(has("up_limit", "double"), before * (1 + rate)))
    down = F.when(~free, F.coalesce(has("down_limit", "double"), before * (1 - rate)))
    halted, leaving = yes(has("is_suspended", "boolean")), yes(has("in_delisting", "boolean"))
    at_up, at_down = yes(F.col("open") >= up), yes(F.col("open") <= down)
    return bar.select(
        "*",
        (~halted & ~at_up & ~leaving).alias("can_buy"), (~halted & ~at_down).alias("can_sell"),
        F.when(halted, "suspended").when(at_up, "limit_up").when(leaving, "delisting_period").alias("buy_block_reason"),
        F.when(halted, "suspended").when(at_down, "limit_down").alias("sell_block_reason"),
    )


def add_open_limits(bar: DataFrame) -> DataFrame:
    """can_buy_open / can_sell_open from supplied limits alone."""
    return bar.withColumn("can_buy_open", F.coalesce(F.col("open") < F.col("up_limit"), F.lit(True))).withColumn("can_sell_open", F.coalesce(F.col("open") > F.col("down_limit"), F.lit(True)))


def filter_universe(
    bar: DataFrame, calendar: DataFrame, *, basics: DataFrame | None = None, members: DataFrame | None = None, st: DataFrame | None = None, suspension: DataFrame | None = None,
    min_sessions: int = 0, min_amount: float | None = None, exclude_flags: bool = True,
) -> DataFrame:
    """Bars that may be held: not flagged, listed for min_sessions sessions and not delisted, member, outside ST and suspension, liquid.

    Listing age counts sessions from the first one on or after the list date.
    """
    out = bar
    if exclude_flags:
        for flag in ("is_suspended", "is_st"):
            if flag in out.columns:
                out = out.where(~yes(F.col(flag)))
    if basics is not None:
        days = positions(calendar, {}).select("trade_date", "position")
        listed = basics.select("ts_code", "list_date", "delist_date")
        first = listed.join(lookup(days.withColumnRenamed("trade_date", "__d")), F.col("__d") >= F.col("list_date"), "left").groupBy("ts_code").agg(F.min("position").alias("__since"), F.first("delist_date").alias("__gone"))
        out = out.join(lookup(days), "trade_date").join(first, "ts_code")
        out = out.where((F.col("position") - F.col("__since") >= min_sessions) & (F.col("__gone").isNull() | (F.col("trade_date") < F.col("__gone")))).drop("position", "__since", "__gone")
    if members is not None:
        out = out.join(active_members(out.select("trade_date").distinct(), members), ["trade_date", "ts_code"], "left_semi")
    if st is not None:
        out = outside_intervals(out, st, "start_date", "end_date")
    if suspension is not None:
        out = outside_intervals(out, suspension, "suspend_date", "resume_date")
    if min_amount is not None:
        out = out.withColumn("__a", rolling(F.avg, "amount", 20, 5)).where(F.col("__a") >= min_amount).drop("__a")
    return out
