"""A deterministic synthetic bundle of the twelve tables, made from hashes of row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import write_any
from .schema import conform

START = "2022-01-03"


def _uniform(seed: int, *keys) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _normal(seed: int, *keys) -> Column:
    """By Box and Muller."""
    return F.sqrt(-2.0 * F.log(_uniform(seed, *keys) + 1e-12)) * F.cos(2 * 3.141592653589793 * _uniform(seed + 1000, *keys))


def sample_bundle(spark: SparkSession, stocks: int = 60, days: int = 180, seed: int = 42) -> dict[str, DataFrame]:
    """Frames by table name; no driver-side rows, any size."""
    weeks = spark.range(days * 7 // 5 + 8).select(F.date_add(F.to_date(F.lit(START)), F.col("id").cast("int")).alias("trade_date"))
    open_days = weeks.where(F.weekday("trade_date") < 5).orderBy("trade_date").limit(days)
    codes = spark.range(stocks).select(F.format_string("%06d.%s", F.when(F.col("id") % 3 == 0, F.col("id") + 600001).otherwise(F.col("id") + 1), F.when(F.col("id") % 3 == 0, "SH").otherwise("SZ")).alias("ts_code"), "id")
    grid = open_days.crossJoin(F.broadcast(codes))  # the grid itself is the sample
    w = F.expr("sum(r) over (partition by ts_code order by trade_date)")
    path = grid.withColumn("r", 0.0003 + 0.02 * _normal(seed, "ts_code", "trade_date")).withColumn("close", (8 + 40 * _uniform(seed + 1, "ts_code")) * F.exp(w))
    wave = lambda k: 1 + 0.01 * _normal(seed + k, "ts_code", "trade_date")
    bar = path.withColumn("open", F.col("close") * wave(2)).withColumn("volume", (1e5 + 1e6 * _uniform(seed + 3, "ts_code", "trade_date")).cast("bigint"))
    bar = bar.select("trade_date", "ts_code", "open", (F.greatest("open", "close") * 1.005).alias("high"), (F.least("open", "close") * 0.995).alias("low"), "close", "volume", (F.col("volume") * F.col("close")).alias("amount"), F.lit(1.0).alias("adj_factor"), F.lit(False).alias("is_suspended"), (F.col("id") % 29 == 7).alias("is_st"), (F.col("close") * 1.1).alias("up_limit"), (F.col("close") * 0.9).alias("down_limit"), F.lit("unadjusted").alias("price_adjustment"))
    u = lambda k: _uniform(seed + k, "ts_code", "trade_date")
    basic = grid.select("trade_date", "ts_code", (5 + 40 * u(5)).alias("pe_ttm"), (0.5 + 5 * u(6)).alias("pb"), (1e9 * (1 + 50 * _uniform(seed + 7, "ts_code"))).alias("total_mv"), (0.05 * u(8)).alias("turnover_rate"), (1e7 * (u(9) - 0.5)).alias("net_mf_amount"), (0.5 + 8 * u(10)).alias("ps"), (5e6 * (u(11) - 0.5)).alias("large_order_net_mf_amount"))
    sector = F.format_string("I%02d", F.col("id") % 8)
    quarters = spark.range(8).select(F.last_day(F.add_months(F.to_date(F.lit("2021-03-31")), (F.col("id") * 3).cast("int"))).alias("report_period"))
    fin = quarters.crossJoin(F.broadcast(codes)).withColumn("ann_date", F.date_add("report_period", 30))
    f = lambda k: _uniform(seed + k, "ts_code", "report_period")
    fin = fin.select("report_period", "ann_date", F.date_add("ann_date", 1).alias("usable_date"), "ts_code", (0.2 * f(20)).alias("roe"), (0.6 * f(21)).alias("gross_margin"), (0.8 * f(22)).alias("debt_ratio"), (f(23) - 0.4).alias("revenue_yoy"), (f(24) - 0.4).alias("profit_yoy"), (1e9 * (1 + f(25))).alias("total_assets"), (4e8 * (1 + f(26))).alias("operating_revenue"), (5e7 * f(27)).alias("net_profit"), (6e7 * (f(28) - 0.2)).alias("operating_cash_flow"), F.col("ann_date").alias("revision_date"), F.lit(1).alias("revision_id"), F.lit("sample").alias("source_id"))
    start = F.to_date(F.lit(START))
    none = F.lit(None).cast("date")
    news = grid.where(_uniform(seed + 30, "ts_code", "trade_date") < 0.02)
    kind = F.element_at(F.array(*(F.lit(x) for x in ("positive", "neutral", "negative"))), (F.pmod(F.xxhash64("ts_code", "trade_date"), F.lit(3)) + 1).cast("int"))
    tables = {
        "trade_calendar": open_days.select("trade_date", F.lit(True).alias("is_open")),
        "stock_basic": codes.select("ts_code", F.concat(F.lit("name "), "ts_code").alias("name"), F.date_sub(start, 700).alias("list_date"), none.alias("delist_date"), F.substring("ts_code", 8, 2).alias("exchange")),
        "daily_bar": bar,
        "daily_basic": basic,
        "industry": grid.select("trade_date", "ts_code", sector.alias("industry_code"), F.concat(F.lit("sector "), sector).alias("industry_name")),
        "index_member": codes.select(F.lit("000905.SH").alias("index_code"), "ts_code", F.lit(1.0 / stocks).alias("weight"), F.date_sub(start, 30).alias("in_date"), none.alias("out_date")),
        "financial_indicator": fin,
        "suspension": codes.where("id % 17 = 3").select("ts_code", F.date_add(start, 40).alias("suspend_date"), F.date_add(start, 45).alias("resume_date")),
        "st_status": codes.where("id % 29 = 7").select("ts_code", F.date_add(start, 60).alias("start_date"), none.alias("end_date")),
        "limit_price": bar.select("trade_date", "ts_code", "up_limit", "down_limit"),
        "benchmark_index": bar.groupBy("trade_date").agg((1000 * F.avg("close") / 28).alias("close")).select("trade_date", F.lit("000905.SH").alias("index_code"), "close"),
        "news_event": news.select(F.col("ts_code").alias("stock_code"), F.col("trade_date").alias("publish_date"), F.lit("notice").alias("event_type"), kind.alias("sentiment"), F.lit("short").alias("impact_horizon"), (0.3 + 0.7 * _uniform(seed + 31, "ts_code", "trade_date")).alias("confidence"), F.lit("sample").alias("reason"), F.sha2(F.concat("ts_code", F.col("trade_date").cast("string")), 256).alias("event_id"), F.to_timestamp_ntz(F.concat(F.col("trade_date").cast("string"), F.lit(" 14:00:00"))).alias("publish_time")),
    }
    return {name: conform(df, name) for name, df in tables.items()}


def write_sample(spark: SparkSession, folder: str, kind: str = "parquet", **how) -> list[str]:
    names = []
    for name, df in sample_bundle(spark, **how).items():
        write_any(df, f"{folder}/{name}.{kind}", kind, mode="overwrite")
        names.append(name)
    return names
