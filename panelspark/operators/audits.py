"""Data-quality and point-in-time audits as queries; each is one or two grouped passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from ..functions.windows import by_entity, overlapping_intervals
from ..sources.schema import duplicate_keys
from .joins import active_members, key_coverage, lookup


def table_profile(df: DataFrame, key: list[str], dates: list[str], entity: str | None = None) -> DataFrame:
    """(metric, value): rows, duplicate keys, missing rates, date ranges (as days since 1970) and entities."""
    aggs = [F.count("*").cast("double").alias("rows")] + [F.avg(F.col(c).isNull().cast("double")).alias(f"missing:{c}") for c in df.columns]
    for d in dates:
        aggs += [F.min(F.unix_date(d)).cast("double").alias(f"first:{d}"), F.max(F.unix_date(d)).cast("double").alias(f"last:{d}")]
    if entity:
        aggs.append(F.count_distinct(entity).cast("double").alias("entities"))
    one = df.agg(*aggs)
    names = one.columns
    long = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names))).alias("m")).select("m.*")
    return long.unionByName(duplicate_keys(df, key).agg(F.count("*").cast("double").alias("value")).select(F.lit("duplicate_keys").alias("metric"), "value"))


def bar_checks(bar: DataFrame) -> DataFrame:
    """Counts of impossible or suspicious bars."""
    w = by_entity()
    rows = bar.withColumn("__k", safe_divide("close", F.lag("close").over(w))).withColumn("__f", F.abs(safe_divide("adj_factor", F.lag("adj_factor").over(w)) - 1))
    held = F.col("price_adjustment") == "unadjusted_placeholder_factor" if "price_adjustment" in bar.columns else F.lit(False)
    return rows.agg(
        F.count("*").alias("rows"), F.count_if((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))).alias("bad_range"), F.count_if(F.least("open", "high", "low", "close") <= 0).alias("not_positive"),
        F.count_if((F.col("volume") < 0) | (F.col("amount") < 0)).alias("negative"), F.count_if((F.col("volume") > 0) & (F.col("amount") == 0)).alias("zero_amount"), F.count_if((F.col("__k") > 20) | (F.col("__k") < 0.05)).alias("price_spikes"),
        F.count_if(F.col("__f") > 0.5).alias("factor_jumps"), F.count_if(F.coalesce(held, F.lit(False))).alias("placeholder_factors"),
    )


def financial_timing(fin: DataFrame) -> DataFrame:
    """Rows that break report <= announcement < usable <= ..., with reasons."""
    problems = F.concat_ws(";", F.when(F.col("ann_date") < F.col("report_period"), "announced_before_period_end"), F.when(F.col("usable_date") <= F.col("ann_date"), "usable_not_after_announcement"), F.when(F.col("usable_date").isNull(), "no_usable_date"))
    return fin.withColumn("problems", problems).where("problems != ''")


def revision_chains(fin: DataFrame) -> DataFrame:
    """(ts_code, report_period): announcements, revisions, sources, first and last usable date, and whether later revisions are usable later."""
    w = Window.partitionBy("ts_code", "report_period").orderBy("revision_id", "ann_date")
    late = F.coalesce(F.col("usable_date") < F.lag("usable_date").over(w), F.lit(False))
    return fin.withColumn("__l", late).groupBy("ts_code", "report_period").agg(F.count_distinct("ann_date").alias("announcements"), F.count("*").alias("rows"), F.count_distinct("revision_id").alias("revisions"), F.min("usable_date").alias("first_usable"), F.max("usable_date").alias("last_usable"), (~F.max("__l")).alias("ordered"))


def survivorship(listed: DataFrame, members: DataFrame, bar: DataFrame) -> DataFrame:
    """Every code with flags: in the security list, among index members, in the bars."""
    a, b, c = (x.select("ts_code").distinct().withColumn(n, F.lit(True)) for x, n in ((listed, "listed"), (members, "member"), (bar, "has_bars")))
    no = lambda n: F.coalesce(F.col(n), F.lit(False)).alias(n)
    return a.join(b, "ts_code", "full_outer").join(c, "ts_code", "full_outer").select("ts_code", no("listed"), no("member"), no("has_bars"))


def universe_coverage(dates: DataFrame, members: DataFrame, tables: dict[str, DataFrame], suspension: DataFrame | None = None, least: float = 0.95) -> DataFrame:
    """By date the members and each table's share of them; suspended members don't count for bars; passed if all reach `least`."""
    active = active_members(dates, members)
    out = active
    if suspension is not None:
        s = active_members(dates, suspension, start="suspend_date", end="resume_date").withColumn("__s", F.lit(True))
        out = out.join(s, ["trade_date", "ts_code"], "left")
    else:
        out = out.withColumn("__s", F.lit(None).cast("boolean"))
    out = out.withColumn("__s", F.coalesce("__s", F.lit(False)))
    for name, df in tables.items():
        out = out.join(df.select("trade_date", "ts_code").distinct().withColumn(f"__{name}", F.lit(1)), ["trade_date", "ts_code"], "left")
    shares = []
    for name in tables:
        counts = ~F.col("__s") if name == "daily_bar" else F.lit(True)
        shares.append(F.coalesce(F.try_divide(F.count_if(counts & F.col(f"__{name}").isNotNull()).cast("double"), F.count_if(counts).cast("double")), F.lit(1.0)).alias(name))
    g = out.groupBy("trade_date").agg(F.count("*").alias("members"), F.count_if("__s").alias("suspended"), *shares)
    worst = F.least(*(F.col(n) for n in tables), F.lit(1.0))
    return g.withColumn("passed", (F.col("members") > 0) & (worst >= least))


def benchmark_alignment(dates: DataFrame, bench: DataFrame, *others: DataFrame) -> DataFrame:
    """Each session with whether the benchmark and every other table has it."""
    out = dates.select("trade_date").distinct()
    for i, df in enumerate((bench, *others)):
        out = out.join(df.select("trade_date").distinct().withColumn(f"__{i}", F.lit(True)), "trade_date", "left")
    have = [F.coalesce(F.col(f"__{i}"), F.lit(False)) for i in range(1 + len(others))]
    together = have[0]
    for h in have[1:]:
        together = together & h
    return out.select("trade_date", have[0].alias("has_benchmark"), together.alias("aligned"))


def cross_table(bar: DataFrame, others: dict[str, DataFrame], intervals: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(check, value): share of bar keys that another table lacks, and overlapping intervals."""
    out = None
    for name, df in others.items():
        one = key_coverage(bar, df, ["trade_date", "ts_code"]).select(F.lit(f"missing_in:{name}").alias("check"), F.col("missing_share").alias("value"))
        out = one if out is None else out.unionByName(one)
    for name, (df, start, end) in intervals.items():
        one = overlapping_intervals(df, ["ts_code"], start, end).agg(F.sum("overlaps").cast("double").alias("value")).select(F.lit(f"overlaps:{name}").alias("check"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def outlier_flags(df: DataFrame, columns: list[str], most: float = 0.01, n: float = 5.0) -> DataFrame:
    """(column, outlier_rate, review): share beyond median -+ n MAD; more than `most` calls for review."""
    half = F.lit(0.5)
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("p")).select("p.*").where("x is not null")
    mid = long.groupBy("column").agg(F.percentile("x", half).alias("m"))
    dev = long.join(F.broadcast(mid), "column").withColumn("d", F.abs(F.col("x") - F.col("m")))  # a row a column
    mad = dev.groupBy("column").agg(F.percentile("d", half).alias("mad"))
    g = dev.join(F.broadcast(mad), "column").groupBy("column").agg(F.avg(((F.col("mad") > 0) & (F.col("d") > n * 1.4826 * F.col("mad"))).cast("double")).alias("outlier_rate"))
    return g.withColumn("review", F.col("outlier_rate") > most)


def member_field_coverage(members: DataFrame, dates: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], exempt: DataFrame | None = None) -> DataFrame:
    """(table, field, members, present, coverage) over historical members; exempt (table, field, ts_code) rows don't count."""
    active = active_members(dates, members)
    out = None
    for name, (df, fields) in tables.items():
        rows = active.join(df.select("trade_date", "ts_code", *fields), ["trade_date", "ts_code"], "left")
        long = rows.select("ts_code", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("ok")) for f in fields))).alias("p")).select(F.lit(name).alias("table"), "ts_code", "p.field", "p.ok")
        if exempt is not None:
            long = long.join(lookup(exempt), ["table", "field", "ts_code"], "left_anti")
        g = long.groupBy("table", "field").agg(F.count("*").alias("members"), F.count_if("ok").alias("present"))
        g = g.withColumn("coverage", F.coalesce(safe_divide("present", "members"), F.lit(1.0)))
        out = g if out is None else out.unionByName(g)
    return out


def gate(status: dict[str, bool]) -> dict:
    """Verdict of named checks: passed only if all are, with the failed ones as reasons."""
    failed = sorted(k for k, ok in status.items() if not ok)
    return {"passed": not failed, "reasons": failed}
