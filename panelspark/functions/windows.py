"""Ordered analytics over an entity's rows: rolling statistics with a least count, ranks, runs, drawdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import col, safe_divide


def by_entity(entity="ts_code", order="trade_date"):
    entity = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*entity).orderBy(order)


def rolling(agg, x, n: int, least: int | None = None, over=None) -> Column:
    """agg over the last n rows, NULL with fewer than `least` (default n) values among them."""
    frame = (over if over is not None else by_entity()).rowsBetween(-(n - 1), 0)
    x = col(x)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), agg(x).over(frame))


def lagged_return(price, n: int, skip: int = 0, over=None) -> Column:
    """price (skip rows ago) / price (n rows ago) - 1."""
    w = over if over is not None else by_entity()
    now = F.lag(price, skip).over(w) if skip else col(price)
    return safe_divide(now, F.lag(price, n).over(w)) - 1


#: Tasks, at least, among which dealt() puts groups that are sorted whole.
RANK_TASKS = 200


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df by keys in RANK_TASKS or spark.sql.shuffle.partitions tasks, whichever is more, for windows over the same keys.

    Left alone, adaptive execution joins groups up to a size that it counts
    compressed, and one task sorts tens of them at once.
    """
    return df.repartition(max(RANK_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def average_rank(x, partition: list[str], ascending: bool = True) -> Column:
    """Rank where ties share their mean rank; NULL for NULL. Rank and ties share one sort and one partitioning."""
    x = col(x)
    w = Window.partitionBy(*partition).orderBy(x.asc_nulls_last() if ascending else x.desc_nulls_last())
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(w) + (ties - 1) / 2.0)


def global_average_ranks(df: DataFrame, columns: list[str], keys: list[str], buckets: int = 64) -> DataFrame:
    """keys and the average-tie rank of each column over all rows, NULL for NULL; rows without any value are left out. keys tell rows apart.

    All columns go through one plan in long form. No task sorts a whole column:
    equal values are counted first, the distinct ones are ranked within value
    ranges (bounds from approximate quantiles, and any bounds give the same ranks),
    and ranges are offset by the counts below them, `buckets` numbers a column.
    """
    bounds = df.approxQuantile(columns, [i / buckets for i in range(1, buckets)], 0.005)
    edges = F.array(*(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>") for cuts in bounds))
    long = df.select(*keys, F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("__c", "__v")).where("__v is not null")
    counts = long.groupBy("__c", "__v").agg(F.count("*").alias("__n")).withColumn("__b", F.size(F.filter(F.get(edges, "__c"), lambda b: F.col("__v") > b)))
    sizes = {(r["__c"], r["__b"]): r["n"] for r in counts.groupBy("__c", "__b").agg(F.sum("__n").alias("n")).collect()}
    offsets = []
    for c in range(len(columns)):
        seen = 0
        for b in range(buckets):
            offsets.append((c, b, float(seen)))
            seen += sizes.get((c, b), 0)
    below = F.broadcast(df.sparkSession.createDataFrame(offsets, "__c int, __b int, __o double"))  # `buckets` rows a column
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__c", "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("__r", before + (F.col("__n") + 1) / 2.0).join(below, ["__c", "__b"]).select("__c", "__v", (F.col("__r") + F.col("__o")).alias("__r"))
    wide = long.join(ranked, ["__c", "__v"]).groupBy(*keys).agg(*(F.max(F.when(F.col("__c") == i, F.col("__r"))).alias(c) for i, c in enumerate(columns)))
    return wide


def percent_rank_average(x, partition: list[str]) -> Column:
    return average_rank(x, partition) / F.count(col(x)).over(Window.partitionBy(*partition))


def first_rank_bucket(x, q: int, partition: list[str], tie: str, base: int = 1, least_distinct: int = 0) -> Column:
    """Equal-width buckets of first-occurrence ranks: greatest(1, ceil((rn-1)*q/(n-1))), in whole numbers.

    base: the lowest bucket's number. Fewer than least_distinct distinct values give NULL.
    """
    x = col(x)
    w = Window.partitionBy(*partition).orderBy(x.asc_nulls_last(), tie)
    n, rn = F.count(x).over(Window.partitionBy(*partition)), F.row_number().over(w)
    bucket = F.greatest(F.lit(1), F.floor(((rn - 1) * q + F.greatest(n - 2, F.lit(0))) / F.greatest(n - 1, F.lit(1)))).cast("int") + (base - 1)
    ok = x.isNotNull()
    if least_distinct:
        up, down = (F.dense_rank().over(Window.partitionBy(*partition).orderBy(o)) for o in (x.asc_nulls_last(), x.desc_nulls_last()))
        ok = ok & (up + down - 1 >= least_distinct)  # the number of distinct values, without gathering them
    return F.when(ok, bucket)


def ewma_last(values, alpha: float) -> Column:
    """Last value of an exponentially weighted mean (no bias adjustment) of an ordered array."""
    values = col(values)
    step = lambda acc, x: F.when(acc.isNull(), x).otherwise((1 - alpha) * acc + alpha * x)
    return F.aggregate(values, F.lit(None).cast("double"), step)


def cumulative_return(r, over) -> Column:
    """Compounded 1 + r up to the row, by logs; a total loss or worse gives 0 from there on."""
    r = F.coalesce(col(r), F.lit(0.0))
    frame = over.rowsBetween(Window.unboundedPreceding, 0)
    grown = F.exp(F.sum(F.log1p(F.greatest(r, F.lit(-0.999999999)))).over(frame))
    return F.when(F.min(r).over(frame) <= -1, 0.0).otherwise(grown)


def drawdown(nav, over) -> Column:
    nav = col(nav)
    return safe_divide(nav, F.max(nav).over(over.rowsBetween(Window.unboundedPreceding, 0))) - 1


def drawdown_episodes(df: DataFrame, nav: str = "nav", date: str = "date", series: list[str] | None = None, top: int | None = None) -> DataFrame:
    """start (last peak), trough, recovery (NULL while open), depth and duration in rows, deepest first."""
    series = series or []
    w = Window.partitionBy(*series).orderBy(date)
    rows = df.select(*series, F.col(date).alias("d"), drawdown(nav, w).alias("dd"), F.row_number().over(w).alias("rn"))
    w = Window.partitionBy(*series).orderBy("d")
    rows = rows.withColumn("peak", F.sum((F.col("dd") >= 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.col("dd") < 0
    spans = rows.groupBy(*series, "peak").agg(
        F.min("d").alias("start"), F.min_by("d", F.when(inside, F.struct("dd", "d"))).alias("trough"), F.min("dd").alias("depth"), F.min("rn").alias("first"), F.max("rn").alias("last"),
    )
    after = rows.where(F.col("dd") >= 0).select(*series, F.col("peak").alias("next"), F.col("d").alias("recovery"))
    joined = spans.where("depth < 0").withColumn("next", F.col("peak") + 1).join(after, [*series, "next"], "left")
    length = F.col("last") - F.col("first") + F.when(F.col("recovery").isNotNull(), 1).otherwise(0)
    out = joined.select(*series, "start", "trough", "recovery", "depth", length.cast("long").alias("duration"))
    if top is not None:
        out = out.withColumn("__r", F.row_number().over(Window.partitionBy(*series).orderBy("depth", "start"))).where(F.col("__r") <= top).drop("__r")
    return out


def longest_run(df: DataFrame, is_hit: Column, entity: list[str], order: str, name: str = "longest") -> DataFrame:
    """Longest run of consecutive rows with is_hit, 0 without any."""
    w, both = Window.partitionBy(*entity).orderBy(order), Window.partitionBy(*entity, "hit").orderBy(order)
    rows = df.select(*entity, order, F.coalesce(is_hit, F.lit(False)).alias("hit"))
    rows = rows.withColumn("island", F.row_number().over(w) - F.row_number().over(both))
    runs = rows.groupBy(*entity, "hit", "island").count()
    return runs.groupBy(*entity).agg(F.coalesce(F.max(F.when(F.col("hit"), F.col("count"))), F.lit(0)).alias(name))


def overlapping_intervals(df: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    """Per entity the number of intervals that start before an earlier one has ended; open ends never end."""
    w = Window.partitionBy(*entity).orderBy(start, F.coalesce(F.col(end), F.to_date(F.lit("9999-12-31"))))
    ended = F.max(F.coalesce(F.col(end), F.to_date(F.lit("9999-12-31")))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__o", F.col(start) < ended).groupBy(*entity).agg(F.count_if("__o").alias("overlaps"))


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def membership_turnover(df: DataFrame, group: list[str], date: str, member: str, first: float | None = None) -> DataFrame:
    """1 - |A n B| / |A u B| against the group's previous date; `first` for its first date."""
    sets = df.groupBy(*group, date).agg(F.collect_set(member).alias("s"))
    before = F.lag("s").over(Window.partitionBy(*group).orderBy(date))
    both = F.size(F.array_intersect("s", "b"))
    share = 1 - F.try_divide(both.cast("double"), (F.size("s") + F.size("b") - both).cast("double"))
    return sets.withColumn("b", before).select(*group, date, F.size("s").cast("long").alias("n"), F.when(F.col("b").isNotNull(), share).otherwise(F.lit(first).cast("double")).alias("turnover"))


def trailing_means(df: DataFrame, value: str, keys: list[str], order: str, sizes: tuple[int, ...] = (12, 24)) -> DataFrame:
    """df with lag_1, expanding_mean and mean_n of the rows before each row."""
    w = Window.partitionBy(*keys).orderBy(order)
    means = {f"mean_{n}": F.avg(value).over(w.rowsBetween(-n, -1)) for n in sizes}
    return df.withColumns({"lag_1": F.lag(value).over(w), "expanding_mean": F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, -1))} | means)
