"""Calendar positions, as-of and interval joins, event alignment.

A calendar is a column trade_date of sessions. It is small by nature (a row a
session), so position lookups run over it alone; facts meet it by equi-joins on
dates or by as-of joins that hash on the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from ..functions.tables import written
from ..functions.windows import by_entity, keep_one
from .alike import candidates, sketched

#: Calendars of so many sessions at most are broadcast (three centuries of days); the size is counted.
MAX_CALENDAR = 80_000


def positions(calendar: DataFrame, steps: dict[str, int] | None = None) -> DataFrame:
    """Sessions with position (from 0) and, by name, the session so many steps on (NULL beyond the end)."""
    w = Window.orderBy("trade_date")
    days = calendar.select("trade_date").distinct()
    ahead = [F.lead("trade_date", k).over(w).alias(n) for n, k in (steps or {"next_date": 1}).items()]
    return days.select("trade_date", (F.row_number().over(w) - 1).cast("long").alias("position"), *ahead)


def lookup(calendar: DataFrame) -> DataFrame:
    """The calendar with a broadcast hint if it is as small as it should be; the rows counted are kept, so what made them doesn't run again."""
    kept = calendar.limit(MAX_CALENDAR + 1).persist()
    if kept.count() <= MAX_CALENDAR:
        return F.broadcast(kept)
    kept.unpersist()
    return calendar


def next_session(df: DataFrame, calendar: DataFrame, date: str, name: str = "next_session", delay: int = 1) -> DataFrame:
    """df with the delay-th session strictly after `date`, NULL at the end; date need not be a session.

    Every gap between sessions is a half-open interval with its own answer, so
    the distinct dates meet intervals and df meets dates by equality.
    """
    w = Window.orderBy("trade_date")
    days = calendar.select("trade_date").distinct()
    gaps = days.select(F.col("trade_date").alias("__from"), F.lead("trade_date").over(w).alias("__to"), F.lead("trade_date", delay).over(w).alias("__hit"))
    early = days.select(F.lit(None).cast("date").alias("__from"), F.first("trade_date").over(w).alias("__to"), F.nth_value("trade_date", delay).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__hit")).limit(1)
    gaps = lookup(gaps.unionByName(early))
    dates = df.select(F.col(date).alias("__d")).distinct().where("__d is not null")
    answers = dates.join(gaps, (F.col("__from").isNull() | (F.col("__from") <= F.col("__d"))) & (F.col("__to").isNull() | (F.col("__d") < F.col("__to"))))
    return df.join(answers.select("__d", F.col("__hit").alias(name)), F.col(date) == F.col("__d"), "left").drop("__d")


def month_end_sessions(calendar: DataFrame) -> DataFrame:
    """The last session of each month, a partial last month's too."""
    return calendar.groupBy(F.trunc("trade_date", "MM").alias("month")).agg(F.max("trade_date").alias("trade_date")).select("trade_date")


def trade_dates(calendar: DataFrame | None, bar: DataFrame) -> DataFrame:
    """Open calendar days, or the bars' dates without a calendar."""
    return bar.select("trade_date").distinct() if calendar is None else calendar.where("is_open").select("trade_date").distinct()


def attach_timing(df: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """signal_date, execution_date (next session) and target_return_end_date (horizon sessions on)."""
    ahead = lookup(positions(calendar, {"execution_date": 1, "target_return_end_date": horizon}).drop("position"))
    return df.withColumn("signal_date", F.col("trade_date")).join(ahead, "trade_date", "left")


def forward_return(df: DataFrame, price: str, horizon: int, name: str | None = None) -> DataFrame:
    """lead(price, horizon) / price - 1 over the entity's rows."""
    return df.withColumn(name or f"future_return_{horizon}", safe_divide(F.lead(price, horizon).over(by_entity()), price) - 1)


def forward_return_by_calendar(df: DataFrame, calendar: DataFrame, price: str, horizon: int, name: str | None = None) -> DataFrame:
    """As forward_return, but to the price horizon sessions on, so that it never ends after the recorded label date."""
    ahead = lookup(positions(calendar, {"__end": horizon}).drop("position"))
    later = df.select("ts_code", F.col("trade_date").alias("__end"), F.col(price).alias("__p"))
    out = df.join(ahead, "trade_date", "left").join(later, ["ts_code", "__end"], "left")
    return out.withColumn(name or f"future_return_{horizon}", safe_divide("__p", price) - 1).drop("__end", "__p")


def as_of(left: DataFrame, right: DataFrame, on: str, left_date: str, right_date: str, ties: list[Column] | None = None) -> DataFrame:
    """Each left row with the last right row of the same `on` at or before its date (whole rows, no fill by column).

    Both sides are laid out in one stream per entity and the last right row is
    carried forward, so there is one shuffle on `on` and no range condition.
    ties: order among right rows of one date, best first.
    """
    named = [c for c in right.columns if c != on]
    best = keep_one(right.where(F.col(right_date).isNotNull()), [on, right_date], ties or [F.lit(1)])
    r = best.select(on, F.col(right_date).alias("__t"), F.struct(*named).alias("__row"), F.lit(0).alias("__side"))
    l = left.select(on, F.col(left_date).alias("__t"), F.struct(*(c for c in left.columns)).alias("__left"), F.lit(1).alias("__side"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(on).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__row", F.last("__row", ignorenulls=True).over(w)).where("__side = 1")
    return seen.select("__left.*", *(F.col("__row")[c].alias(c) for c in named if c not in left.columns))


def interval_condition(date: Column, start: Column, end: Column) -> Column:
    """start <= date < end, an open end never passing."""
    return (start <= date) & (end.isNull() | (date < end))


def active_members(dates: DataFrame, member: DataFrame, entity: str = "ts_code", start: str = "in_date", end: str = "out_date") -> DataFrame:
    """(trade_date, entity) of all intervals that hold the date, by exploding each interval's months and joining on month."""
    months = F.sequence(F.trunc(F.col(start), "MM"), F.trunc(F.coalesce(F.col(end), F.col("__last")), "MM"), F.expr("interval 1 month"))
    last = dates.agg(F.max("trade_date").alias("__last"))
    m = member.join(F.broadcast(last)).where(F.trunc(F.col(start), "MM") <= F.trunc(F.coalesce(F.col(end), F.col("__last")), "MM"))
    m = m.select(entity, F.col(start).alias("__s"), F.col(end).alias("__e"), F.explode(months).alias("__month"))
    d = dates.select("trade_date", F.trunc("trade_date", "MM").alias("__month"))
    return d.join(m, "__month").where(interval_condition(F.col("trade_date"), F.col("__s"), F.col("__e"))).select("trade_date", entity).distinct()


def outside_intervals(df: DataFrame, spans: DataFrame, start: str, end: str, entity: str = "ts_code") -> DataFrame:
    """Rows that no interval of their entity holds."""
    s = spans.select(F.col(entity).alias("__e"), F.col(start).alias("__s"), F.col(end).alias("__t"))
    return df.join(s, (F.col(entity) == F.col("__e")) & interval_condition(F.col("trade_date"), F.col("__s"), F.col("__t")), "left_anti")


def event_availability(events: DataFrame, calendar: DataFrame, cutoff: str = "15:00:00") -> DataFrame:
    """available_date: the day itself if published by the cut-off on a session, else the next session; without a time the publish date."""
    days = calendar.select(F.col("trade_date").alias("__session")).distinct()
    e = next_session(events, calendar, "publish_date", "__next").join(lookup(days), F.col("publish_date") == F.col("__session"), "left")
    in_time = F.col("__session").isNotNull() & (F.date_format("publish_time", "HH:mm:ss") <= cutoff)
    return e.withColumn("available_date", F.when(F.col("publish_time").isNull(), F.col("publish_date")).when(in_time, F.col("publish_date")).otherwise(F.col("__next"))).drop("__next", "__session")


def trailing_event_sum(events: DataFrame, dates: DataFrame, value: str, days: int = 20, entity: str = "stock_code", name: str = "event_sentiment") -> DataFrame:
    """Per entity and date the sum of events available within the last `days` calendar days.

    An event is exploded to the days that it counts for and summed by day, so a
    busy entity costs its events times days + 1, and the join is on equality.
    """
    reach = F.explode(F.sequence(F.col("available_date"), F.date_add("available_date", days)))
    daily = events.where(F.col("available_date").isNotNull()).groupBy(entity, "available_date").agg(F.sum(value).alias("__v"), F.count("*").alias("__n"))
    daily = daily.select(entity, "__v", "__n", reach.alias("trade_date"))
    return daily.join(dates.select("trade_date").distinct(), "trade_date").groupBy(entity, "trade_date").agg(F.sum("__v").alias(name), F.sum("__n").alias("event_count"))


def near_pairs(events: DataFrame, days: int | None = 7, threshold: float = 0.85, entity: str = "stock_code", text: str = "content", time: str = "available_time", ident: str = "event_id") -> DataFrame:
    """Pairs of one entity within `days` (None: at any times) whose character trigrams are alike by at least `threshold`.

    All pairs of equal texts are among them: where there may be many, use near_duplicates.
    """
    rows = written(sketched(events.where(F.col(text).isNotNull()).select(entity, ident, text), text), "sketches")
    return confirmed(written(candidates(rows, threshold, entity, ident), "candidates"), events, days, threshold, entity, text, time, ident)


def confirmed(found: DataFrame, events: DataFrame, days: int | None, threshold: float, entity: str, text: str, time: str, ident: str) -> DataFrame:
    """entity, left_id, right_id, similarity of those of found (entity, a_id, b_id) that are alike on their full sets; only their texts are read again."""
    from ..functions.scalar import character_ngrams, jaccard

    one = found.select(entity, F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"))
    other = found.select(entity, F.col("b_id").alias("left_id"), F.col("a_id").alias("right_id"))
    ids = lookup(one.select(F.col("left_id").alias(ident)).unionByName(other.select(F.col("left_id").alias(ident))).distinct())
    rows = events.join(ids, ident, "left_semi").select(ident, F.col(time).alias("t"), F.transform(character_ngrams(text), lambda g: F.xxhash64(g)).alias("g"))
    left = rows.select(F.col(ident).alias("left_id"), F.col("t").alias("left_time"), F.col("g").alias("x"))
    right = rows.select(F.col(ident).alias("right_id"), F.col("t").alias("right_time"), F.col("g").alias("y"))
    if days is None:
        near = F.col("left_id") < F.col("right_id")
    else:
        near = (F.col("left_time") <= F.col("right_time")) & (F.col("right_time") <= F.col("left_time") + F.make_dt_interval(F.lit(days))) & ((F.col("left_time") < F.col("right_time")) | (F.col("left_id") < F.col("right_id")))
    pairs = one.unionByName(other).join(left, "left_id").join(right, "right_id").where(near)
    return pairs.select(entity, "left_id", "right_id", jaccard("x", "y").alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicates(events: DataFrame, days: int = 7, threshold: float = 0.85, entity: str = "stock_code", text: str = "content", time: str = "available_time", ident: str = "event_id") -> DataFrame:
    """entity, ident, class_id and links of every event: the smallest id with its text, and how many other events of the entity within `days` are alike.

    Equal texts are one class, so only different texts are compared, and copies are
    counted and never paired: for two classes that are alike, the events of one
    around each time of the other are a windowed sum over counts by class and time.
    Null texts are alike to nothing.
    """
    h = F.sha2(F.col(text).cast("binary"), 256).alias("h")
    e = events.select(entity, ident, F.col(time).cast("timestamp").alias("t"), h)
    rows = sketched(events.where(F.col(text).isNotNull()).select(entity, ident, h, text), text)
    classes = written(rows.groupBy(entity, "h").agg(F.min(ident).alias("class_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    named = e.join(classes.select(entity, "h", "class_id"), [entity, "h"], "left").drop("h")
    at = named.where("class_id is not null and t is not null").groupBy("class_id", "t").agg(F.count("*").alias("n"))
    found = written(candidates(classes, threshold, entity, "class_id"), "candidates")
    one = written(confirmed(found, events, None, threshold, entity, text, time, ident).select("left_id", "right_id"), "alike")
    both = one.unionByName(one.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))).unionByName(classes.select(F.col("class_id").alias("left_id"), F.col("class_id").alias("right_id")))
    asked = both.join(at.withColumnRenamed("class_id", "left_id"), "left_id").select("left_id", "right_id", "t", F.lit(0).alias("n"), F.lit(True).alias("asked"))
    given = both.join(at.withColumnRenamed("class_id", "right_id"), "right_id").select("left_id", "right_id", "t", "n", F.lit(False).alias("asked"))
    span = days * 86_400_000_000
    around = Window.partitionBy("left_id", "right_id").orderBy(F.unix_micros("t")).rangeBetween(-span, span)
    counted = asked.unionByName(given).withColumn("n", F.sum("n").over(around)).where("asked").groupBy(F.col("left_id").alias("class_id"), "t").agg((F.sum("n") - 1).alias("links"))
    return named.join(counted, ["class_id", "t"], "left").select(entity, ident, "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def exact_alignment(left: DataFrame, right: DataFrame, on: str = "date") -> DataFrame:
    """Inner join on dates that both sides must share; any date of one side alone raises."""
    odd = left.select(on).join(right.select(on), on, "left_anti").unionByName(right.select(on).join(left.select(on), on, "left_anti")).limit(1).count()
    if odd:
        raise ValueError("series don't have the same dates")
    return left.join(right, on)


def key_coverage(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """rows and the share of df's keys that `other` lacks."""
    have = other.select(*key).distinct().withColumn("__h", F.lit(1))
    return df.join(have, key, "left").agg(F.count("*").alias("rows"), F.avg(F.col("__h").isNull().cast("double")).alias("missing_share"))


def label_returns(labels: DataFrame, bar: DataFrame) -> DataFrame:
    """Adjusted open at execution_date to adjusted close at label_end_date, for each label date and asset of the bars."""
    o = bar.select("ts_code", F.col("trade_date").alias("execution_date"), (F.col("open") * F.col("adj_factor")).alias("__o"))
    c = bar.select("ts_code", F.col("trade_date").alias("label_end_date"), (F.col("close") * F.col("adj_factor")).alias("__c"))
    here = bar.select("ts_code", F.col("trade_date").alias("signal_date"))
    out = here.join(lookup(labels.select("signal_date", "execution_date", "label_end_date", "availability_date")), "signal_date")
    out = out.join(o, ["ts_code", "execution_date"], "left").join(c, ["ts_code", "label_end_date"], "left")
    return out.select("ts_code", "signal_date", "execution_date", "label_end_date", "availability_date", (safe_divide("__c", "__o") - 1).alias("label_return"))


def monthly_labels(calendar: DataFrame, holdout_start: str | None = None) -> DataFrame:
    """signal (month end), execution (next session), label end (next month end), availability (session after); adjacent months, none past the holdout."""
    steps = lookup(positions(calendar, {"execution_date": 1}).drop("position"))
    w = Window.orderBy("trade_date")
    ends = month_end_sessions(calendar).select("trade_date", F.lead("trade_date").over(w).alias("label_end_date"))
    out = ends.join(steps, "trade_date").join(steps.toDF("label_end_date", "availability_date"), "label_end_date")
    out = out.where(F.trunc("label_end_date", "MM") == F.add_months(F.trunc("trade_date", "MM"), 1)).where("trade_date < execution_date and execution_date <= label_end_date and label_end_date < availability_date")
    if holdout_start is not None:
        out = out.where(F.col("availability_date") < F.to_date(F.lit(holdout_start)))
    return out.select(F.col("trade_date").alias("signal_date"), "execution_date", "label_end_date", "availability_date")


def assert_point_in_time(df: DataFrame, usable: str = "usable_date", signal: str = "signal_date") -> DataFrame:
    if df.where(F.col(usable) > F.col(signal)).limit(1).count():
        raise ValueError(f"{usable} after {signal}")
    return df
