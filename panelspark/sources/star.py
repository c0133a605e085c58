"""Standard tables out of a star schema of orders and line items, so that every operator has data to run on.

Money is summed in whole cents and quantities in whole units, so sums don't
depend on the order in which rows are added up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide


class Star:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def code(c: str):
        return F.lpad(F.col(c).cast("string"), 6, "0")

    def lines(self) -> DataFrame:
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        return self.raw("lineitem").select(
            F.trunc("l_shipdate", "MM").alias("trade_date"), self.code("l_suppkey").alias("ts_code"), cents.alias("cents"), F.col("l_quantity").cast("bigint").alias("qty"),
            F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"), F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"), "l_returnflag",
        )

    def months(self) -> DataFrame:
        """Whole sums of the line items for each supplier and month; members, amounts and reports are sums of these, so one pass over the line items serves them all."""
        return self.lines().groupBy("trade_date", "ts_code").agg(*(F.sum(c).alias(c) for c in ("cents", "qty", "disc", "tax")), F.count("*").alias("n"))

    def bar(self) -> DataFrame:
        """A bar for each supplier and month."""
        unit = F.col("cents") / F.lit(100.0) / F.col("qty")
        g = self.lines().groupBy("trade_date", "ts_code").agg(F.sum("cents").alias("c"), F.sum("qty").alias("volume"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.percentile(unit, F.lit(0.5)).alias("open"))
        return g.select("trade_date", "ts_code", "open", "high", "low", (F.col("c") / F.lit(100.0) / F.col("volume")).alias("close"), "volume", (F.col("c") / F.lit(100.0)).alias("amount"), F.lit(1.0).alias("adj_factor"))

    def calendar(self) -> DataFrame:
        return self.raw("lineitem").select(F.trunc("l_shipdate", "MM").alias("trade_date")).distinct()

    def industry(self) -> DataFrame:
        n = self.raw("nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("industry_code"))
        return self.raw("supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(self.code("s_suppkey").alias("ts_code"), "industry_code")

    def basic(self) -> DataFrame:
        g = self.lines().groupBy("trade_date", "ts_code").agg(F.sum("qty").alias("v"), F.sum("tax").alias("t"), F.sum("disc").alias("d"), F.count("*").alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", -F.col("cents")).otherwise(F.col("cents"))).alias("flow"))
        whole = F.sum("v").over(Window.partitionBy("ts_code"))
        out = g.select("trade_date", "ts_code", (F.lit(1.0) + F.col("t") / F.lit(10.0) / F.col("n")).alias("pb"), (F.lit(1.0) + F.col("d") / F.lit(1.0) / F.col("n")).alias("pe_ttm"), (F.col("v").cast("double") / whole).alias("turnover_rate"), (F.col("flow") / F.lit(100.0)).alias("net_mf_amount"))
        s = self.raw("supplier").select(self.code("s_suppkey").alias("ts_code"), F.col("s_acctbal").alias("total_mv"))
        return out.join(s, "ts_code")

    def financial(self, months: DataFrame | None = None) -> DataFrame:
        rows = self.lines().withColumn("n", F.lit(1)) if months is None else months
        q = rows.withColumn("report_period", F.last_day(F.add_months(F.trunc("trade_date", "quarter"), 2)))
        g = q.groupBy("ts_code", "report_period").agg(F.sum("disc").alias("d"), F.sum("tax").alias("t"), F.sum("cents").alias("c"), F.sum("n").alias("n"))
        out = g.select("ts_code", "report_period", F.date_add("report_period", 30).alias("ann_date"), (F.col("d") / F.lit(100.0) / F.col("n")).alias("roe"), (1.0 - F.col("t") / F.lit(100.0) / F.col("n")).alias("gross_margin"), (F.col("t") / F.lit(100.0) / F.col("n")).alias("debt_ratio"), (F.col("c") / F.lit(100.0)).alias("total_assets"))
        return out.withColumn("usable_date", F.add_months(F.trunc("ann_date", "MM"), 1))

    def member(self, months: DataFrame | None = None) -> DataFrame:
        b = (self.lines() if months is None else months).groupBy("ts_code").agg(F.min("trade_date").alias("in_date"), F.max("trade_date").alias("last"))
        end = b.select(F.max("last").alias("end"))
        return b.join(F.broadcast(end)).select("ts_code", "in_date", F.when(F.col("last") < F.col("end"), F.col("last")).alias("out_date"))

    def benchmark(self) -> DataFrame:
        g = self.lines().groupBy("trade_date").agg(F.sum("cents").alias("c"), F.sum("qty").alias("q"))
        return g.select("trade_date", (F.col("c") / F.lit(100.0) / F.col("q")).alias("close"))

    def news(self) -> DataFrame:
        sentiment = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
        return self.raw("events").select("event_id", self.code("user_id").alias("stock_code"), F.col("ts").alias("publish_time"), F.col("ts").cast("date").alias("publish_date"), "event_type", sentiment.alias("sentiment"), F.least(F.col("value") / 500.0, F.lit(1.0)).alias("confidence"))

    def text_events(self) -> DataFrame:
        t = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 30 as int))")
        return self.raw("documents").select(F.col("doc_id").alias("event_id"), F.col("source").alias("stock_code"), F.col("text").alias("content"), t.alias("available_time"))

    def returns(self) -> DataFrame:
        """Bars with ret (against the row before) and fwd (to the next row)."""
        w = Window.partitionBy("ts_code").orderBy("trade_date")
        b = self.bar()
        return b.withColumn("ret", safe_divide("close", F.lag("close").over(w)) - 1).withColumn("fwd", safe_divide(F.lead("close").over(w), "close") - 1)


#: The same tables as common table expressions for DuckDB.
CTES = {
    "lines": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS ts_code, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax, l_returnflag FROM lineitem",
    "bar": "SELECT trade_date, ts_code, quantile_cont(cents / 100.0::DOUBLE / qty, 0.5) AS open, max(cents / 100.0::DOUBLE / qty) AS high, min(cents / 100.0::DOUBLE / qty) AS low, sum(cents)::DOUBLE / 100.0::DOUBLE / sum(qty)::DOUBLE AS close, CAST(sum(qty) AS BIGINT) AS volume, sum(cents)::DOUBLE / 100.0::DOUBLE AS amount, 1.0::DOUBLE AS adj_factor FROM lines GROUP BY trade_date, ts_code",
    "calendar": "SELECT DISTINCT trade_date FROM lines",
    "industry": "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS ts_code, CAST(n_regionkey AS VARCHAR) AS industry_code FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "basic": "SELECT g.*, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') IS NOT NULL AS has_mv, s_acctbal AS total_mv FROM (SELECT trade_date, ts_code, 1.0::DOUBLE + sum(tax)::DOUBLE / 10.0::DOUBLE / count(*) AS pb, 1.0::DOUBLE + sum(disc)::DOUBLE / 1.0::DOUBLE / count(*) AS pe_ttm, sum(qty)::DOUBLE / (sum(sum(qty)) OVER (PARTITION BY ts_code))::DOUBLE AS turnover_rate, sum(CASE WHEN l_returnflag = 'R' THEN -cents ELSE cents END)::DOUBLE / 100.0::DOUBLE AS net_mf_amount FROM lines GROUP BY trade_date, ts_code) g JOIN supplier ON ts_code = lpad(CAST(s_suppkey AS VARCHAR), 6, '0')",
    "financial": "SELECT ts_code, report_period, report_period + 30 AS ann_date, d, t, c, n, d / 100.0::DOUBLE / n AS roe, 1.0::DOUBLE - t / 100.0::DOUBLE / n AS gross_margin, t / 100.0::DOUBLE / n AS debt_ratio, c / 100.0::DOUBLE AS total_assets, CAST(date_trunc('month', report_period + 30) + INTERVAL 1 MONTH AS DATE) AS usable_date FROM (SELECT ts_code, CAST(last_day(CAST(date_trunc('quarter', trade_date) + INTERVAL 2 MONTH AS DATE)) AS DATE) AS report_period, sum(disc)::DOUBLE AS d, sum(tax)::DOUBLE AS t, sum(cents)::DOUBLE AS c, count(*) AS n FROM lines GROUP BY 1, 2)",
    "member": "SELECT ts_code, in_date, CASE WHEN last < max(last) OVER () THEN last END AS out_date FROM (SELECT ts_code, min(trade_date) AS in_date, max(trade_date) AS last FROM lines GROUP BY ts_code)",
    "bench": "SELECT trade_date, sum(cents)::DOUBLE / 100.0::DOUBLE / sum(qty)::DOUBLE AS close FROM lines GROUP BY trade_date",
    "news": "SELECT event_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS stock_code, ts AS publish_time, CAST(ts AS DATE) AS publish_date, event_type, CASE WHEN event_type = 'purchase' THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment, least(value / 500.0, 1.0) AS confidence FROM events",
    "texts": "SELECT doc_id AS event_id, source AS stock_code, text AS content, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER)) AS available_time FROM documents",
    "returns": "SELECT *, close / lag(close) OVER w - 1 AS ret, lead(close) OVER w / close - 1 AS fwd FROM bar WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)",
}
_NEEDS = {"bar": ["lines"], "calendar": ["lines"], "basic": ["lines"], "financial": ["lines"], "member": ["lines"], "bench": ["lines"], "returns": ["lines", "bar"]}


def with_tables(sql: str, *names: str) -> str:
    """sql (its own CTEs may follow) over the named tables."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {sql[15:].lstrip()}"
    return f"WITH {head}, {sql[5:].lstrip()}" if sql.upper().startswith("WITH ") else f"WITH {head} {sql}"
