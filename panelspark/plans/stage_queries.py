"""Unit roots, regimes and volatility by rebalance date, residual tests, baselines before a holdout."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from ..functions.tables import written
from ..operators import coverage as G
from ..operators import evaluation as E
from ..operators import joins as J
from ..operators import model_stages as S
from ..operators import processing as X
from ..operators import unit_roots as U
from ..sources import batches as C
from ..sources.star import CTES, Star
from ..streaming import online as O
from . import monthly as P
from .model_queries import benchmark_returns, drained, news_stream, shared_folder
from .registry import query
from .research_queries import _ERFC, _RANKS, FACTORS, LONG, PANEL, TABLES, long, panel

_BRET = "b AS (SELECT trade_date AS date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS ret FROM bench)"


def standard(s: Star) -> DataFrame:
    market = s.bar().select("trade_date", "ts_code", "amount").join(s.basic().select("trade_date", "ts_code", "turnover_rate"), ["trade_date", "ts_code"], "left")
    return S.standard_series(s.returns(), market, benchmark_returns(s).select(F.col("date").alias("trade_date"), "ret"))


@query("standard_series", "returns basic bench", f"WITH {_BRET}, d AS (SELECT trade_date, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS breadth, stddev_samp(ret) AS dispersion FROM returns WHERE ret IS NOT NULL GROUP BY 1), m AS (SELECT bar.trade_date, quantile_cont(amount, 0.5) AS amount, quantile_cont(turnover_rate, 0.5) AS median_turnover FROM bar LEFT JOIN basic ON bar.trade_date = basic.trade_date AND bar.ts_code = basic.ts_code GROUP BY 1), j AS (SELECT d.trade_date, breadth, dispersion, median_turnover, ln(1 + greatest(ret, -0.999999)) AS benchmark_log_return, ln(nullif(amount, 0)) AS log_median_amount FROM d LEFT JOIN m USING (trade_date) LEFT JOIN b ON b.date = d.trade_date) SELECT *, CASE WHEN count(benchmark_log_return) OVER w >= 10 THEN stddev_samp(benchmark_log_return) OVER w * sqrt(252.0) END AS realized_volatility_20 FROM j WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "breadth dispersion median_turnover benchmark_log_return log_median_amount realized_volatility_20")
def standard_series(s: Star) -> DataFrame:
    return standard(s)


def series_of(s: Star) -> DataFrame:
    """(series, date, value) of the standard series, in long form."""
    names = ["breadth", "dispersion", "log_median_amount", "median_turnover", "benchmark_log_return", "realized_volatility_20"]
    return standard(s).select(F.col("trade_date").alias("date"), F.explode(F.array(*(F.struct(F.lit(n).alias("series"), F.col(n).alias("value")) for n in names))).alias("p")).select("date", "p.*")


@query("unit_root_tests")
def unit_root_tests(s: Star) -> DataFrame:
    return U.diagnostics(series_of(s)).drop("origin")


@query("unit_root_tests_by_origin")
def unit_root_tests_by_origin(s: Star) -> DataFrame:
    return U.diagnostics(series_of(s), origins=s.calendar().select(F.col("trade_date").alias("origin")))


# Residuals of a constant variance and of the last twelve returns' variance, by entity; two lags, so R2 has a closed form.
_Z = "z AS (SELECT ts_code, 'constant' AS model, trade_date, ret AS z FROM returns WHERE ret IS NOT NULL UNION ALL SELECT ts_code, 'rolling_12', trade_date, CASE WHEN n >= 6 AND v > 0 THEN ret / v END FROM (SELECT *, stddev_samp(ret) OVER w AS v, count(ret) OVER w AS n FROM returns WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)))"


@query("residual_arch", "returns", f"WITH {_Z}, l AS (SELECT ts_code, model, z * z AS s, lag(z * z, 1) OVER w AS a, lag(z * z, 2) OVER w AS b FROM z WHERE z IS NOT NULL WINDOW w AS (PARTITION BY ts_code, model ORDER BY trade_date)), c AS (SELECT ts_code, model, count(*) AS n, corr(s, a) AS p, corr(s, b) AS q, corr(a, b) AS r FROM l WHERE b IS NOT NULL GROUP BY 1, 2), t AS (SELECT ts_code, model, n, (p * p + q * q - 2 * p * q * r) / (1 - r * r) AS r2 FROM c) SELECT *, n * r2 AS lm, exp(-n * r2 / 2) AS p_value FROM t", "r2 lm p_value")
def residual_arch(s: Star) -> DataFrame:
    r = s.returns().where("ret is not null").select("ts_code", "trade_date", "ret")
    w = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(-12, -1)
    v, n = F.stddev_samp("ret").over(w), F.count("ret").over(w)
    rolling = r.select("ts_code", "trade_date", F.lit("rolling_12").alias("model"), F.when(n >= 6, safe_divide(F.col("ret"), F.when(v > 0, v))).alias("z"))
    both = r.select("ts_code", "trade_date", F.lit("constant").alias("model"), F.col("ret").alias("z")).unionByName(rolling)
    return S.residual_arch(both, ["ts_code", "model"], "trade_date", "z", 2)


@query("market_residual_arch", "bench", f"WITH {_BRET}, l AS (SELECT ret * ret AS s, lag(ret * ret, 1) OVER (ORDER BY date) AS a FROM b WHERE ret IS NOT NULL), c AS (SELECT count(*) AS n, corr(s, a) AS p FROM l WHERE a IS NOT NULL), t AS (SELECT n, p * p AS r2, sqrt(n * p * p) / sqrt(2.0) AS z FROM c) SELECT 'benchmark' AS series, n, r2, n * r2 AS lm, {_ERFC} AS p_value FROM (SELECT *, 1.0 / (1.0 + 0.5 * z) AS u FROM t)", "r2 lm p_value")
def market_residual_arch(s: Star) -> DataFrame:
    return S.residual_arch(benchmark_returns(s), ["series"], "date", "ret", 1)


@query("historical_volatility_stage", "bench calendar", f"WITH {_BRET}, r AS (SELECT * FROM b WHERE ret IS NOT NULL), f AS (SELECT c.trade_date AS as_of, (SELECT max(date) FROM r WHERE date < c.trade_date) AS training_end, (SELECT min(date) FROM r WHERE date >= c.trade_date) AS target, (SELECT count(*) FROM r WHERE date < c.trade_date) AS n, (SELECT quantile_cont(abs(ret), 0.95) FROM r WHERE date < c.trade_date) AS edge FROM calendar c), m AS (SELECT f.*, k, CASE WHEN n >= k THEN (SELECT var_samp(ret) FROM (SELECT ret FROM r WHERE date < f.as_of ORDER BY date DESC LIMIT 20) AS x) END AS v20, CASE WHEN n >= k THEN (SELECT var_samp(ret) FROM (SELECT ret FROM r WHERE date < f.as_of ORDER BY date DESC LIMIT 60) AS y) END AS v60 FROM f, (VALUES (20), (60)) AS w(k)), v AS (SELECT m.*, CASE k WHEN 20 THEN v20 ELSE v60 END AS variance, t.ret * t.ret AS actual, coalesce(abs(t.ret) >= edge, false) AS extreme FROM m LEFT JOIN r t ON t.date = m.target) SELECT 'benchmark' AS series, as_of, training_end, target, 'historical_' || k AS model, n, CASE WHEN n >= k THEN 'ok' ELSE 'insufficient_history' END AS status, variance, sqrt(12 * variance) AS annual_volatility, actual, actual - variance AS error, abs(actual - variance) AS absolute_error, ln(variance) + actual / variance AS qlike, extreme FROM v", "variance annual_volatility actual error absolute_error qlike", digits=9)
def historical_volatility_stage(s: Star) -> DataFrame:
    return S.volatility_stage(benchmark_returns(s), s.calendar(), models=("historical_20", "historical_60"), per_year=12).drop("arch_lm_p")


@query("volatility_stage_comparison")
def volatility_stage_comparison(s: Star) -> DataFrame:
    return S.volatility_comparison(S.volatility_stage(benchmark_returns(s), s.calendar(), least=36, models=("historical_20", "historical_60", "ewma", "gjr_grid", "garch", "gjr"), per_year=12), per_year=12)


def fits(s: Star) -> DataFrame:
    v = standard(s).select(F.col("trade_date").alias("date"), F.last_day("trade_date").alias("available"), F.col("benchmark_log_return").alias("return"), F.col("realized_volatility_20").alias("volatility"), "breadth", F.col("log_median_amount").alias("liquidity"))
    return S.regime_fits(S.monthly_variables(v), s.calendar())


@query("regime_stage_probabilities")
def regime_stage_probabilities(s: Star) -> DataFrame:
    return S.regime_probabilities(fits(s))


@query("regime_stage_transitions")
def regime_stage_transitions(s: Star) -> DataFrame:
    f = fits(s)
    durations = S.regime_durations(f).select("as_of", "model", F.col("state").alias("from_state"), "expected_duration")
    return S.regime_transitions(f).join(durations, ["as_of", "model", "from_state"])


@query("regime_stage_stability")
def regime_stage_stability(s: Star) -> DataFrame:
    return S.regime_stability(fits(s))


@query("regime_stage_performance")
def regime_stage_performance(s: Star) -> DataFrame:
    g = E.group_returns(long(s, "fwd"), "fwd").select(F.col("trade_date").alias("date"), F.last_day(F.add_months("trade_date", 1)).alias("available"), "factor", F.col("spread").alias("ret"))
    return S.regime_performance(fits(s), g)


_BASE = "o AS (SELECT date, last_day(date) AS available, ret AS x, row_number() OVER (ORDER BY date) AS k FROM b WHERE ret IS NOT NULL AND last_day(date) < DATE '2001-01-01'), p AS (SELECT t.date AS target, t.available, t.x AS actual, l.date AS origin, l.x AS lag_1, (SELECT avg(x) FROM o WHERE k < t.k) AS historical_mean, (SELECT avg(x) FROM o WHERE k < t.k AND k >= t.k - 12) AS rolling_12, (SELECT avg(x) FROM o WHERE k < t.k AND k >= t.k - 24) AS rolling_24, (SELECT list_reduce(list(x ORDER BY k), lambda a, c: 0.8 * a + 0.2 * c) FROM o WHERE k < t.k) AS ewma, (SELECT regr_intercept(c.x, a.x) + regr_slope(c.x, a.x) * l.x FROM o a JOIN o c ON c.k = a.k + 1 WHERE c.k < t.k) AS ar_1 FROM o t JOIN o l ON l.k = t.k - 1 WHERE t.k > 12)"


@query("baseline_window", "bench", f"WITH {_BRET}, {_BASE} SELECT 'benchmark' AS series, model, origin AS train_end, origin, target, available, forecast, actual FROM p UNPIVOT (forecast FOR model IN (lag_1, historical_mean, rolling_12, rolling_24, ewma, ar_1)) WHERE target BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'", "forecast actual")
def baseline_window(s: Star) -> DataFrame:
    series = benchmark_returns(s).select("series", "date", F.last_day("date").alias("available"), F.col("ret").alias("value"))
    f = S.baseline_stage(series, dt.date(1996, 1, 1), dt.date(2000, 6, 30), dt.date(2001, 1, 1))
    return S.guarded(f, S.forecast_is_late(), "baselines", f"{shared_folder(s)}/baselines")


# ---------------------------------------------------------------- streams

_SESSIONS = "c AS (SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM events WHERE dayofweek(ts) NOT IN (0, 6))"


def weekdays(s: Star) -> DataFrame:
    """The events' working days as a calendar."""
    return s.raw("events").select(F.to_date("ts").alias("trade_date")).where(~F.dayofweek("trade_date").isin(1, 7)).distinct()


@query("stream_available_sessions", "news", f"WITH {_SESSIONS}, e AS (SELECT event_id, stock_code, publish_time, publish_date, EXISTS (FROM c WHERE c.trade_date = publish_date) AS open, (SELECT min(trade_date) FROM c WHERE c.trade_date > publish_date) AS following FROM news) SELECT event_id, stock_code, CASE WHEN open AND strftime(publish_time, '%H:%M:%S') <= '15:00:00' THEN publish_date ELSE following END AS available_date FROM e")
def stream_available_sessions(s: Star) -> DataFrame:
    e = news_stream(s).withColumn("publish_time", F.col("publish_time").cast("timestamp")).withColumn("publish_date", F.to_date("publish_time"))
    return drained(s, O.available_sessions(e, weekdays(s), late="30 days").select("event_id", "stock_code", "available_date"))


@query("stream_of_batches", sql="SELECT o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'b1' ELSE 'b2' END AS batch_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY ALL")
def stream_of_batches(s: Star) -> DataFrame:
    """Two committed batches as a stream into an idempotent sink, drained twice from nothing: the replay changes nothing."""
    folder, o = shared_folder(s), s.raw("orders").select("o_orderkey", "o_orderstatus")
    parameters = {"provider": "star", "start_date": "1992-01-01", "end_date": "1998-12-31", "symbols": []}
    for name, part in (("b1", o.where("o_orderkey % 2 = 0")), ("b2", o.where("o_orderkey % 2 != 0"))):
        C.fetch(s.spark, f"{folder}/raw/{name}", {"orders": lambda part=part: part}, parameters)
    s.spark.dataSource.register(O.EpochSink)
    for run in ("first", "again"):
        rows = O.batch_stream(s.spark, f"{folder}/raw", "orders", o.schema)
        rows.writeStream.format("epoch_sink").option("folder", f"{folder}/out").option("checkpointLocation", f"{folder}/{run}").trigger(availableNow=True).start().awaitTermination()
    return O.epochs(s.spark, f"{folder}/out", rows.schema).groupBy("o_orderstatus", "batch_id").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("online_levels", "", f"WITH RECURSIVE news AS ({CTES['news']}), v AS (SELECT stock_code AS series, confidence AS x, row_number() OVER (PARTITION BY stock_code ORDER BY publish_time) AS k FROM news WHERE confidence IS NOT NULL), f AS (SELECT series, k, x AS level, (0.1 + 0.001) * 0.01 / (0.1 + 0.001 + 0.01) AS p FROM v WHERE k = 1 UNION ALL SELECT v.series, v.k, f.level + (f.p + 0.001) / (f.p + 0.001 + 0.01) * (v.x - f.level), (f.p + 0.001) * 0.01 / (f.p + 0.001 + 0.01) FROM f JOIN v ON v.series = f.series AND v.k = f.k + 1) SELECT series, CAST(k AS BIGINT) AS observations, level AS forecast, p + 0.001 + 0.01 AS variance FROM f", "forecast variance")
def online_levels(s: Star) -> DataFrame:
    """Forecasts and variances after each row; no two rows of a series have one time there."""
    own = Star(s.spark.newSession(), s.dir)
    own.spark.conf.set("spark.sql.streaming.stateStore.providerClass", O.ROCKSDB)
    values = news_stream(own).where("confidence is not null").select(F.col("stock_code").alias("series"), F.col("publish_time").cast("timestamp").alias("at"), F.col("confidence").alias("value"))
    at = f"{shared_folder(s)}/levels"
    out = O.online_levels(values, late="40 days")
    out.writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{at}/rows/batch={n}")).start().awaitTermination()
    return s.spark.read.schema(out.schema).parquet(f"{at}/rows").where("accepted").select("series", "observations", "forecast", "variance")


# ---------------------------------------------------------------- coverage


@query("historical_member_coverage", "calendar member bar financial industry", "WITH a AS (SELECT c.trade_date, m.ts_code FROM calendar c JOIN member m ON m.in_date <= c.trade_date AND (m.out_date IS NULL OR c.trade_date < m.out_date)), s AS (SELECT ts_code, in_date + 200 AS b, in_date + 400 AS e FROM member WHERE CAST(ts_code AS INT) % 5 = 1), f AS (SELECT ts_code, usable_date, CASE WHEN month(report_period) <> 3 THEN roe END AS roe, gross_margin FROM financial), j AS (SELECT a.trade_date, CAST(a.ts_code AS INT) AS code, s.ts_code IS NOT NULL AS off, CASE WHEN CAST(a.ts_code AS INT) % 7 <> 0 THEN bar.amount END AS amount, bar.close, industry_code = '3' AS free, f.roe, f.gross_margin FROM a LEFT JOIN s ON s.ts_code = a.ts_code AND s.b <= a.trade_date AND a.trade_date < s.e LEFT JOIN bar ON bar.trade_date = a.trade_date AND bar.ts_code = a.ts_code LEFT JOIN industry i ON i.ts_code = a.ts_code ASOF LEFT JOIN f ON f.ts_code = a.ts_code AND f.usable_date <= a.trade_date), x AS (SELECT trade_date, 'daily_bar' AS \"table\", 'amount' AS field, off, code % 7 = 0 AS free, amount IS NOT NULL AS ok FROM j UNION ALL SELECT trade_date, 'daily_bar', 'close', off, false, close IS NOT NULL FROM j UNION ALL SELECT trade_date, 'financial_indicator', 'roe', false, false, roe IS NOT NULL FROM j UNION ALL SELECT trade_date, 'financial_indicator', 'gross_margin', false, free, gross_margin IS NOT NULL FROM j), g AS (SELECT trade_date, \"table\", field, count(*) AS active_count, count(*) FILTER (NOT off AND free) AS exempted_count, count(*) FILTER (NOT off AND NOT free AND ok) AS non_missing_count, count(*) FILTER (NOT off AND NOT free) AS eligible FROM x GROUP BY 1, 2, 3) SELECT trade_date, \"table\", field, active_count, exempted_count, non_missing_count, CASE WHEN eligible = 0 THEN 1.0 ELSE non_missing_count / eligible END AS coverage FROM g", "coverage")
def historical_member_coverage(s: Star) -> DataFrame:
    months = written(s.months(), "months")
    code, member, dates = F.col("ts_code").cast("int"), written(s.member(months), "member"), written(months.select("trade_date").distinct().coalesce(1), "calendar")
    amount = F.col("cents") / F.lit(100.0)
    bar = months.select("trade_date", "ts_code", F.when(code % 7 != 0, amount).alias("amount"), (amount / F.col("qty")).alias("close"))
    financial = s.financial(months).withColumn("roe", F.when(F.month("report_period") != 3, F.col("roe")))
    suspension = member.where(code % 5 == 1).select("ts_code", F.date_add("in_date", 200).alias("suspend_date"), F.date_add("in_date", 400).alias("resume_date"))
    industry = member.join(s.industry(), "ts_code").select(F.col("in_date").alias("trade_date"), "ts_code", F.when(F.col("industry_code") == "3", F.lit("保险")).otherwise(F.lit("-")).alias("industry_name"))
    exempt = written(G.never_filled(bar, "daily_bar", "amount").unionByName(G.of_industries(industry, "financial_indicator", "gross_margin")), "exempt")
    return G.member_coverage(member, dates, {"daily_bar": (bar, ["amount", "close"])}, {"financial_indicator": (financial, ["roe", "gross_margin"])}, suspension, exempt, G.sign(exempt, "review board", "1998-12-01"))


@query("monthly_factor_ic", f"{TABLES} calendar", f"WITH {PANEL}, {LONG}, {_RANKS}, k AS (SELECT trade_date AS signal_date, lead(trade_date) OVER w AS execution_date, lead(trade_date) OVER w AS label_end_date, lead(trade_date, 2) OVER w AS availability_date FROM calendar WINDOW w AS (ORDER BY trade_date)), u AS (SELECT trade_date, factor, count(*) AS universe, count(*) FILTER (value IS NOT NULL AND fwd IS NOT NULL) AS valid FROM long GROUP BY 1, 2) SELECT k.*, u.factor, ic.ic AS rank_ic, valid, universe, valid / universe AS coverage FROM u JOIN k ON k.signal_date = u.trade_date LEFT JOIN ic ON ic.trade_date = u.trade_date AND ic.factor = u.factor WHERE availability_date IS NOT NULL AND label_end_date = signal_date + INTERVAL 1 MONTH", "rank_ic coverage")
def monthly_factor_ic(s: Star) -> DataFrame:
    labels = J.monthly_labels(s.calendar())
    returns = s.returns().join(J.lookup(labels), F.col("trade_date") == F.col("signal_date")).select("ts_code", "signal_date", "execution_date", "label_end_date", "availability_date", F.col("fwd").alias("label_return"))
    rows = X.process(panel(s), FACTORS).select("trade_date", "ts_code", "factor", F.col("raw").alias("value"), "neutral")
    return P.monthly_factor_ic(rows, returns).drop("neutral_rank_ic")
