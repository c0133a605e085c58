"""Processing, evaluation, portfolios, performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as T
from ..functions.tables import written
from ..operators import evaluation as E
from ..operators import performance as P
from ..operators import portfolio as B
from ..operators import processing as X
from ..operators import simulator as M
from ..operators.universe import mark_tradability
from ..sources.star import Star
from .registry import query

FACTORS = ["bp", "ep", "size", "turnover_rate"]


def panel(s: Star) -> DataFrame:
    """Supplier-months with four factors, industry, return and forward return."""
    b = s.basic().join(s.industry(), "ts_code")
    b = b.join(s.returns().select("trade_date", "ts_code", "amount", "ret", "fwd"), ["trade_date", "ts_code"])
    size = F.when(F.col("total_mv") > 0, F.log("total_mv"))
    return b.select("trade_date", "ts_code", "industry_code", (1.0 / F.col("pb")).alias("bp"), (1.0 / F.col("pe_ttm")).alias("ep"), size.alias("size"), "turnover_rate", "amount", "ret", "fwd")


PANEL = "panel AS (SELECT b.trade_date, b.ts_code, industry_code, 1.0 / pb AS bp, 1.0 / pe_ttm AS ep, CASE WHEN total_mv > 0 THEN ln(total_mv) END AS size, turnover_rate, r.amount, ret, fwd FROM basic b JOIN industry i ON b.ts_code = i.ts_code JOIN returns r ON r.trade_date = b.trade_date AND r.ts_code = b.ts_code)"
LONG = "long AS (" + " UNION ALL ".join(f"SELECT trade_date, ts_code, industry_code, ret, fwd, '{f}' AS factor, {f} AS value, size FROM panel" for f in FACTORS) + ")"
TABLES = "basic industry returns"


def long(s: Star, *keep: str) -> DataFrame:
    return X.long_form(panel(s), FACTORS, ["trade_date", "ts_code", *keep])


_WINSOR = "med0 AS (SELECT trade_date, factor, median(value) AS m FROM long GROUP BY ALL), med AS MATERIALIZED (SELECT long.*, m FROM long JOIN med0 USING (trade_date, factor)), dev0 AS (SELECT trade_date, factor, median(abs(value - m)) AS d FROM med GROUP BY ALL), wins AS MATERIALIZED (SELECT med.*, d, CASE WHEN value IS NULL THEN NULL WHEN coalesce(d, 0) > 0 THEN greatest(least(value, m + 3 * 1.4826 * d), m - 3 * 1.4826 * d) ELSE value END AS w FROM med JOIN dev0 USING (trade_date, factor))"


@query("winsorized_factors", TABLES, f"WITH {PANEL}, {LONG}, {_WINSOR} SELECT trade_date, ts_code, factor, w AS winsorized, coalesce(abs(w - value) > 1e-8 + 1e-5 * abs(value), false) AS clipped FROM wins", "winsorized")
def winsorized_factors(s: Star) -> DataFrame:
    return X.winsorize_mad(long(s)).select("trade_date", "ts_code", "factor", "winsorized", "clipped")


@query("zscored_factors", TABLES, f"WITH {PANEL}, {LONG} SELECT trade_date, ts_code, factor, CASE WHEN stddev_pop(value) OVER w > 1e-12 * (1 + abs(avg(value) OVER w)) THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z FROM long WINDOW w AS (PARTITION BY trade_date, factor)", "z", digits=5)
def zscored_factors(s: Star) -> DataFrame:
    return long(s).withColumn("z", X.zscore("value", ["trade_date", "factor"])).select("trade_date", "ts_code", "factor", "z")


@query("neutralized_factor", TABLES, f"""
WITH {PANEL}, ok AS (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n, ep - avg(ep) OVER (PARTITION BY trade_date, industry_code) AS y, size - avg(size) OVER (PARTITION BY trade_date, industry_code) AS s FROM panel WHERE ep IS NOT NULL AND size IS NOT NULL AND industry_code IS NOT NULL),
b AS (SELECT *, CASE WHEN sum(s * s) OVER (PARTITION BY trade_date) > 1e-12 THEN sum(s * y) OVER (PARTITION BY trade_date) / sum(s * s) OVER (PARTITION BY trade_date) ELSE 0 END AS beta FROM ok)
SELECT p.trade_date, p.ts_code, CASE WHEN n >= 3 THEN y - beta * s END AS neutral FROM panel p LEFT JOIN b ON p.trade_date = b.trade_date AND p.ts_code = b.ts_code""", "neutral")
def neutralized_factor(s: Star) -> DataFrame:
    return X.neutralize(panel(s), "ep", keys=["trade_date"]).select("trade_date", "ts_code", "neutral")


@query("processed_factors")
def processed_factors(s: Star) -> DataFrame:
    p = X.process(panel(s), FACTORS)
    return p.select("trade_date", "ts_code", "factor", "raw", "winsorized", "neutral", "standardized", "clipped")


@query("processing_audit", TABLES, f"WITH {PANEL}, {LONG}, {_WINSOR}, u AS (SELECT trade_date, factor, 'raw' AS step, value AS x, false AS c FROM wins UNION ALL SELECT trade_date, factor, 'winsorized', w, coalesce(abs(w - value) > 1e-8 + 1e-5 * abs(value), false) FROM wins) SELECT trade_date, factor, step, count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q75, max(x) AS max, count(*) FILTER (c) AS clipped_count FROM u GROUP BY ALL", "mean std min q25 median q75 max")
def processing_audit(s: Star) -> DataFrame:
    return X.step_summary(X.winsorize_mad(long(s)).withColumnRenamed("value", "raw"), ["raw", "winsorized"])


@query("factor_coverage", TABLES, f"WITH {PANEL}, {LONG} SELECT trade_date, industry_code, factor, count(*) AS rows, count(value) AS present, count(value)::DOUBLE / count(*) AS coverage FROM long GROUP BY ALL", "coverage")
def factor_coverage(s: Star) -> DataFrame:
    return X.coverage(panel(s), FACTORS, ["trade_date", "industry_code"])


@query("low_coverage_mask", TABLES, f"WITH {PANEL} SELECT trade_date, ts_code, CASE WHEN count(size) OVER w::DOUBLE / count(*) OVER w >= 0.93 THEN size END AS size FROM panel WINDOW w AS (PARTITION BY trade_date)".replace("count(size) OVER w::DOUBLE", "(count(size) OVER w)::DOUBLE"), "size")
def low_coverage_mask(s: Star) -> DataFrame:
    return X.mask_low_coverage(panel(s), ["size"], 0.93).select("trade_date", "ts_code", "size")


_RANKS = "ranked AS (SELECT trade_date, factor, x.value AS v, fwd AS y, rank() OVER (PARTITION BY trade_date, factor ORDER BY value) + (count(*) OVER (PARTITION BY trade_date, factor, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY trade_date, factor ORDER BY fwd) + (count(*) OVER (PARTITION BY trade_date, factor, fwd) - 1) / 2.0 AS ry FROM long x WHERE value IS NOT NULL AND fwd IS NOT NULL), ic AS (SELECT trade_date, factor, count(*) AS n, CASE WHEN count(*) >= 3 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN regr_sxy(ry, rx) / sqrt(regr_sxx(ry, rx) * regr_syy(ry, rx)) END AS ic FROM ranked GROUP BY trade_date, factor)"


def ics(s: Star) -> DataFrame:
    return E.daily_ic(long(s, "fwd"), "fwd")


@query("daily_rank_ic", TABLES, f"WITH {PANEL}, {LONG}, {_RANKS} SELECT trade_date, factor, ic, n FROM ic", "ic")
def daily_rank_ic(s: Star) -> DataFrame:
    return ics(s)


@query("daily_pearson_ic", TABLES, f"WITH {PANEL}, {LONG} SELECT trade_date, factor, CASE WHEN count(*) >= 3 AND min(value) < max(value) AND min(fwd) < max(fwd) THEN regr_sxy(fwd, value) / sqrt(regr_sxx(fwd, value) * regr_syy(fwd, value)) END AS ic, count(*) AS n FROM long WHERE value IS NOT NULL AND fwd IS NOT NULL GROUP BY ALL", "ic")
def daily_pearson_ic(s: Star) -> DataFrame:
    return E.daily_ic(long(s, "fwd"), "fwd", method="pearson")


_SUM = "avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)) AS t_stat, count(*) AS count"


@query("ic_summary", TABLES, f"WITH {PANEL}, {LONG}, {_RANKS} SELECT factor, {_SUM} FROM ic WHERE ic IS NOT NULL GROUP BY factor", "ic_mean ic_std icir hit_rate t_stat")
def ic_summary(s: Star) -> DataFrame:
    return E.ic_summary(ics(s), ["factor"])


@query("annual_ic", TABLES, f"WITH {PANEL}, {LONG}, {_RANKS} SELECT factor, CAST(year(trade_date) AS BIGINT) AS year, {_SUM} FROM ic WHERE ic IS NOT NULL GROUP BY ALL", "ic_mean ic_std icir hit_rate t_stat")
def annual_ic(s: Star) -> DataFrame:
    return E.annual_ic(ics(s), ["factor"])


@query("rolling_ic", TABLES, f"WITH {PANEL}, {LONG}, {_RANKS}, r AS (SELECT factor, trade_date, CASE WHEN count(ic) OVER w >= 6 THEN avg(ic) OVER w END AS m, CASE WHEN count(ic) OVER w >= 6 THEN stddev_samp(ic) OVER w END AS sd FROM ic WINDOW w AS (PARTITION BY factor ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT factor, trade_date, m AS rolling_ic, m / nullif(sd, 0) AS rolling_icir FROM r WHERE m IS NOT NULL", "rolling_ic rolling_icir")
def rolling_ic(s: Star) -> DataFrame:
    return E.rolling_ic(ics(s), ["factor"], 12)


@query("ic_decay")
def ic_decay(s: Star) -> DataFrame:
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    p = panel(s).withColumn("f3", F.lead("amount", 3).over(w) / F.col("amount") - 1)
    return E.ic_decay(X.long_form(p, FACTORS, ["trade_date", "ts_code", "fwd", "f3"]), {1: "fwd", 3: "f3"})


@query("market_regimes", "bench", "WITH q AS (SELECT quantile_cont(close, 0.3) AS a, quantile_cont(close, 0.7) AS b FROM bench) SELECT trade_date, CASE WHEN close <= a THEN 'bear' WHEN close <= b THEN 'range' ELSE 'bull' END AS regime_in_sample FROM bench, q")
def market_regimes(s: Star) -> DataFrame:
    return E.market_regime(s.benchmark(), "close").select("trade_date", "regime_in_sample")


@query("regime_ic", f"{TABLES} bench", f"WITH {PANEL}, {LONG}, {_RANKS}, q AS (SELECT quantile_cont(close, 0.3) AS a, quantile_cont(close, 0.7) AS b FROM bench), g AS (SELECT trade_date, CASE WHEN close <= a THEN 'bear' WHEN close <= b THEN 'range' ELSE 'bull' END AS regime_in_sample FROM bench, q) SELECT factor, regime_in_sample, {_SUM} FROM ic JOIN g USING (trade_date) WHERE ic IS NOT NULL GROUP BY ALL", "ic_mean ic_std icir hit_rate t_stat")
def regime_ic(s: Star) -> DataFrame:
    return E.regime_ic(ics(s), E.market_regime(s.benchmark(), "close"), ["factor"])


_GROUPS = "grp AS (SELECT trade_date, factor, fwd, ts_code, n, d, greatest(1, ((rn - 1) * 5 + greatest(n - 2, 0)) // greatest(n - 1, 1)) AS g FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, factor ORDER BY value, ts_code) AS rn, count(*) OVER (PARTITION BY trade_date, factor) AS n, (count(DISTINCT value) OVER (PARTITION BY trade_date, factor)) AS d FROM long WHERE value IS NOT NULL AND fwd IS NOT NULL) WHERE d >= 5)"


@query("group_returns", TABLES, f"WITH {PANEL}, {LONG}, {_GROUPS}, m AS (SELECT trade_date, factor, " + ", ".join(f"avg(fwd) FILTER (g = {i}) AS Q{i}" for i in range(1, 6)) + " FROM grp GROUP BY ALL) SELECT *, Q5 - Q1 AS spread FROM m", "Q1 Q2 Q3 Q4 Q5 spread")
def group_returns(s: Star) -> DataFrame:
    return E.group_returns(long(s, "fwd"), "fwd")


@query("group_counts", TABLES, f"WITH {PANEL}, {LONG}, {_GROUPS} SELECT trade_date, factor, g AS \"group\", count(*) AS n FROM grp GROUP BY ALL")
def group_counts(s: Star) -> DataFrame:
    return E.group_counts(E.groups_of(long(s, "fwd").where("fwd is not null")), ["trade_date", "factor"])


@query("group_monotonicity")
def group_monotonicity(s: Star) -> DataFrame:
    return E.monotonicity(E.group_returns(long(s, "fwd"), "fwd"), 5, ["factor"])


_ERFC = "u * exp(-z * z + -1.26551223 + u * (1.00002368 + u * (0.37409196 + u * (0.09678418 + u * (-0.18628806 + u * (0.27886807 + u * (-1.13520398 + u * (1.48851587 + u * (-0.82215223 + u * 0.17087277)))))))))"
_NW = f"e AS (SELECT factor, trade_date, ic, avg(ic) OVER (PARTITION BY factor) AS m, count(*) OVER (PARTITION BY factor) AS n, ic - avg(ic) OVER (PARTITION BY factor) AS e FROM ic WHERE ic IS NOT NULL), l AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3 FROM e WINDOW w AS (PARTITION BY factor ORDER BY trade_date)), g AS (SELECT factor, any_value(n) AS n, avg(ic) AS mean, stddev_samp(ic) AS sd, sum(e * e) AS g0, sum(e * e1) AS g1, sum(e * e2) AS g2, sum(e * e3) AS g3 FROM l GROUP BY factor), nw AS (SELECT factor, n, mean, mean / (sd / sqrt(n)) AS naive_t, sqrt(greatest(g0 / n + 2 * 0.75 * g1 / n + 2 * 0.5 * g2 / n + 2 * 0.25 * g3 / n, 0) / n) AS nw_se FROM g), t AS (SELECT *, mean / nw_se AS nw_t, abs(mean / nw_se) / sqrt(2.0) AS z FROM nw), p AS (SELECT *, {_ERFC} AS nw_p FROM (SELECT *, 1.0 / (1.0 + 0.5 * z) AS u FROM t))"


@query("factor_inference", TABLES, f"WITH {PANEL}, {LONG}, {_RANKS}, {_NW}, h AS (SELECT *, nw_p * count(*) OVER () / row_number() OVER (ORDER BY nw_p) AS raw FROM p) SELECT factor, n, mean, naive_t, nw_se, nw_t, nw_p, least(min(raw) OVER (ORDER BY nw_p DESC, raw DESC ROWS UNBOUNDED PRECEDING), 1.0) AS q_value FROM h", "mean naive_t nw_se nw_t nw_p q_value")
def factor_inference(s: Star) -> DataFrame:
    return E.factor_inference(ics(s), ["factor"], 3)


@query("factor_correlation", TABLES, f"WITH {PANEL}, r AS (SELECT " + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN rank() OVER (PARTITION BY {f} IS NULL ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 END AS {f}" for f in FACTORS) + " FROM panel) " + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", regr_sxy({b}, {a}) / sqrt(regr_sxx({b}, {a}) * regr_syy({b}, {a})) AS corr FROM r" for i, a in enumerate(FACTORS) for b in FACTORS[i:]), "corr")
def factor_correlation(s: Star) -> DataFrame:
    return X.factor_correlation(panel(s), FACTORS)


@query("walk_forward")
def walk_forward(s: Star) -> DataFrame:
    ic = ics(s).withColumn("label_end", F.add_months("trade_date", 1))
    cov = X.coverage(panel(s), FACTORS, ["trade_date"]).select("trade_date", "factor", "coverage")
    return E.walk_forward(ic, s.calendar(), cov)


@query("walk_forward_windows", f"{TABLES} calendar", f"WITH {PANEL}, {LONG}, {_RANKS} SELECT c.trade_date AS test_date, factor, avg(ic) FILTER (i.trade_date < c.trade_date - INTERVAL 6 MONTH AND i.trade_date + INTERVAL 1 MONTH < c.trade_date - INTERVAL 6 MONTH) AS train_ic, count(*) FILTER (i.trade_date < c.trade_date - INTERVAL 6 MONTH AND i.trade_date + INTERVAL 1 MONTH < c.trade_date - INTERVAL 6 MONTH) AS train_dates, avg(ic) FILTER (i.trade_date >= c.trade_date - INTERVAL 6 MONTH AND i.trade_date + INTERVAL 1 MONTH < c.trade_date) AS validation_ic FROM ic i JOIN calendar c ON i.trade_date >= c.trade_date - INTERVAL 30 MONTH AND i.trade_date < c.trade_date WHERE ic IS NOT NULL GROUP BY ALL", "train_ic validation_ic")
def walk_forward_windows(s: Star) -> DataFrame:
    return walk_forward(s).select("test_date", "factor", "train_ic", "train_dates", "validation_ic")


@query("walk_forward_scores")
def walk_forward_scores(s: Star) -> DataFrame:
    z = long(s).withColumn("value", X.zscore("value", ["trade_date", "factor"]))
    return E.weighted_scores(z, walk_forward(s))


def portfolio(s: Star) -> DataFrame:
    return B.rank_portfolio(panel(s).select("trade_date", "ts_code", F.col("bp").alias("score"), "industry_code"), 10, 0.2, 5)


_BEST = "best AS (SELECT * FROM (SELECT trade_date, ts_code, industry_code, bp, row_number() OVER (PARTITION BY trade_date ORDER BY bp DESC, ts_code) AS r FROM panel WHERE bp IS NOT NULL) WHERE r <= 10), port AS (SELECT trade_date, ts_code, industry_code, 1.0 / n AS target_weight FROM (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n FROM best) WHERE n >= 5 AND n * 0.2 >= 1 - 1e-12)"


@query("rank_portfolio", TABLES, f"WITH {PANEL}, {_BEST} SELECT trade_date, ts_code, target_weight FROM port", "target_weight")
def rank_portfolio(s: Star) -> DataFrame:
    return portfolio(s).select("trade_date", "ts_code", "target_weight")


@query("industry_exposure", TABLES, f"WITH {PANEL}, {_BEST} SELECT trade_date, industry_code, sum(target_weight) AS exposure FROM port GROUP BY ALL", "exposure")
def industry_exposure(s: Star) -> DataFrame:
    return P.exposure(portfolio(s).drop("industry_code"), s.industry(), "target_weight")


@query("capped_portfolio")
def capped_portfolio(s: Star) -> DataFrame:
    return B.cap_industries(portfolio(s).select("trade_date", "ts_code", "industry_code", "target_weight"), 0.4, 0.2)


_REB = "dd AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nx FROM (SELECT DISTINCT trade_date FROM port)), pre AS (SELECT nx AS trade_date, ts_code, target_weight AS p FROM port JOIN dd USING (trade_date) WHERE nx IS NOT NULL), del AS (SELECT trade_date, coalesce(target_weight, 0) - coalesce(p, 0) AS d FROM port FULL JOIN pre USING (trade_date, ts_code)), reb AS (SELECT trade_date, sum(greatest(d, 0)) AS buy, sum(greatest(-d, 0)) AS sell FROM del GROUP BY trade_date), cost AS (SELECT trade_date, buy, sell, (buy + sell) / 2 AS turnover, buy * 0.0003 + sell * 0.0008 + (buy + sell) * 0.0007 AS cost FROM reb)"


@query("rebalance_costs", TABLES, f"WITH {PANEL}, {_BEST}, {_REB} SELECT * FROM cost", "buy sell turnover cost")
def rebalance_costs(s: Star) -> DataFrame:
    return B.rebalance_costs(portfolio(s), B.Costs())


def backtest(s: Star) -> DataFrame:
    """Weights and dates are met in several steps and are small, so each is worked out once from the line items."""
    return B.weight_backtest(written(portfolio(s), "portfolio"), s.returns(), written(s.calendar(), "calendar"), B.Costs())


_BT = "cal AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nx FROM calendar), gross AS (SELECT c.nx AS trade_date, sum(target_weight * coalesce(r.ret, 0)) AS gross FROM port p JOIN cal c USING (trade_date) LEFT JOIN returns r ON r.trade_date = c.nx AND r.ts_code = p.ts_code WHERE c.nx IS NOT NULL GROUP BY c.nx), bt AS (SELECT g.trade_date, gross, coalesce(cost, 0) AS cost, gross - coalesce(cost, 0) AS ret FROM gross g LEFT JOIN (SELECT nx AS trade_date, cost FROM cost JOIN cal USING (trade_date)) k USING (trade_date)), nav AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) AS nav FROM bt)"


@query("weight_backtest", f"{TABLES} calendar", f"WITH {PANEL}, {_BEST}, {_REB}, {_BT} SELECT * FROM nav", "gross cost ret nav")
def weight_backtest(s: Star) -> DataFrame:
    return backtest(s)


@query("performance_summary", f"{TABLES} calendar", f"""
WITH {PANEL}, {_BEST}, {_REB}, {_BT}, r AS (SELECT trade_date, nav, nav / lag(nav) OVER (ORDER BY trade_date) - 1 AS ret, nav / max(nav) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM nav),
g AS (SELECT arg_min(nav, trade_date) AS f, arg_max(nav, trade_date) AS l, count(*) AS days, stddev_samp(ret) * sqrt(12.0) AS annual_vol, sqrt(avg(CASE WHEN ret IS NULL THEN NULL ELSE least(ret, 0) * least(ret, 0) END)) * sqrt(12.0) AS down, min(dd) AS max_drawdown, avg(CASE WHEN ret IS NULL THEN NULL WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM r),
a AS (SELECT *, l / f - 1 AS total_return, pow(l / f, 12.0 / days) - 1 AS annual_return FROM g)
SELECT total_return, annual_return, annual_vol, annual_return / annual_vol AS sharpe, annual_return / down AS sortino, max_drawdown, annual_return / abs(max_drawdown) AS calmar, win_rate, days FROM a""", "total_return annual_return annual_vol sharpe sortino max_drawdown calmar win_rate", digits=4)
def performance_summary(s: Star) -> DataFrame:
    return P.performance(backtest(s).withColumnRenamed("trade_date", "date"), [], per_year=12)


@query("relative_performance", f"{TABLES} calendar bench", f"WITH {PANEL}, {_BEST}, {_REB}, {_BT}, b AS (SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS b FROM bench), j AS (SELECT ret, b, ret - b AS x FROM nav JOIN b USING (trade_date) WHERE ret IS NOT NULL AND b IS NOT NULL), g AS (SELECT covar_samp(ret, b) / var_samp(b) AS beta, avg(ret) AS mr, avg(b) AS mb, avg(x) AS mx, stddev_samp(x) AS sx FROM j) SELECT beta, (mr - beta * mb) * 12 AS alpha, sx * sqrt(12.0) AS tracking_error, mx * 12 / (sx * sqrt(12.0)) AS information_ratio FROM g", "beta alpha tracking_error information_ratio")
def relative_performance(s: Star) -> DataFrame:
    b = P.returns_of(s.benchmark(), "close", "trade_date").select("trade_date", F.col("ret").alias("bench_ret"))
    return P.relative_performance(backtest(s).join(b, "trade_date"), [], per_year=12)


@query("annual_returns", f"{TABLES} calendar", f"WITH {PANEL}, {_BEST}, {_REB}, {_BT} SELECT CAST(date_trunc('year', trade_date) AS DATE) AS period, product(1 + ret) - 1 AS period_return FROM nav GROUP BY 1", "period_return")
def annual_returns(s: Star) -> DataFrame:
    return P.periodic_returns(backtest(s), "YYYY", "ret", "trade_date")


@query("monthly_return_matrix")
def monthly_return_matrix(s: Star) -> DataFrame:
    return P.monthly_matrix(backtest(s), "ret", "trade_date")


@query("rolling_risk", "returns", "WITH r AS (SELECT ts_code, trade_date, CASE WHEN count(ret) OVER w >= 12 THEN stddev_samp(ret) OVER w END * sqrt(12.0) AS v, CASE WHEN count(ret) OVER w >= 12 THEN avg(ret) OVER w END AS m FROM returns WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT ts_code, trade_date, v AS rolling_vol, m * 12 / nullif(v, 0) AS rolling_sharpe FROM r", "rolling_vol rolling_sharpe")
def rolling_risk(s: Star) -> DataFrame:
    return P.rolling_risk(s.returns(), ["ts_code"], "ret", "trade_date", 12, 12)


_CON = "con AS (SELECT p.trade_date, p.ts_code, industry_code, target_weight AS weight, fwd AS ret, target_weight * fwd AS contribution FROM port p JOIN (SELECT trade_date, ts_code, fwd FROM panel) f USING (trade_date, ts_code))"


def contributions(s: Star) -> DataFrame:
    r = s.returns().select("trade_date", "ts_code", F.col("fwd").alias("ret"))
    return P.contributions(portfolio(s).select("trade_date", "ts_code", F.col("target_weight").alias("weight")), r)


@query("return_contributions", TABLES, f"WITH {PANEL}, {_BEST}, {_CON} SELECT trade_date, ts_code, weight, ret, contribution FROM con", "weight ret contribution")
def return_contributions(s: Star) -> DataFrame:
    return contributions(s)


@query("industry_attribution", TABLES, f"WITH {PANEL}, {_BEST}, {_CON} SELECT industry_code, sum(contribution) AS contribution, avg(weight) AS mean_weight, count(*) AS rows FROM con GROUP BY ALL", "contribution mean_weight")
def industry_attribution(s: Star) -> DataFrame:
    return P.attribution(contributions(s), s.industry(), "industry_code")


@query("top_contributors", TABLES, f"WITH {PANEL}, {_BEST}, {_CON}, g AS (SELECT ts_code, sum(contribution) AS contribution FROM con GROUP BY ts_code) SELECT * FROM (SELECT *, 'top' AS side FROM g ORDER BY contribution DESC NULLS LAST, ts_code LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'bottom' AS side FROM g ORDER BY contribution NULLS FIRST, ts_code LIMIT 5)", "contribution")
def top_contributors(s: Star) -> DataFrame:
    return P.top_contributors(contributions(s), 5)


@query("compliance_summary")
def compliance_summary(s: Star) -> DataFrame:
    p = portfolio(s).select("trade_date", "ts_code", F.col("target_weight").alias("weight"))
    return P.compliance_summary(P.compliance(p, s.industry(), max_weight=0.1, max_industry=0.4, min_holdings=5, max_cash=0.1))


@query("active_exposure")
def active_exposure(s: Star) -> DataFrame:
    own = P.exposure(portfolio(s).drop("industry_code"), s.industry(), "target_weight")
    bench = B.benchmark_industries(s.bar().select("trade_date", "ts_code", F.col("amount").alias("weight")), s.industry())
    return P.active_exposure(own, bench)


@query("cost_attribution", f"{TABLES} calendar", f"WITH {PANEL}, {_BEST}, {_REB}, {_BT}, g AS (SELECT product(1 + gross) - 1 AS gross_return, sum(cost) AS cost_sum, product(1 + ret) - 1 AS net_return FROM nav) SELECT *, gross_return - cost_sum - net_return AS residual FROM g", "gross_return cost_sum net_return residual")
def cost_attribution(s: Star) -> DataFrame:
    return P.cost_attribution(backtest(s), "gross", "cost", "ret")


def market(s: Star) -> DataFrame:
    return mark_tradability(s.bar().withColumn("ts_code", F.concat(F.lit("1"), "ts_code")), free_days=10_000).withColumn("ts_code", F.expr("substring(ts_code, 2)"))


@query("event_backtest_nav")
def event_backtest_nav(s: Star) -> DataFrame:
    return M.part(M.run_scenarios(market(s), portfolio(s), {"base": (M.Rules(participation=0.2, lot=1), B.Costs())}), "nav")


@query("event_backtest_orders")
def event_backtest_orders(s: Star) -> DataFrame:
    return M.part(M.run_scenarios(market(s), portfolio(s), {"base": (M.Rules(participation=0.2, lot=1), B.Costs())}), "order")


@query("execution_scenarios")
def execution_scenarios(s: Star) -> DataFrame:
    grid = M.scenario_grid(M.Rules(lot=1), B.Costs(), (0.0, 1.0), (1, 2), (0.1,), (1e6,))
    nav = M.part(M.run_scenarios(market(s), portfolio(s), grid), "nav").withColumnRenamed("trade_date", "date")
    return P.performance(nav, ["scenario"], per_year=12)


@query("unfilled_orders")
def unfilled_orders(s: Star) -> DataFrame:
    return P.unfilled_summary(M.part(M.run_scenarios(market(s), portfolio(s), {"tight": (M.Rules(participation=0.01, lot=10), B.Costs())}), "order"))


@query("forecast_scores", "returns", "WITH f AS (SELECT ts_code, ret AS actual, avg(ret) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS forecast FROM returns WHERE ret IS NOT NULL), c AS (SELECT * FROM f WHERE forecast IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY ts_code ORDER BY actual) + (count(*) OVER (PARTITION BY ts_code, actual) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY ts_code ORDER BY forecast) + (count(*) OVER (PARTITION BY ts_code, forecast) - 1) / 2.0 AS rf FROM c) SELECT ts_code, count(*) AS n, sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse, avg(abs(actual - forecast)) AS mae, avg(CASE WHEN sign(actual) = sign(forecast) THEN 1.0 ELSE 0.0 END) AS direction_accuracy, CASE WHEN min(ra) < max(ra) AND min(rf) < max(rf) THEN regr_sxy(rf, ra) / sqrt(regr_sxx(rf, ra) * regr_syy(rf, ra)) END AS rank_corr FROM k GROUP BY ts_code", "rmse mae direction_accuracy rank_corr")
def forecast_scores(s: Star) -> DataFrame:
    w = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(-12, -1)
    f = s.returns().where("ret is not null").select("ts_code", F.col("ret").alias("actual"), F.avg("ret").over(w).alias("forecast"))
    return E.forecast_scores(f, ["ts_code"])


@query("return_moments")
def return_moments(s: Star) -> DataFrame:
    r = s.returns().where("ret is not null")
    return r.groupBy("ts_code").agg(T.sample_skew("ret").alias("skew"), T.sample_kurtosis("ret").alias("kurtosis"))
