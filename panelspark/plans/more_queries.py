"""Further queries, and SQL for queries registered without."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import windows as W
from ..operators import dynamic as D
from ..operators import evaluation as E
from ..operators import joins
from ..operators import portfolio as B
from ..operators import simulator as M
from ..sources.star import Star
from .registry import oracle, query
from .research_queries import _BEST, _BT, _GROUPS, _RANKS, _REB, _SUM, _WINSOR, FACTORS, LONG, PANEL, TABLES, long, market, portfolio


@query("trailing_means", "returns", "SELECT trade_date, ts_code, ret, lag(ret) OVER w AS lag_1, avg(ret) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expanding_mean, avg(ret) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS mean_12, avg(ret) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS mean_24 FROM returns WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)", "ret lag_1 expanding_mean mean_12 mean_24")
def trailing_means(s: Star) -> DataFrame:
    return W.trailing_means(s.returns().select("trade_date", "ts_code", "ret"), "ret", ["ts_code"], "trade_date")


_TOP = "sized AS (SELECT *, count(*) OVER (PARTITION BY trade_date, factor) AS n, row_number() OVER (PARTITION BY trade_date, factor ORDER BY value, ts_code) AS rn FROM long WHERE value IS NOT NULL AND fwd IS NOT NULL), grp AS (SELECT *, greatest(1, ((rn - 1) * 5 + greatest(n - 2, 0)) // greatest(n - 1, 1)) AS g FROM sized WHERE n >= 10), m AS (SELECT trade_date, factor, avg(fwd) FILTER (g = 5) AS long_only, avg(fwd) FILTER (g = 1) AS short_side, list(DISTINCT ts_code) FILTER (g = 5) AS s FROM grp GROUP BY ALL), t AS (SELECT *, lag(s) OVER (PARTITION BY factor ORDER BY trade_date) AS b FROM m), u AS (SELECT *, CASE WHEN b IS NULL THEN 1.0 ELSE 1 - len(list_intersect(s, b))::DOUBLE / (len(s) + len(b) - len(list_intersect(s, b))) END AS turnover FROM t), k AS (SELECT trade_date, ln(lead(close) OVER (ORDER BY trade_date) / close) AS log_ret FROM bench)"


@query("monthly_quintiles", f"{TABLES} bench", f"WITH {PANEL}, {LONG}, {_TOP} SELECT u.trade_date, factor, long_only - short_side AS spread, long_only, long_only - log_ret AS relative, turnover, turnover * 0.0015 AS cost, long_only - turnover * 0.0015 AS net FROM u LEFT JOIN k ON u.trade_date = k.trade_date", "spread long_only relative turnover cost net")
def monthly_quintiles(s: Star) -> DataFrame:
    b = s.benchmark().select("trade_date", F.log(F.lead("close").over(Window.orderBy("trade_date")) / F.col("close")).alias("log_ret"))
    return E.monthly_quintiles(long(s, "fwd"), "fwd", b)


@query("monthly_states", sql="WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / 1e9 AS x, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT max(date) AS signal_date FROM d GROUP BY date_trunc('month', date)) SELECT signal_date, sum(x) AS log_ret, arg_max(n, date)::DOUBLE AS last_breadth, avg(n) AS mean_dispersion, count(*) AS days FROM d JOIN s ON date_trunc('month', date) = date_trunc('month', signal_date) AND date <= signal_date GROUP BY signal_date", doubles="log_ret last_breadth mean_dispersion")
def monthly_states(s: Star) -> DataFrame:
    o = s.raw("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 1e9).alias("log_ret"), F.count("*").cast("double").alias("breadth"))
    ends = joins.month_end_sessions(o.select(F.col("date").alias("trade_date")))
    return E.monthly_states(o.withColumn("dispersion", F.col("breadth")), ends)


@query("strategy_comparison")
def strategy_comparison(s: Star) -> DataFrame:
    grid = {"patient": (M.Rules(participation=0.2, lot=1, delay=2), B.Costs()), "prompt": (M.Rules(participation=0.2, lot=1), B.Costs())}
    nav = M.part(M.run_scenarios(market(s), portfolio(s), grid), "nav").withColumnsRenamed({"scenario": "strategy", "trade_date": "date"})
    return D.strategy_comparison(nav, 2, 12)


@query("composite_scores", TABLES, f"WITH {PANEL} SELECT trade_date, ts_code, (coalesce(bp, 0) + coalesce(ep, 0) + coalesce(size, 0)) / nullif((bp IS NOT NULL)::INT + (ep IS NOT NULL)::INT + (size IS NOT NULL)::INT, 0)::DOUBLE AS score FROM panel", "score")
def composite_scores(s: Star) -> DataFrame:
    from .research_queries import panel

    return panel(s).select("trade_date", "ts_code", S.row_mean(["bp", "ep", "size"]).alias("score"))


@query("exposure_scaled_weights", f"{TABLES}", f"WITH {PANEL}, {_BEST} SELECT trade_date, ts_code, target_weight * CASE WHEN year(trade_date) % 2 = 0 THEN 0.9 ELSE 1.0 END AS target_weight FROM port", "target_weight")
def exposure_scaled_weights(s: Star) -> DataFrame:
    scalars = s.calendar().where("year(trade_date) % 2 = 0").withColumn("scalar", F.lit(0.9))
    return B.scale_exposure(portfolio(s), scalars).select("trade_date", "ts_code", "target_weight")


@query("trade_costs", sql="SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN greatest(o_totalprice * 0.0003, 5) + o_totalprice * 0.0005 ELSE greatest(o_totalprice * 0.0003, 5) END + o_totalprice * 0.0007 AS cost FROM orders", doubles="cost", digits=7)
def trade_costs(s: Star) -> DataFrame:
    o = s.raw("orders").withColumn("side", F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy"))
    return o.select("o_orderkey", B.trade_cost("o_totalprice", "side", B.Costs()).alias("cost"))


oracle("ewma_levels", "bar", "SELECT ts_code, list_reduce(list(close ORDER BY trade_date), lambda a, x: 0.94::DOUBLE * a + 0.06::DOUBLE * x) AS level FROM bar GROUP BY ts_code", "level")
oracle(
    "kalman_levels", "bar",
    """WITH x AS (SELECT ts_code, count(*) AS n, list(close ORDER BY trade_date) AS xs FROM bar GROUP BY ts_code),
    r AS (SELECT ts_code, n, list_reduce(list_prepend({'m': xs[1], 'p': 0.1::DOUBLE}, list_transform(xs, lambda v: {'m': v, 'p': 0.0::DOUBLE})), lambda a, v: {'m': a.m + (a.p + 0.001::DOUBLE) / (a.p + 0.001::DOUBLE + 0.01::DOUBLE) * (v.m - a.m), 'p': (1 - (a.p + 0.001::DOUBLE) / (a.p + 0.001::DOUBLE + 0.01::DOUBLE)) * (a.p + 0.001::DOUBLE)}) AS z FROM x)
    SELECT ts_code, z.m AS forecast, z.p + 0.001::DOUBLE + 0.01::DOUBLE AS variance, n FROM r""",
    "forecast variance",
)
oracle(
    "compliance_summary", TABLES,
    f"""WITH {PANEL}, {_BEST}, day AS (SELECT trade_date, count(*) AS n, max(target_weight) AS w, sum(target_weight) AS s FROM port GROUP BY 1),
    ind AS (SELECT trade_date, max(e) AS i FROM (SELECT trade_date, industry_code, sum(target_weight) AS e FROM port GROUP BY ALL) GROUP BY 1),
    c AS (SELECT 'min_holdings' AS rule, n::DOUBLE AS v, 5.0::DOUBLE AS l, n >= 5 AS ok FROM day UNION ALL SELECT 'max_weight', w, 0.1, w <= 0.1 + 1e-9 FROM day UNION ALL SELECT 'max_industry', i, 0.4, i <= 0.4 + 1e-9 FROM ind UNION ALL SELECT 'max_cash', 1 - s, 0.1, 1 - s <= 0.1 + 1e-9 FROM day)
    SELECT rule, count(*) AS checks, count(*) FILTER (NOT ok) AS violations, max(v) AS largest, any_value(l) AS "limit" FROM c GROUP BY rule""",
    'largest "limit"',
)
oracle("active_exposure", f"{TABLES} bar", f"WITH {PANEL}, {_BEST}, o AS (SELECT trade_date, industry_code, sum(target_weight) AS e FROM port GROUP BY ALL), b AS (SELECT trade_date, industry_code, sum(w) AS e FROM (SELECT trade_date, industry_code, amount / sum(amount) OVER (PARTITION BY trade_date) AS w FROM bar x JOIN industry y ON x.ts_code = y.ts_code) GROUP BY ALL) SELECT trade_date, industry_code, coalesce(o.e, 0) AS exposure, coalesce(b.e, 0) AS bench_exposure, coalesce(o.e, 0) - coalesce(b.e, 0) AS active FROM o FULL JOIN b USING (trade_date, industry_code)", "exposure bench_exposure active")
_NAV = f"WITH {PANEL}, {_BEST}, {_REB}, {_BT}"
oracle("monthly_return_matrix", f"{TABLES} calendar", f"{_NAV} SELECT CAST(year(trade_date) AS BIGINT) AS year, " + ", ".join(f'product(1 + ret) FILTER (month(trade_date) = {i}) - 1 AS "{i}"' for i in range(1, 13)) + " FROM nav GROUP BY 1", " ".join(f'"{i}"' for i in range(1, 13)))
oracle("yearly_performance", f"{TABLES} calendar", f"{_NAV}, r AS (SELECT year(trade_date) AS y, trade_date, nav, nav / lag(nav) OVER (ORDER BY trade_date) - 1 AS r FROM nav), d AS (SELECT *, nav / max(nav) OVER (PARTITION BY y ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM r), g AS (SELECT CAST(y AS BIGINT) AS year, product(1 + coalesce(r, 0)) - 1 AS year_return, stddev_samp(r) * sqrt(12.0) AS annual_vol, min(dd) AS max_drawdown, count(*) AS days FROM d GROUP BY y) SELECT year, year_return, annual_vol, year_return / annual_vol AS sharpe, max_drawdown, days FROM g", "year_return annual_vol sharpe max_drawdown")
oracle("return_moments", "returns", "SELECT ts_code, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurtosis FROM returns WHERE ret IS NOT NULL GROUP BY ts_code", "skew kurtosis")
oracle("ic_decay", TABLES, f"WITH {PANEL}, p3 AS (SELECT *, lead(amount, 3) OVER (PARTITION BY ts_code ORDER BY trade_date) / amount - 1 AS f3 FROM panel), long AS (" + " UNION ALL ".join(f"SELECT trade_date, '{f}' AS factor, {f} AS value, {h} AS horizon, {c} AS y FROM p3" for f in FACTORS for h, c in ((1, "fwd"), (3, "f3"))) + f"), k AS (SELECT trade_date, factor, horizon, rank() OVER (PARTITION BY trade_date, factor, horizon ORDER BY value) + (count(*) OVER (PARTITION BY trade_date, factor, horizon, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY trade_date, factor, horizon ORDER BY y) + (count(*) OVER (PARTITION BY trade_date, factor, horizon, y) - 1) / 2.0 AS ry FROM long WHERE value IS NOT NULL AND y IS NOT NULL), ic AS (SELECT trade_date, factor, horizon, CASE WHEN count(*) >= 3 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN regr_sxy(ry, rx) / sqrt(regr_sxx(ry, rx) * regr_syy(ry, rx)) END AS ic FROM k GROUP BY ALL) SELECT factor, CAST(horizon AS BIGINT) AS horizon, {_SUM} FROM ic WHERE ic IS NOT NULL GROUP BY ALL", "ic_mean ic_std icir hit_rate t_stat")
oracle("member_field_coverage", "member calendar bar basic", "WITH a AS (SELECT c.trade_date, m.ts_code FROM calendar c JOIN member m ON m.in_date <= c.trade_date AND (m.out_date IS NULL OR c.trade_date < m.out_date)), j AS (SELECT a.trade_date, b.close, b.amount, s.pb, s.pe_ttm FROM a LEFT JOIN bar b ON a.trade_date = b.trade_date AND a.ts_code = b.ts_code LEFT JOIN basic s ON a.trade_date = s.trade_date AND a.ts_code = s.ts_code) " + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{f}' AS field, count(*) AS members, count({f}) AS present, count({f})::DOUBLE / count(*) AS coverage FROM j" for t, f in (("bar", "close"), ("bar", "amount"), ("basic", "pb"), ("basic", "pe_ttm"))), "coverage")
oracle("group_monotonicity", TABLES, f"WITH {PANEL}, {LONG}, {_GROUPS}, d AS (SELECT trade_date, factor, g, avg(fwd) AS r FROM grp GROUP BY ALL), m AS (SELECT factor, g, avg(r) AS m FROM d GROUP BY ALL), s AS (SELECT factor, g, CASE WHEN m > lag(m) OVER w THEN 1.0 WHEN lag(m) OVER w IS NULL THEN NULL ELSE 0.0 END AS up, rank() OVER (PARTITION BY factor ORDER BY m) + (count(*) OVER (PARTITION BY factor, m) - 1) / 2.0 AS r FROM m WINDOW w AS (PARTITION BY factor ORDER BY g)) SELECT factor, avg(up) AS rising_share, CASE WHEN min(r) < max(r) THEN regr_sxy(r, g) / sqrt(regr_sxx(r, g) * regr_syy(r, g)) END AS rank_corr FROM s GROUP BY factor", "rising_share rank_corr")
oracle(
    "processed_factors", TABLES,
    f"""WITH {PANEL}, {LONG}, {_WINSOR},
    ok AS (SELECT *, factor = 'size' OR size IS NOT NULL AS fit FROM wins WHERE w IS NOT NULL AND industry_code IS NOT NULL),
    c AS (SELECT *, count(*) OVER d AS n, w - avg(w) OVER i AS y, CASE WHEN factor <> 'size' THEN size - avg(size) OVER i END AS sz FROM ok WHERE fit WINDOW d AS (PARTITION BY trade_date, factor), i AS (PARTITION BY trade_date, factor, industry_code)),
    b AS (SELECT *, CASE WHEN sum(sz * sz) OVER d > 1e-12 THEN sum(sz * y) OVER d / sum(sz * sz) OVER d ELSE 0 END AS beta FROM c WINDOW d AS (PARTITION BY trade_date, factor)),
    r AS (SELECT trade_date, ts_code, factor, CASE WHEN n >= 3 THEN y - beta * coalesce(sz, 0) END AS neutral FROM b),
    j AS (SELECT w.trade_date, w.ts_code, w.factor, w.value AS raw, w.w AS winsorized, r.neutral, coalesce(abs(w.w - w.value) > 1e-8 + 1e-5 * abs(w.value), false) AS clipped FROM wins w LEFT JOIN r ON r.trade_date = w.trade_date AND r.ts_code = w.ts_code AND r.factor = w.factor)
    SELECT trade_date, ts_code, factor, raw, winsorized, neutral, CASE WHEN stddev_pop(neutral) OVER d > 1e-12 * (1 + abs(avg(neutral) OVER d)) THEN (neutral - avg(neutral) OVER d) / stddev_pop(neutral) OVER d END AS standardized, clipped FROM j WINDOW d AS (PARTITION BY trade_date, factor)""",
    "raw winsorized neutral standardized",
)
_WALK = "v AS (SELECT c.trade_date AS test_date, factor, avg(ic) FILTER (i.trade_date < c.trade_date - INTERVAL 6 MONTH AND i.trade_date + INTERVAL 1 MONTH < c.trade_date - INTERVAL 6 MONTH) AS train_ic, count(*) FILTER (i.trade_date < c.trade_date - INTERVAL 6 MONTH AND i.trade_date + INTERVAL 1 MONTH < c.trade_date - INTERVAL 6 MONTH) AS train_dates, avg(ic) FILTER (i.trade_date >= c.trade_date - INTERVAL 6 MONTH AND i.trade_date + INTERVAL 1 MONTH < c.trade_date) AS validation_ic FROM ic i JOIN calendar c ON i.trade_date >= c.trade_date - INTERVAL 30 MONTH AND i.trade_date < c.trade_date WHERE ic IS NOT NULL GROUP BY ALL), cov AS (SELECT trade_date AS test_date, factor, count(value)::DOUBLE / count(*) AS coverage FROM long GROUP BY ALL), e AS (SELECT v.*, coverage, coalesce(train_dates >= 6 AND coverage >= 0.3 AND abs(train_ic) >= 0.01 AND (validation_ic IS NULL OR sign(validation_ic) = sign(train_ic)), false) AS eligible FROM v LEFT JOIN cov USING (test_date, factor)), s AS (SELECT *, eligible AND row_number() OVER (PARTITION BY test_date, eligible ORDER BY abs(train_ic) DESC, factor) <= 12 AS selected FROM e), wf AS (SELECT *, CASE WHEN selected THEN abs(train_ic) / sum(abs(train_ic)) FILTER (selected) OVER (PARTITION BY test_date) END AS weight FROM s)"
oracle("walk_forward", f"{TABLES} calendar", f"WITH {PANEL}, {LONG}, {_RANKS}, {_WALK} SELECT test_date, factor, train_ic, train_dates, validation_ic, coverage, sign(train_ic)::DOUBLE AS direction, selected, weight, concat_ws(';', CASE WHEN abs(train_ic) > 0.3 THEN 'extreme_train_ic' END, CASE WHEN coalesce(coverage, 0) < 0.3 THEN 'low_coverage' END, CASE WHEN train_dates < 6 THEN 'insufficient_train_dates' END, CASE WHEN NOT bool_or(selected) OVER (PARTITION BY test_date) THEN 'no_factor_selected' END) AS anomalies FROM wf", "train_ic validation_ic coverage direction weight")
oracle("walk_forward_scores", f"{TABLES} calendar", f"WITH {PANEL}, {LONG}, {_RANKS}, {_WALK}, z AS (SELECT trade_date, ts_code, factor, CASE WHEN stddev_pop(value) OVER w > 1e-12 * (1 + abs(avg(value) OVER w)) THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z FROM long WINDOW w AS (PARTITION BY trade_date, factor)) SELECT trade_date, ts_code, sum(weight * sign(train_ic) * z) / sum(weight) AS score, count(*) AS factors FROM z JOIN wf ON z.trade_date = wf.test_date AND z.factor = wf.factor WHERE selected AND z IS NOT NULL GROUP BY ALL", "score")


@query("percent_ranks", "returns", "WITH v AS (SELECT * FROM returns WHERE ret IS NOT NULL) SELECT trade_date, ts_code, (rank() OVER (PARTITION BY trade_date ORDER BY ret) + (count(*) OVER (PARTITION BY trade_date, ret) - 1) / 2.0) / count(*) OVER (PARTITION BY trade_date) AS p FROM v", "p")
def percent_ranks(s: Star) -> DataFrame:
    return s.returns().where("ret is not null").select("trade_date", "ts_code", W.percent_rank_average("ret", ["trade_date"]).alias("p"))


@query("aligned_returns", "bench returns", "WITH b AS (SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS bench_ret FROM bench), m AS (SELECT trade_date, avg(ret) AS ret FROM returns GROUP BY trade_date) SELECT trade_date AS date, ret, bench_ret FROM m JOIN b USING (trade_date)", "ret bench_ret")
def aligned_returns(s: Star) -> DataFrame:
    b = s.benchmark().select(F.col("trade_date").alias("date"), (F.col("close") / F.lag("close").over(Window.orderBy("trade_date")) - 1).alias("bench_ret"))
    return joins.exact_alignment(s.returns().groupBy(F.col("trade_date").alias("date")).agg(F.avg("ret").alias("ret")), b)


_THIRD = "WITH {0}, keep AS (SELECT trade_date FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k FROM calendar) WHERE k % 3 = 1)"


@query("non_overlapping_groups", f"{TABLES} calendar", _THIRD.format(f"{PANEL}, {LONG}, {_GROUPS}") + ", m AS (SELECT trade_date, factor, " + ", ".join(f"avg(fwd) FILTER (g = {i}) AS Q{i}" for i in range(1, 6)) + " FROM grp SEMI JOIN keep USING (trade_date) GROUP BY ALL) SELECT *, Q5 - Q1 AS spread FROM m", "Q1 Q2 Q3 Q4 Q5 spread")
def non_overlapping_groups(s: Star) -> DataFrame:
    keep = joins.positions(s.calendar(), {}).where("position % 3 = 0")
    rows = long(s, "fwd").withColumn("target_return_end_date", F.add_months("trade_date", 1))
    return E.non_overlapping(rows, keep, "fwd")


@query("cumulative_groups", TABLES, f"WITH {PANEL}, {LONG}, {_GROUPS}, m AS (SELECT trade_date, factor, avg(fwd) FILTER (g = 1) AS Q1, avg(fwd) FILTER (g = 5) AS Q5 FROM grp GROUP BY ALL) SELECT factor, trade_date, exp(sum(ln(1 + Q1)) OVER w) AS Q1, exp(sum(ln(1 + Q5)) OVER w) AS Q5 FROM m WINDOW w AS (PARTITION BY factor ORDER BY trade_date ROWS UNBOUNDED PRECEDING)", "Q1 Q5", 4)
def cumulative_groups(s: Star) -> DataFrame:
    return E.cumulative_groups(E.group_returns(long(s, "fwd"), "fwd"), ["Q1", "Q5"], ["factor"])


@query("asof_industry_marks", sql="WITH m AS (SELECT c_nationkey AS k, c_custkey, c_acctbal FROM customer), q AS (SELECT s_nationkey AS k, s_suppkey, s_acctbal FROM supplier) SELECT s_suppkey, (SELECT max(c_acctbal) FROM m WHERE m.k = q.k AND c_acctbal <= s_acctbal) AS mark FROM q", digits=None)
def asof_industry_marks(s: Star) -> DataFrame:
    left = s.raw("supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", F.col("s_acctbal").alias("at"))
    right = s.raw("customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("mark"))
    return joins.as_of(left, right, "k", "at", "mark").select("s_suppkey", "mark")


@query("significant_weights")
def significant_weights(s: Star) -> DataFrame:
    return D.significant_weights(_monthly(s), D.inference_by_date(_monthly(s), s.calendar()), _one_trial(s), cap=0.5, most_q=0.5)


def _monthly(s: Star) -> DataFrame:
    return E.daily_ic(long(s, "fwd"), "fwd").withColumn("availability_date", F.add_months("trade_date", 1))


def _one_trial(s: Star) -> DataFrame:
    return D.kalman_forecasts(_monthly(s), s.calendar()).where("q = 0.001 and r = 0.01")


@query("dynamic_scores")
def dynamic_scores(s: Star) -> DataFrame:
    return E.weighted_scores(long(s), significant_weights(s).withColumn("selected", F.lit(True)))


@query("label_representation")
def label_representation(s: Star) -> DataFrame:
    from ..operators import text_events as V

    e = V.prepare(s.text_events(), refuse=False).where("event_id is not null")
    return V.representation(e, V.label(e).drop("cached", "cache_key"), "1").select("event_id", "stock_code", "sentiment", "score")


@query("table_fingerprints")
def table_fingerprints(s: Star) -> DataFrame:
    from ..sources.catalog import content_hash

    return s.spark.createDataFrame([(n, content_hash(s.raw(n))) for n in ("region", "nation", "supplier")], "name string, sha256 string")


@query("sample_bundle_bars", sql="SELECT CAST(12 AS BIGINT) AS assets, CAST(30 AS BIGINT) AS days, CAST(360 AS BIGINT) AS rows")
def sample_bundle_bars(s: Star) -> DataFrame:
    from ..sources.sample import sample_bundle

    b = sample_bundle(s.spark, 12, 30)["daily_bar"]
    return b.agg(F.count_distinct("ts_code").alias("assets"), F.count_distinct("trade_date").alias("days"), F.count("*").alias("rows"))



_PORTFOLIOS = " UNION ALL ".join(f"SELECT '{p}' AS portfolio, '{s}' AS scheme, {r}::BOOLEAN AS by_regime, {v}::BOOLEAN AS by_vol" for p, (s, r, v) in D.PORTFOLIOS.items())
_ABLATION = f"""WITH {PANEL}, {LONG}, {_RANKS}, {_GROUPS},
h AS (SELECT c.trade_date AS date, factor, i.trade_date AS known, ic, row_number() OVER (PARTITION BY c.trade_date, factor ORDER BY i.trade_date DESC) AS k FROM ic i JOIN calendar c ON i.trade_date + INTERVAL 1 MONTH < c.trade_date WHERE ic IS NOT NULL),
v AS (SELECT date, factor, 'static' AS scheme, avg(ic) AS v FROM h GROUP BY ALL UNION ALL SELECT date, factor, 'rule', avg(ic) FROM h WHERE k <= 12 GROUP BY ALL UNION ALL SELECT date, factor, 'kalman', list_reduce(list(ic ORDER BY known), lambda a, x: 0.9::DOUBLE * a + 0.1::DOUBLE * x) FROM h GROUP BY ALL),
w0 AS (SELECT date, scheme, factor, v / nullif(sum(abs(v)) OVER (PARTITION BY date, scheme), 0) AS weight FROM v),
sc AS (SELECT trade_date AS date, 1 - (row_number() OVER (ORDER BY trade_date) % 3) / 30.0 AS r, 1 - (row_number() OVER (ORDER BY trade_date) % 5) / 50.0 AS v FROM calendar),
p AS ({_PORTFOLIOS}),
w AS (SELECT portfolio, date, factor, weight * (CASE WHEN by_regime THEN coalesce(r, 1.0) ELSE 1.0 END) * (CASE WHEN by_vol THEN coalesce(sc.v, 1.0) ELSE 1.0 END) AS w FROM w0 JOIN p USING (scheme) LEFT JOIN sc USING (date)),
n AS (SELECT portfolio, date, lead(date) OVER (PARTITION BY portfolio ORDER BY date) AS nx FROM (SELECT DISTINCT portfolio, date FROM w)),
b AS (SELECT portfolio, nx AS date, factor, w AS p FROM w JOIN n USING (portfolio, date) WHERE nx IS NOT NULL),
sp AS (SELECT trade_date AS date, factor, avg(fwd) FILTER (g = 5) - avg(fwd) FILTER (g = 1) AS ret FROM grp GROUP BY ALL),
j AS (SELECT portfolio, date, factor, coalesce(w, 0) AS w, coalesce(p, 0) AS p FROM w FULL JOIN b USING (portfolio, date, factor)),
a AS (SELECT portfolio, j.date, sum(w * coalesce(ret, 0)) AS gross, sum(abs(w - p)) / 2 AS turnover FROM j LEFT JOIN sp ON sp.date = j.date AND sp.factor = j.factor GROUP BY ALL),
c AS (SELECT *, 2 * turnover * 0.0015 AS cost, gross - 2 * turnover * 0.0015 AS net FROM a),
lim AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT portfolio, min(date) AS lo, max(date) AS hi FROM c GROUP BY 1)),
f AS (SELECT c.* FROM c, lim WHERE date >= lo AND date <= hi)"""
oracle("ablation_accounting", f"{TABLES} calendar", f"{_ABLATION} SELECT portfolio, date, gross, turnover, cost, net FROM f", "gross turnover cost net")
oracle("cost_sensitivity", f"{TABLES} calendar", f"{_ABLATION} SELECT portfolio, cost_scale, avg(gross - cost * cost_scale) AS mean_net FROM f, (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS cost_scale) GROUP BY ALL", "cost_scale mean_net")
