"""Alignment, windows and factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import windows as W
from ..operators import factors, joins, universe
from ..sources.star import Star
from .registry import query

LAST = "ROWS BETWEEN {n} PRECEDING AND CURRENT ROW"


def roll(fn: str, x: str, n: int, least: int, by: str = "ts_code", order: str = "trade_date") -> str:
    over = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {least} THEN {fn}({x}) {over} END"


@query("scan_bars", "bar", "SELECT trade_date, ts_code, open, high, low, close, volume, amount, adj_factor FROM bar", digits=None)
def scan_bars(s: Star) -> DataFrame:
    return s.bar()


@query("scalar_ratios", "basic", "SELECT trade_date, ts_code, CASE WHEN total_mv > 0 THEN ln(total_mv) END AS size, 1.0 / pb AS bp, 1.0 / pe_ttm AS ep, net_mf_amount / nullif(total_mv, 0) AS flow_share FROM basic", "size bp ep flow_share")
def scalar_ratios(s: Star) -> DataFrame:
    return s.basic().select("trade_date", "ts_code", S.log_size("total_mv").alias("size"), S.reciprocal("pb").alias("bp"), S.reciprocal("pe_ttm").alias("ep"), S.safe_divide("net_mf_amount", "total_mv").alias("flow_share"))


@query("price_limit_rates", sql="SELECT p_partkey, CASE WHEN p_size = 1 THEN 0.05 WHEN code LIKE '688%' THEN 0.2 WHEN code LIKE '300%' THEN 0.2 WHEN code LIKE '8%' OR code LIKE '4%' THEN 0.3 ELSE 0.1 END::DOUBLE AS rate FROM (SELECT p_partkey, p_size, substr(CAST(300000 + (p_partkey * 7919) % 600000 AS VARCHAR), 1, 6) AS code FROM part)", doubles="rate")
def price_limit_rates(s: Star) -> DataFrame:
    p = s.raw("part").select("p_partkey", "p_size", (300000 + (F.col("p_partkey") * 7919) % 600000).cast("string").alias("code"))
    return p.select("p_partkey", S.exchange_limit_rate("code", F.to_date(F.lit("2022-01-04")), F.col("p_size") == 1).alias("rate"))


@query("code_normalisation", sql="SELECT c_custkey, lpad(CAST(c_custkey * 97 AS VARCHAR), 6, '0') || CASE WHEN substr(lpad(CAST(c_custkey * 97 AS VARCHAR), 6, '0'), 1, 1) IN ('5', '6', '9') THEN '.SH' ELSE '.SZ' END AS ts_code FROM customer")
def code_normalisation(s: Star) -> DataFrame:
    return s.raw("customer").select("c_custkey", S.normalize_code(F.col("c_custkey") * 97).alias("ts_code"))


@query("text_keys", sql="SELECT doc_id, sha256(source) AS source_sha, length(sha256(text)) = 64 AS shaped, CASE WHEN contains(lower(text), 'licen') THEN 'licence' WHEN contains(lower(text), 'token') OR contains(lower(text), '@') THEN 'contact' ELSE 'other' END AS label FROM documents")
def text_keys(s: Star) -> DataFrame:
    d = s.raw("documents")
    return d.select("doc_id", S.text_sha256("source").alias("source_sha"), S.is_sha256(S.text_sha256("text")).alias("shaped"), S.keyword_label("text", [("licence", ["licen"]), ("contact", ["token", "@"])]).alias("label"))


@query("sentiment_and_decay", "news", "SELECT event_id, CASE sentiment WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END * confidence AS score, pow(0.5, date_diff('day', publish_date, DATE '2024-02-01') / 7.0) AS weight, CASE WHEN confidence <= 0.5 THEN 'low' WHEN confidence <= 0.8 THEN 'medium' WHEN confidence IS NOT NULL THEN 'high' END AS band FROM news", "score weight")
def sentiment_and_decay(s: Star) -> DataFrame:
    age = F.datediff(F.to_date(F.lit("2024-02-01")), "publish_date")
    return s.news().select("event_id", S.sentiment_score("sentiment", F.col("confidence")).alias("score"), S.half_life_weight(age, F.lit(7.0)).alias("weight"), S.confidence_band("confidence").alias("band"))


@query("log_returns", "returns", "SELECT trade_date, ts_code, ln(1 + greatest(ret, -0.999999)) AS log_ret, CASE WHEN ret IS NOT NULL THEN least(greatest(ret, -0.1), 0.1) END AS clipped FROM returns WHERE ret IS NOT NULL", "log_ret clipped")
def log_returns(s: Star) -> DataFrame:
    return s.returns().where("ret is not null").select("trade_date", "ts_code", S.log_return("ret").alias("log_ret"), S.clip("ret", -0.1, 0.1).alias("clipped"))


@query("vector_components", sql="SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS emb_0, CAST(embedding[2] AS DOUBLE) AS emb_1, CAST(embedding[3] AS DOUBLE) AS emb_2 FROM embeddings", doubles="emb_0 emb_1 emb_2")
def vector_components(s: Star) -> DataFrame:
    v = s.raw("embeddings").select("vec_id", F.to_json(F.slice("embedding", 1, 3).cast("array<double>")).alias("vector_json"))
    return S.expand_vector(v, dimension=3).drop("vector_json")


@query("next_sessions", "calendar", """
, e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT d, (SELECT min(trade_date) FROM calendar c WHERE c.trade_date > e.d) AS next_session FROM e""".replace(", e AS", "WITH e AS", 1))
def next_sessions(s: Star) -> DataFrame:
    d = s.raw("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return joins.next_session(d, s.calendar(), "d")


@query("delayed_sessions", "calendar", "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS position, lead(trade_date, 1) OVER (ORDER BY trade_date) AS execution_date, lead(trade_date, 3) OVER (ORDER BY trade_date) AS delayed FROM calendar")
def delayed_sessions(s: Star) -> DataFrame:
    return joins.positions(s.calendar(), {"execution_date": 1, "delayed": 3})


@query("quarter_end_sessions", sql="WITH c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS trade_date FROM orders) SELECT max(trade_date) AS trade_date FROM c GROUP BY date_trunc('month', trade_date)")
def quarter_end_sessions(s: Star) -> DataFrame:
    return joins.month_end_sessions(s.raw("orders").select(F.col("o_orderdate").cast("date").alias("trade_date")).distinct())


@query("panel_timing", "bar calendar", "WITH c AS (SELECT trade_date, lead(trade_date, 1) OVER (ORDER BY trade_date) AS execution_date, lead(trade_date, 3) OVER (ORDER BY trade_date) AS target_return_end_date FROM calendar) SELECT b.trade_date, ts_code, b.trade_date AS signal_date, execution_date, target_return_end_date FROM bar b LEFT JOIN c USING (trade_date)")
def panel_timing(s: Star) -> DataFrame:
    return joins.attach_timing(s.bar().select("trade_date", "ts_code"), s.calendar(), 3)


@query("forward_returns", "bar", "SELECT trade_date, ts_code, lead(close, 1) OVER w / close - 1 AS f1, lead(close, 5) OVER w / close - 1 AS f5 FROM bar WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)", "f1 f5")
def forward_returns(s: Star) -> DataFrame:
    b = s.bar()
    return joins.forward_return(joins.forward_return(b, "close", 1, "f1"), "close", 5, "f5").select("trade_date", "ts_code", "f1", "f5")


@query("forward_returns_by_calendar", "bar calendar", "WITH c AS (SELECT trade_date, lead(trade_date, 3) OVER (ORDER BY trade_date) AS e FROM calendar) SELECT b.trade_date, b.ts_code, l.close / b.close - 1 AS f3 FROM bar b JOIN c ON b.trade_date = c.trade_date LEFT JOIN bar l ON l.ts_code = b.ts_code AND l.trade_date = c.e", "f3")
def forward_returns_by_calendar(s: Star) -> DataFrame:
    return joins.forward_return_by_calendar(s.bar(), s.calendar(), "close", 3, "f3").select("trade_date", "ts_code", "f3")


@query("asof_financials", "bar financial", "SELECT b.trade_date, b.ts_code, f.report_period, f.roe, f.gross_margin FROM bar b ASOF LEFT JOIN financial f ON b.ts_code = f.ts_code AND b.trade_date >= f.usable_date", "roe gross_margin")
def asof_financials(s: Star) -> DataFrame:
    f = s.financial().select("ts_code", "usable_date", "report_period", "roe", "gross_margin")
    return joins.as_of(s.bar().select("trade_date", "ts_code"), f, "ts_code", "trade_date", "usable_date").drop("usable_date")


@query("active_members", "member calendar", "SELECT c.trade_date, m.ts_code FROM calendar c JOIN member m ON m.in_date <= c.trade_date AND (m.out_date IS NULL OR c.trade_date < m.out_date)")
def active_members(s: Star) -> DataFrame:
    return joins.active_members(s.calendar(), s.member())


@query("interval_anti_join", "bar member", "SELECT trade_date, ts_code FROM bar b WHERE NOT EXISTS (SELECT 1 FROM member m WHERE m.ts_code = b.ts_code AND m.in_date + 400 <= b.trade_date AND b.trade_date < m.in_date + 700)")
def interval_anti_join(s: Star) -> DataFrame:
    spans = s.member().select("ts_code", F.date_add("in_date", 400).alias("start_date"), F.date_add("in_date", 700).alias("end_date"))
    return joins.outside_intervals(s.bar().select("trade_date", "ts_code"), spans, "start_date", "end_date")


@query("universe_filter", "bar member calendar", f"""
WITH c AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS p FROM calendar),
l AS (SELECT ts_code, min(p) AS since, any_value(out_date) AS gone FROM member JOIN c ON c.trade_date >= in_date GROUP BY ts_code),
a AS (SELECT b.trade_date, b.ts_code, amount FROM bar b JOIN c USING (trade_date) JOIN l USING (ts_code) WHERE p - since >= 6 AND (gone IS NULL OR b.trade_date < gone)),
r AS (SELECT *, {roll('avg', 'amount', 20, 5)} AS m FROM a)
SELECT trade_date, ts_code FROM r WHERE m >= 200000""")
def universe_filter(s: Star) -> DataFrame:
    m = s.member().select("ts_code", F.col("in_date").alias("list_date"), F.col("out_date").alias("delist_date"))
    return universe.filter_universe(s.bar(), s.calendar(), basics=m, min_sessions=6, min_amount=200000).select("trade_date", "ts_code")


@query("tradability", "bar", "WITH l AS (SELECT *, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS pc FROM bar) SELECT trade_date, ts_code, coalesce(open < pc * 1.1, true) AS can_buy, coalesce(open > pc * 0.9, true) AS can_sell, CASE WHEN open >= pc * 1.1 THEN 'limit_up' END AS buy_block_reason, CASE WHEN open <= pc * 0.9 THEN 'limit_down' END AS sell_block_reason FROM l")
def tradability(s: Star) -> DataFrame:
    b = universe.mark_tradability(s.bar().withColumn("ts_code", F.concat(F.lit("1"), "ts_code")))  # a main-board prefix
    return b.select("trade_date", F.expr("substring(ts_code, 2)").alias("ts_code"), "can_buy", "can_sell", "buy_block_reason", "sell_block_reason")


@query("panel_left_joins", "bar basic industry", "SELECT b.trade_date, b.ts_code, b.close, s.pb, i.industry_code FROM bar b LEFT JOIN basic s ON b.trade_date = s.trade_date AND b.ts_code = s.ts_code LEFT JOIN industry i ON b.ts_code = i.ts_code", digits=None)
def panel_left_joins(s: Star) -> DataFrame:
    return s.bar().join(s.basic(), ["trade_date", "ts_code"], "left").join(s.industry(), "ts_code", "left").select("trade_date", "ts_code", "close", "pb", "industry_code")


@query("monthly_labels", "calendar", """
WITH n AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nx FROM calendar)
SELECT a.trade_date AS signal_date, a.nx AS execution_date, b.trade_date AS label_end_date, b.nx AS availability_date
FROM n a JOIN n b ON b.trade_date = a.nx WHERE date_trunc('month', b.trade_date) = date_trunc('month', a.trade_date) + INTERVAL 1 MONTH AND b.nx IS NOT NULL""")
def monthly_labels(s: Star) -> DataFrame:
    return joins.monthly_labels(s.calendar())


@query("label_returns", "bar calendar", """
WITH n AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nx FROM calendar),
l AS (SELECT a.trade_date AS signal_date, a.nx AS execution_date, b.trade_date AS label_end_date, b.nx AS availability_date FROM n a JOIN n b ON b.trade_date = a.nx WHERE date_trunc('month', b.trade_date) = date_trunc('month', a.trade_date) + INTERVAL 1 MONTH AND b.nx IS NOT NULL)
SELECT h.ts_code, signal_date, execution_date, label_end_date, availability_date, c.close / o.open - 1 AS label_return
FROM bar h JOIN l ON h.trade_date = l.signal_date LEFT JOIN bar o ON o.ts_code = h.ts_code AND o.trade_date = execution_date LEFT JOIN bar c ON c.ts_code = h.ts_code AND c.trade_date = label_end_date""", "label_return")
def label_returns(s: Star) -> DataFrame:
    return joins.label_returns(joins.monthly_labels(s.calendar()), s.bar())


_DAYS = "days AS (SELECT DISTINCT publish_date AS trade_date FROM news WHERE dayofweek(publish_date) NOT IN (0, 6))"


@query("event_availability", "news", f"WITH {_DAYS} SELECT event_id, CASE WHEN strftime(publish_time, '%H:%M:%S') <= '15:00:00' AND publish_date IN (SELECT trade_date FROM days) THEN publish_date ELSE (SELECT min(trade_date) FROM days WHERE trade_date > publish_date) END AS available_date FROM news")
def event_availability(s: Star) -> DataFrame:
    return joins.event_availability(s.news(), sessions(s)).select("event_id", "available_date")


def sessions(s: Star) -> DataFrame:
    """Working days among the events' days."""
    return s.news().select(F.col("publish_date").alias("trade_date")).distinct().where(F.weekday("trade_date") < 5)


@query("trailing_event_sum", "news", f"WITH {_DAYS}, e AS (SELECT stock_code, CASE WHEN strftime(publish_time, '%H:%M:%S') <= '15:00:00' AND publish_date IN (SELECT trade_date FROM days) THEN publish_date ELSE (SELECT min(trade_date) FROM days WHERE trade_date > publish_date) END AS a, CASE sentiment WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END * confidence AS v FROM news) SELECT stock_code, trade_date, sum(v) AS event_sentiment, count(*) AS event_count FROM e JOIN days ON a <= trade_date AND trade_date <= a + 20 GROUP BY ALL", "event_sentiment")
def trailing_event_sum(s: Star) -> DataFrame:
    days = sessions(s)
    e = joins.event_availability(s.news(), days).withColumn("v", S.sentiment_score("sentiment", F.col("confidence")))
    return joins.trailing_event_sum(e, days, "v")


@query("near_duplicate_texts")
def near_duplicate_texts(s: Star) -> DataFrame:
    """A row a text: its class of equal texts and how many texts of a week before and after are alike."""
    return joins.near_duplicates(s.text_events(), days=7, threshold=0.85)


@query("key_coverage", "bar financial", "SELECT count(*) AS rows, avg(CASE WHEN f.ts_code IS NULL THEN 1.0 ELSE 0.0 END) AS missing_share FROM bar b LEFT JOIN (SELECT DISTINCT ts_code, usable_date AS trade_date FROM financial) f ON b.ts_code = f.ts_code AND b.trade_date = f.trade_date", "missing_share")
def key_coverage(s: Star) -> DataFrame:
    return joins.key_coverage(s.bar(), s.financial().select("ts_code", F.col("usable_date").alias("trade_date")), ["ts_code", "trade_date"])


_W = "OVER (PARTITION BY ts_code ORDER BY trade_date)"


@query("momentum_factors", "bar", f"SELECT trade_date, ts_code, close / lag(close, 20) {_W} - 1 AS mom_20, lag(close, 5) {_W} / lag(close, 60) {_W} - 1 AS mom_60_skip5, -(close / lag(close, 5) {_W} - 1) AS rev_5 FROM bar", "mom_20 mom_60_skip5 rev_5")
def momentum_factors(s: Star) -> DataFrame:
    return priced(s).select("trade_date", "ts_code", "mom_20", "mom_60_skip5", "rev_5")


def priced(s: Star) -> DataFrame:
    """Bars with all price and liquidity factors."""
    b = factors.add_prices(s.bar()).join(s.basic().select("trade_date", "ts_code", "turnover_rate", "net_mf_amount"), ["trade_date", "ts_code"])
    return factors.price_factors(b)


@query("risk_factors", "returns", f"""
WITH m AS (SELECT *, avg(ret) OVER (PARTITION BY trade_date) AS mkt FROM returns),
a AS (SELECT *, {roll('stddev_samp', 'ret', 20, 10)} AS vol_20, {roll('avg', 'ret * mkt', 60, 30)} AS xy, {roll('avg', 'ret', 60, 30)} AS x, {roll('avg', 'mkt', 60, 30)} AS y, {roll('avg', 'mkt * mkt', 60, 30)} AS yy FROM m),
b AS (SELECT *, (xy - x * y) / nullif(yy - y * y, 0) AS beta_60 FROM a)
SELECT trade_date, ts_code, vol_20, beta_60, {roll('stddev_samp', '(ret - beta_60 * mkt)', 60, 30)} AS idio_vol_60 FROM b""", "vol_20 beta_60 idio_vol_60")
def risk_factors(s: Star) -> DataFrame:
    return priced(s).select("trade_date", "ts_code", "vol_20", "beta_60", "idio_vol_60")


@query("liquidity_factors", "returns basic", f"""
WITH j AS (SELECT r.trade_date, r.ts_code, ret, amount, turnover_rate FROM returns r JOIN basic b ON r.trade_date = b.trade_date AND r.ts_code = b.ts_code),
a AS (SELECT *, {roll('avg', 'turnover_rate', 20, 10)} AS turnover_20, {roll('avg', 'amount', 20, 10)} AS am, {roll('avg', '(abs(ret) / nullif(amount, 0))', 20, 10)} AS amihud_20 FROM j)
SELECT trade_date, ts_code, turnover_20, turnover_20 / nullif(lag(turnover_20, 20) {_W}, 0) - 1 AS turnover_chg_20, am / nullif(lag(am, 20) {_W}, 0) - 1 AS amount_mom_20, amihud_20 * 1000000 AS amihud_20 FROM a""", "turnover_20 turnover_chg_20 amount_mom_20 amihud_20")
def liquidity_factors(s: Star) -> DataFrame:
    return priced(s).select("trade_date", "ts_code", "turnover_20", "turnover_chg_20", "amount_mom_20", (F.col("amihud_20") * 1000000).alias("amihud_20"))


@query("flow_factors", "bar basic", f"SELECT trade_date, ts_code, {roll('sum', 'f', 5, 3)} AS mf_5, {roll('sum', 'f', 20, 10)} AS mf_20 FROM (SELECT b.trade_date, b.ts_code, net_mf_amount / nullif(amount, 0) AS f FROM bar b JOIN basic s ON b.trade_date = s.trade_date AND b.ts_code = s.ts_code)", "mf_5 mf_20")
def flow_factors(s: Star) -> DataFrame:
    b = s.bar().join(s.basic().select("trade_date", "ts_code", "net_mf_amount"), ["trade_date", "ts_code"])
    return factors.flow_factors(b).select("trade_date", "ts_code", "mf_5", "mf_20")


@query("report_factors", "financial", f"SELECT ts_code, usable_date, roe - lag(roe) OVER w AS roe_delta, -({roll('stddev_samp', 'gross_margin', 4, 2, order='usable_date')}) AS gross_margin_stability FROM financial WINDOW w AS (PARTITION BY ts_code ORDER BY usable_date)", "roe_delta gross_margin_stability")
def report_factors(s: Star) -> DataFrame:
    return factors.report_factors(s.financial()).select("ts_code", "usable_date", "roe_delta", "gross_margin_stability")


@query("fundamental_panel", "bar financial", f"""
WITH f AS (SELECT ts_code, usable_date, roe, roe - lag(roe) OVER (PARTITION BY ts_code ORDER BY usable_date) AS roe_delta, debt_ratio FROM financial)
SELECT b.trade_date, b.ts_code, roe, roe_delta, -debt_ratio AS debt_ratio FROM bar b ASOF LEFT JOIN f ON b.ts_code = f.ts_code AND b.trade_date >= f.usable_date""", "roe roe_delta debt_ratio")
def fundamental_panel(s: Star) -> DataFrame:
    p = factors.fundamental_factors(s.bar().select("trade_date", "ts_code"), s.financial())
    return factors.apply_directions(p, ["roe", "roe_delta", "debt_ratio"]).select("trade_date", "ts_code", "roe", "roe_delta", "debt_ratio")


@query("average_ranks", "returns", "SELECT trade_date, ts_code, CASE WHEN ret IS NOT NULL THEN rank() OVER (PARTITION BY trade_date, ret IS NULL ORDER BY ret) + (count(*) OVER (PARTITION BY trade_date, ret) - 1) / 2.0 END AS r FROM returns", "r")
def average_ranks(s: Star) -> DataFrame:
    return s.returns().select("trade_date", "ts_code", W.average_rank("ret", ["trade_date"]).alias("r"))


@query("rank_buckets", "returns", "WITH v AS (SELECT trade_date, ts_code, ret, row_number() OVER (PARTITION BY trade_date ORDER BY ret, ts_code) AS rn, count(*) OVER (PARTITION BY trade_date) AS n FROM returns WHERE ret IS NOT NULL) SELECT trade_date, ts_code, greatest(1, ((rn - 1) * 5 + greatest(n - 2, 0)) // greatest(n - 1, 1)) AS bucket FROM v")
def rank_buckets(s: Star) -> DataFrame:
    return s.returns().where("ret is not null").select("trade_date", "ts_code", W.first_rank_bucket("ret", 5, ["trade_date"], "ts_code").alias("bucket"))


@query("drawdowns", "bench", "SELECT trade_date, close / max(close) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bench", "dd")
def drawdowns(s: Star) -> DataFrame:
    return s.benchmark().select("trade_date", W.drawdown("close", Window.orderBy("trade_date")).alias("dd"))


@query("drawdown_episodes", "bar", """
WITH d AS (SELECT ts_code, trade_date, close / max(close) OVER w - 1 AS dd, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS rn FROM bar WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS peak FROM d),
g AS (SELECT ts_code, peak, min(trade_date) AS start, arg_min(trade_date, (dd, trade_date)) FILTER (dd < 0) AS trough, min(dd) AS depth, min(rn) AS f, max(rn) AS l FROM p GROUP BY ts_code, peak),
j AS (SELECT g.*, n.trade_date AS recovery FROM g LEFT JOIN p n ON n.ts_code = g.ts_code AND n.peak = g.peak + 1 AND n.dd >= 0 WHERE depth < 0),
r AS (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY depth, start) AS k FROM j)
SELECT ts_code, start, trough, recovery, depth, l - f + CASE WHEN recovery IS NULL THEN 0 ELSE 1 END AS duration FROM r WHERE k <= 3""", "depth")
def drawdown_episodes(s: Star) -> DataFrame:
    return W.drawdown_episodes(s.bar(), "close", "trade_date", ["ts_code"], top=3)


@query("cumulative_returns", "returns", "SELECT trade_date, ts_code, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) AS grown FROM returns", "grown")
def cumulative_returns(s: Star) -> DataFrame:
    return s.returns().select("trade_date", "ts_code", W.cumulative_return("ret", W.by_entity()).alias("grown"))


@query("longest_missing_runs", "returns calendar", """
WITH g AS (SELECT c.trade_date, s.ts_code, r.close IS NULL AS hit FROM calendar c CROSS JOIN (SELECT DISTINCT ts_code FROM returns) s LEFT JOIN returns r ON r.trade_date = c.trade_date AND r.ts_code = s.ts_code),
i AS (SELECT ts_code, hit, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) - row_number() OVER (PARTITION BY ts_code, hit ORDER BY trade_date) AS island FROM g),
n AS (SELECT ts_code, hit, count(*) AS k FROM i GROUP BY ts_code, hit, island)
SELECT ts_code, coalesce(max(CASE WHEN hit THEN k END), 0) AS longest FROM n GROUP BY ts_code""")
def longest_missing_runs(s: Star) -> DataFrame:
    grid = s.calendar().crossJoin(F.broadcast(s.raw("supplier").select(Star.code("s_suppkey").alias("ts_code")).join(s.lines().select("ts_code").distinct(), "ts_code", "left_semi")))
    rows = grid.join(s.bar().select("trade_date", "ts_code", "close"), ["trade_date", "ts_code"], "left")
    return W.longest_run(rows, F.col("close").isNull(), ["ts_code"], "trade_date")


@query("interval_overlaps", sql="WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) + 90 END AS e, o_orderkey FROM orders), w AS (SELECT o_custkey, s < max(coalesce(e, DATE '9999-12-31')) OVER (PARTITION BY o_custkey ORDER BY s, coalesce(e, DATE '9999-12-31') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM o) SELECT o_custkey, count(*) FILTER (hit) AS overlaps FROM w GROUP BY o_custkey")
def interval_overlaps(s: Star) -> DataFrame:
    o = s.raw("orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("s"), F.when(F.col("o_orderstatus") != "P", F.date_add(F.col("o_orderdate").cast("date"), 90)).alias("e"))
    return W.overlapping_intervals(o, ["o_custkey"], "s", "e")


@query("spike_counts", "bar", f"WITH c AS (SELECT ts_code, close / nullif(lag(close) {_W}, 0) AS k, amount / nullif(lag(amount) {_W}, 0) AS a FROM bar) SELECT ts_code, count(*) FILTER (k > 1.5) AS price_jumps, count(*) FILTER (a > 20) AS amount_spikes FROM c GROUP BY ts_code")
def spike_counts(s: Star) -> DataFrame:
    w = W.by_entity()
    c = s.bar().select("ts_code", S.safe_divide("close", F.lag("close").over(w)).alias("k"), S.safe_divide("amount", F.lag("amount").over(w)).alias("a"))
    return c.groupBy("ts_code").agg(F.count_if(F.col("k") > 1.5).alias("price_jumps"), F.count_if(F.col("a") > 20).alias("amount_spikes"))


@query("group_membership_turnover", "returns", """
WITH v AS (SELECT trade_date, ts_code, greatest(1, ((row_number() OVER (PARTITION BY trade_date ORDER BY ret, ts_code) - 1) * 5 + greatest(count(*) OVER (PARTITION BY trade_date) - 2, 0)) // greatest(count(*) OVER (PARTITION BY trade_date) - 1, 1)) AS g FROM returns WHERE ret IS NOT NULL),
s AS (SELECT g, trade_date, list(DISTINCT ts_code) AS m FROM v GROUP BY g, trade_date),
l AS (SELECT *, lag(m) OVER (PARTITION BY g ORDER BY trade_date) AS b FROM s)
SELECT g AS "group", trade_date, len(m) AS n, CASE WHEN b IS NOT NULL THEN 1 - len(list_intersect(m, b))::DOUBLE / (len(m) + len(b) - len(list_intersect(m, b))) END AS turnover FROM l""", "turnover")
def group_membership_turnover(s: Star) -> DataFrame:
    v = s.returns().where("ret is not null").withColumn("group", W.first_rank_bucket("ret", 5, ["trade_date"], "ts_code"))
    return W.membership_turnover(v, ["group"], "trade_date", "ts_code")


@query("ewma_levels")
def ewma_levels(s: Star) -> DataFrame:
    seq = F.transform(F.array_sort(F.collect_list(F.struct("trade_date", "close"))), lambda x: x["close"])
    return s.bar().groupBy("ts_code").agg(seq.alias("xs")).select("ts_code", W.ewma_last("xs", 0.06).alias("level"))


@query("latest_orders", sql="SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def latest_orders(s: Star) -> DataFrame:
    return W.keep_one(s.raw("orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")
