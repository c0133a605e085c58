"""SQL of queries that other modules register: models, samples, texts, streams, as DuckDB works them out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import dynamic as D
from ..operators import evaluation as E
from ..operators import factors, joins
from ..operators import models as M
from ..operators import text_events as V
from ..sources import catalog
from ..sources.star import Star
from .registry import oracle, query
from .research_queries import _GROUPS, _RANKS, FACTORS, LONG, PANEL, TABLES, long

# ------------------------------------------------------------------ models

_GRID = ", ".join(f"({q}::DOUBLE, {r}::DOUBLE)" for q in D.GRID_Q for r in D.GRID_R)
# The filter runs once along each factor; a date takes the state after the last value that it knows.
oracle("kalman_grid", f"{TABLES} calendar", f"WITH RECURSIVE {PANEL}, {LONG}, {_RANKS}, v AS (SELECT factor, CAST(trade_date + INTERVAL 1 MONTH AS DATE) AS a, ic, row_number() OVER (PARTITION BY factor ORDER BY trade_date) AS k FROM ic WHERE ic IS NOT NULL), grid(q, r) AS (VALUES {_GRID}), f AS (SELECT factor, q, r, k, a, ic AS m, (10 * r + q) * r / (10 * r + q + r) AS p FROM v, grid WHERE k = 1 UNION ALL SELECT f.factor, f.q, f.r, v.k, v.a, m + (p + f.q) / (p + f.q + f.r) * (ic - m), (p + f.q) * f.r / (p + f.q + f.r) FROM f JOIN v ON v.factor = f.factor AND v.k = f.k + 1), d AS (SELECT trade_date, factor, q, r FROM calendar, (SELECT DISTINCT factor, q, r FROM f)) SELECT d.trade_date AS test_date, d.factor, d.q, d.r, m AS forecast, p + d.q + d.r AS variance, k AS n FROM d ASOF JOIN f ON d.factor = f.factor AND d.q = f.q AND d.r = f.r AND d.trade_date > f.a", "forecast variance")

_SPREADS = f"{PANEL}, {LONG}, {_GROUPS}, s AS (SELECT trade_date, factor, avg(fwd) FILTER (g = 5) - avg(fwd) FILTER (g = 1) AS r FROM grp GROUP BY ALL HAVING r IS NOT NULL)"
oracle("overfitting", TABLES, f"WITH {PANEL}, {LONG}, {_GROUPS}, s AS (SELECT trade_date, factor, avg(fwd) FILTER (g = 5) - avg(fwd) FILTER (g = 1) AS r FROM grp GROUP BY ALL HAVING r IS NOT NULL), b AS (SELECT factor, r, CAST(floor((dense_rank() OVER (ORDER BY trade_date) - 1) * 8 / (SELECT count(DISTINCT trade_date) FROM s)) AS INT) AS b FROM s), m AS (SELECT factor, b, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM b GROUP BY 1, 2), halves AS (SELECT i FROM range(256) AS t(i) WHERE bit_count(i) = 4), p AS (SELECT i, factor, " + ", ".join(f"sum({c}) FILTER ({'' if side == 'u' else 'NOT '}((i >> b) & 1 = 1)) AS {side}{c}" for side in "uv" for c in "nsq") + " FROM m, halves GROUP BY 1, 2), x AS (SELECT i, factor, " + ", ".join(f"{s}s / {s}n / sqrt(({s}q - {s}s * {s}s / {s}n) / ({s}n - 1)) AS {c}" for s, c in (("u", "x"), ("v", "y"))) + " FROM p), o AS (SELECT *, greatest(least((rank() OVER (PARTITION BY i ORDER BY y) + (count(*) OVER (PARTITION BY i, y) - 1) / 2.0) / count(*) OVER (PARTITION BY i), 1 - 1e-6), 1e-6) AS w, row_number() OVER (PARTITION BY i ORDER BY x DESC, factor) AS k FROM x WHERE x IS NOT NULL AND y IS NOT NULL) SELECT count(*) AS splits, avg(CASE WHEN ln(w / (1 - w)) <= 0 THEN 1.0 ELSE 0.0 END) AS pbo FROM o WHERE k = 1", "pbo")



@query("strategy_audit", TABLES, f"WITH {_SPREADS}, w AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT factor, min(trade_date) AS a, max(trade_date) AS b FROM s GROUP BY 1)), c AS (SELECT s.* FROM s, w WHERE trade_date BETWEEN a AND b) SELECT 'deflated_sharpe' AS audit_type, factor AS model, count(*) AS observations, count(DISTINCT date_trunc('month', trade_date)) AS oos_months, CAST(27 AS BIGINT) AS trial_count FROM c GROUP BY factor UNION ALL SELECT 'probability_of_backtest_overfitting', 'all_strategies', count(DISTINCT trade_date), count(DISTINCT date_trunc('month', trade_date)), 27 FROM c")
def strategy_audit(s: Star) -> DataFrame:
    """Factors' spreads as strategies; the probabilities are tested by hand."""
    g = E.group_returns(long(s, "fwd"), "fwd").select(F.col("trade_date").alias("date"), F.col("factor").alias("strategy"), F.col("spread").alias("ret"))
    return D.strategy_audit(g, 27, 12).drop("dsr_probability", "pbo", "status")


_PAIRS = [(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i:]]
_PAIR = "CASE WHEN min(CASE WHEN {b} IS NOT NULL THEN {a} END) < max(CASE WHEN {b} IS NOT NULL THEN {a} END) AND min(CASE WHEN {a} IS NOT NULL THEN {b} END) < max(CASE WHEN {a} IS NOT NULL THEN {b} END) THEN regr_sxy({b}, {a}) / sqrt(regr_sxx({b}, {a}) * regr_syy({b}, {a})) END"
oracle("average_date_correlation", TABLES, f"WITH {PANEL}, r AS (SELECT trade_date, " + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN rank() OVER (PARTITION BY trade_date, {f} IS NULL ORDER BY {f}) + (count(*) OVER (PARTITION BY trade_date, {f}) - 1) / 2.0 END AS {f}" for f in FACTORS) + " FROM panel), c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {_PAIR.format(a=a, b=b)} AS corr FROM r GROUP BY trade_date" for a, b in _PAIRS) + ') SELECT "left", "right", avg(corr) AS corr FROM c GROUP BY 1, 2', "corr")

oracle("baseline_forecasts", "bench", "WITH o AS (SELECT *, row_number() OVER (ORDER BY trade_date) AS k FROM (SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS x FROM bench) WHERE x IS NOT NULL), p AS (SELECT t.x AS actual, l.x AS lag_1, (SELECT avg(x) FROM o WHERE k < t.k) AS historical_mean, (SELECT avg(x) FROM o WHERE k < t.k AND k >= t.k - 12) AS rolling_12, (SELECT avg(x) FROM o WHERE k < t.k AND k >= t.k - 24) AS rolling_24, (SELECT list_reduce(list(x ORDER BY k), lambda a, c: 0.8 * a + 0.2 * c) FROM o WHERE k < t.k) AS ewma, (SELECT regr_intercept(c.x, a.x) + regr_slope(c.x, a.x) * l.x FROM o a JOIN o c ON c.k = a.k + 1 WHERE c.k < t.k) AS ar_1 FROM o t JOIN o l ON l.k = t.k - 1 WHERE t.k > 12), f AS (SELECT model, actual, forecast FROM p UNPIVOT (forecast FOR model IN (lag_1, historical_mean, rolling_12, rolling_24, ewma, ar_1))), r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY actual) + (count(*) OVER (PARTITION BY model, actual) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY model ORDER BY forecast) + (count(*) OVER (PARTITION BY model, forecast) - 1) / 2.0 AS rf FROM f) SELECT 'benchmark' AS series, model, count(*) AS n, sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse, avg(abs(actual - forecast)) AS mae, avg(CASE WHEN sign(actual) = sign(forecast) THEN 1.0 ELSE 0.0 END) AS direction_accuracy, CASE WHEN min(ra) < max(ra) AND min(rf) < max(rf) THEN regr_sxy(rf, ra) / sqrt(regr_sxx(rf, ra) * regr_syy(rf, ra)) END AS rank_corr FROM r GROUP BY model", "rmse mae direction_accuracy rank_corr")

oracle("stream_forecasts", "news", "SELECT stock_code AS series, count(*) AS rows, count(DISTINCT publish_time) AS accepted FROM news GROUP BY 1")

# ------------------------------------------------------------------ samples

oracle("seeded_sample", "", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY md5('42/' || c_custkey), c_custkey LIMIT 50")
oracle("review_queue", "news", "WITH b AS (SELECT event_id, event_type, sentiment, confidence, CASE WHEN confidence <= 0.5 THEN 'low' WHEN confidence <= 0.8 THEN 'medium' WHEN confidence IS NOT NULL THEN 'high' END AS confidence_band, md5('42/' || event_id) AS h FROM news), t AS (SELECT *, row_number() OVER (PARTITION BY event_type, sentiment, confidence_band ORDER BY h, event_id) AS turn FROM b) SELECT event_id, event_type, sentiment, confidence, confidence_band, turn FROM t ORDER BY turn, event_type, sentiment, confidence_band, h LIMIT 60", "confidence")
oracle("negative_controls", TABLES, f"WITH {PANEL}, a AS (SELECT trade_date, ts_code, bp, ep, fwd, row_number() OVER (PARTITION BY trade_date ORDER BY ts_code) AS i, row_number() OVER (PARTITION BY trade_date ORDER BY md5('42/' || ts_code), ts_code) AS j FROM panel) SELECT trade_date, ts_code, fwd, lag(bp) OVER w AS bp, lag(ep) OVER w AS ep, 'shift' AS kind FROM a WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date) UNION ALL SELECT a.trade_date, a.ts_code, a.fwd, b.bp, b.ep, 'permute' FROM a JOIN a b ON a.trade_date = b.trade_date AND a.i = b.j", "fwd bp ep")

# ------------------------------------------------------------------ texts

# The documents hold no characters that compatibility normalisation changes, but a sharp s, which folding writes as two.
_NORMAL = "t AS (SELECT *, replace(lower(trim(regexp_replace(nfc_normalize(coalesce(content, '')), '\\s+', ' ', 'g'))), 'ß', 'ss') AS x FROM texts), n AS (SELECT *, sha256(x) AS h FROM t)"
oracle("prepared_texts", "texts", f"WITH {_NORMAL} SELECT event_id, stock_code, h AS content_sha256, count(*) OVER (PARTITION BY stock_code, h) > 1 AS is_exact_duplicate, 'unchecked' AS entity_status FROM n")
oracle("text_quality", "texts", f"WITH {_NORMAL}, d AS (SELECT *, count(*) OVER (PARTITION BY stock_code, h) > 1 AS twin FROM n) SELECT 'events' AS metric, '' AS key, count(*) AS n FROM d UNION ALL SELECT 'duplicates', '', count(*) FILTER (twin) FROM d UNION ALL SELECT 'texts', '', count(DISTINCT h) FROM d UNION ALL SELECT 'entities', '', count(DISTINCT stock_code) FROM d UNION ALL SELECT 'entity_status', 'unchecked', count(*) FROM d UNION ALL SELECT 'month', strftime(available_time, '%Y-%m'), count(*) FROM d GROUP BY 2")


def _label_sql() -> str:
    hit = lambda words: "(" + " OR ".join(f"contains(lower(x), '{w}')" for w in words) + ")"
    kind = f"CASE WHEN {hit(V.GROWTH)} THEN 'earnings_growth' WHEN {hit(V.NEGATIVE)} THEN CASE WHEN {hit(V.LITIGATION)} THEN 'litigation' ELSE 'earnings_decline' END ELSE 'other' END"
    rows = ", ".join("('{}', '{}', '{}', {}::DOUBLE, '{}')".format(k, *v) for k, v in V.LABELS.items())
    schema = V.fingerprint({"label": V.LABEL, "event_type": V.EVENT_TYPES, "sentiment": V.SENTIMENTS, "impact_horizon": V.HORIZONS})
    key = f"""sha256('{{"configuration":"{V.lexicon_fingerprint()}","event":"' || event_id || '","model":"rule-based-event-labeler-v1","prompt":"{V.PROMPT_VERSION}","schema":"{schema}","text":"' || h || '"}}')"""
    out = """'{"event_type":"' || event_type || '","sentiment":"' || sentiment || '","impact_horizon":"' || impact_horizon || '","confidence":' || confidence || ',"reason":"' || reason || '"}'"""
    return f"WITH {_NORMAL}, l(event_type, sentiment, impact_horizon, confidence, reason) AS (VALUES {rows}), k AS (SELECT event_id, {key} AS cache_key, {kind} AS event_type FROM n) SELECT event_id, cache_key, event_type, sentiment, impact_horizon, confidence, reason, false AS cached, {out} AS output_json FROM k JOIN l USING (event_type)"


oracle("labelled_texts", "texts", _label_sql(), "confidence")
oracle("label_representation", "texts", f"{_label_sql().replace('WITH ', 'WITH labels_ AS (SELECT * FROM (WITH ', 1)})) SELECT event_id, stock_code, sentiment, CASE sentiment WHEN 'positive' THEN confidence WHEN 'negative' THEN -confidence ELSE 0.0 END AS score FROM labels_ JOIN texts USING (event_id)", "score")
# Vectors are of length one.
oracle("embedded_texts", "texts", f"""WITH {_NORMAL} SELECT DISTINCT sha256('{{"dimension":16,"text":"' || h || '"}}') AS cache_key, CAST(1.0 AS DOUBLE) AS norm FROM n""", "norm")

# Distinct texts of one source meet by the rarest of their trigrams, of which alike sets must share one; copies are counted by time.
oracle(
    "near_duplicate_texts", "texts",
    r"""WITH e AS (SELECT event_id, stock_code, available_time AS t, content, min(event_id) OVER (PARTITION BY stock_code, content) AS c FROM texts WHERE content IS NOT NULL),
    k AS (SELECT stock_code, c, string_split(regexp_replace(content, '[\t\n\x0B\f\r ]', '', 'g'), '') AS a FROM e WHERE event_id = c),
    g AS (SELECT stock_code, c, unnest(list_distinct(CASE WHEN len(a) >= 3 THEN list_transform(range(1, len(a) - 1), lambda i: a[i] || a[i + 1] || a[i + 2]) ELSE [array_to_string(a, '')] END)) AS g FROM k WHERE len(array_to_string(a, '')) > 0),
    n AS (SELECT *, count(*) OVER (PARTITION BY c) AS n, count(*) OVER (PARTITION BY g) AS df FROM g),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY df, g) AS r FROM n) WHERE r <= n - ceil(n * 0.85::DOUBLE) + 1),
    m AS (SELECT DISTINCT x.c AS a, y.c AS b, x.n AS na, y.n AS nb FROM p x JOIN p y ON x.stock_code = y.stock_code AND x.g = y.g AND x.c < y.c WHERE least(x.n, y.n) >= 0.85 * greatest(x.n, y.n)),
    j AS (SELECT a, b FROM m JOIN g x ON x.c = m.a JOIN g y ON y.c = m.b AND x.g = y.g GROUP BY a, b, na, nb HAVING count(*)::DOUBLE / (na + nb - count(*)) >= 0.85),
    o AS (SELECT a, b FROM j UNION ALL SELECT b, a FROM j UNION ALL SELECT c, c FROM e WHERE event_id = c),
    l AS (SELECT x.event_id, count(*) - 1 AS links FROM e x JOIN o ON o.a = x.c JOIN e y ON y.c = o.b AND y.t BETWEEN x.t - INTERVAL 7 DAY AND x.t + INTERVAL 7 DAY GROUP BY 1)
    SELECT x.stock_code, x.event_id, e.c AS class_id, coalesce(links, 0) AS links FROM texts x LEFT JOIN e USING (event_id) LEFT JOIN l USING (event_id)""",
)

_COLUMNS = {"region": {"r_name": 0, "r_regionkey": 0}, "nation": {"n_name": 0, "n_nationkey": 0, "n_regionkey": 0}, "supplier": {"s_acctbal": 1, "s_name": 0, "s_nationkey": 0, "s_suppkey": 0}}


def _fingerprint_sql(table: str, columns: dict[str, int]) -> str:
    """The order-free fingerprint of a table; columns by name, 1 for a double."""
    text = {c: f"printf('%.9e', {c} + 0.0)" if double else f"CAST({c} AS VARCHAR)" for c, double in columns.items()}
    row = " || '|' || ".join(f"CASE WHEN {c} IS NULL THEN 'N' ELSE 'V' || length({t}) || ':' || {t} END" for c, t in text.items())
    limbs = " || ".join(f"', \"' || CAST(sum(CAST('0x' || substr(h, {1 + 12 * i}, 12) AS HUGEINT)) AS VARCHAR) || '\"'" for i in range(5))
    names = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT '{table}' AS name, sha256('[[{names}], \"' || count(*) || '\"' || {limbs} || ']') AS sha256 FROM (SELECT sha256({row}) AS h FROM {table})"


oracle("table_fingerprints", "", " UNION ALL ".join(_fingerprint_sql(t, c) for t, c in _COLUMNS.items()))

# ------------------------------------------------------------------ small operators that had no query of their own


@query("log_and_reciprocal", sql="SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END AS log_size, 1.0 / nullif(c_acctbal - 100 * floor(c_acctbal / 100), 0) AS reciprocal FROM customer", doubles="log_size reciprocal")
def log_and_reciprocal(s: Star) -> DataFrame:
    c = s.raw("customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("x"))
    return c.select("c_custkey", scalar.log_size("x").alias("log_size"), scalar.reciprocal(F.col("x") - 100 * F.floor(F.col("x") / 100)).alias("reciprocal"))


@query("dates_read_or_dropped", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders")
def dates_read_or_dropped(s: Star) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("no date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return scalar.normalize_dates(s.raw("orders").select("o_orderkey", text.alias("d")), ["d"], errors="coerce")


@query("trading_dates", "bar", "SELECT 'bars' AS source, trade_date FROM (SELECT DISTINCT trade_date FROM bar) UNION ALL SELECT 'calendar', trade_date FROM (SELECT DISTINCT trade_date FROM bar WHERE month(trade_date) % 2 = 0)")
def trading_dates(s: Star) -> DataFrame:
    c = s.calendar().withColumn("is_open", F.month("trade_date") % 2 == 0)
    return joins.trade_dates(None, s.bar()).select(F.lit("bars").alias("source"), "trade_date").unionByName(joins.trade_dates(c, s.bar()).select(F.lit("calendar").alias("source"), "trade_date"))


@query("event_ids", "news", "SELECT event_id, 'event-' || lpad(CAST(row_number() OVER (ORDER BY publish_time, stock_code, event_id) - 1 AS VARCHAR), 6, '0') AS ranked_id FROM news")
def event_ids(s: Star) -> DataFrame:
    order = [F.col("publish_time"), F.col("stock_code"), F.col("event_id")]
    return s.news().select("event_id", scalar.event_id(order).alias("ranked_id"))


@query("directed_factors", TABLES, f"WITH {PANEL} SELECT trade_date, ts_code, bp, -size AS size, -turnover_rate AS vol_20 FROM panel", "bp size vol_20")
def directed_factors(s: Star) -> DataFrame:
    from .research_queries import panel

    return factors.apply_directions(panel(s).select("trade_date", "ts_code", "bp", "size", F.col("turnover_rate").alias("vol_20")))


@query("selected_factors", TABLES, f"WITH {PANEL}, {LONG}, {_RANKS}, g AS (SELECT factor, avg(ic) AS m, avg(ic) / stddev_samp(ic) AS ir FROM ic WHERE ic IS NOT NULL GROUP BY factor) SELECT factor, NOT (abs(m) < 0.01 OR abs(ir) < 0.05) AS selected, CASE WHEN abs(m) < 0.01 THEN 'low_ic' WHEN abs(ir) < 0.05 THEN 'low_icir' ELSE 'selected' END AS reason FROM g")
def selected_factors(s: Star) -> DataFrame:
    """The greedy choice over some factors; none of these are correlated beyond the limit."""
    from .research_queries import ics

    summary = [r.asDict() for r in E.ic_summary(ics(s), ["factor"]).select("factor", "ic_mean", "icir").collect()]  # a row a factor
    rows = E.select_factors(summary, {})
    return s.spark.createDataFrame([(r["factor"], r["selected"], r["reason"]) for r in rows], "factor string, selected boolean, reason string")


@query("converted_divisors", sql="SELECT p_partkey, 1.0 / (p_size % 7 + 0.5::DOUBLE) AS adj_factor FROM part", doubles="adj_factor")
def converted_divisors(s: Star) -> DataFrame:
    return catalog.convert_divisor(s.raw("part").select("p_partkey", (F.col("p_size") % 7 + 0.5).cast("double").alias("adj_factor")))


@query("variance_losses", "returns", "WITH v AS (SELECT ts_code, trade_date, ret, var_samp(ret) OVER w AS v, count(ret) OVER w AS n FROM returns WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) SELECT ts_code, count(*) AS n, avg(CASE WHEN ret <> 0 THEN ret * ret / v - ln(ret * ret / v) - 1 END) AS loss FROM v WHERE n >= 6 AND v > 0 GROUP BY ts_code", "loss")
def variance_losses(s: Star) -> DataFrame:
    w = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(-12, -1)
    r = s.returns().where("ret is not null").select("ts_code", "ret", F.var_samp("ret").over(w).alias("v"), F.count("ret").over(w).alias("k")).where("k >= 6 and v > 0")
    return r.groupBy("ts_code").agg(F.count("*").alias("n"), F.avg(M.qlike(F.col("ret"), F.sqrt("v"))).alias("loss"))
