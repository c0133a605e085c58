"""The monthly chain: a gated sample, baselines before a holdout, models by rebalance date.

Each step reads a folder, writes its tables as Parquet and a summary as JSON to
another, and returns the summary; its `exit_code` is 0, or 2 where a gate is not
reached. A gate in sample mode is reported and lets the step go on, as sample
data never promote; in real mode nothing is written behind a failed gate.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audits as A
from ..operators import coverage as C
from ..operators import dynamic as D
from ..operators import evaluation as E
from ..operators import factors, joins
from ..operators import model_stages as S
from ..operators import processing as X
from ..operators import unit_roots as U
from ..sources.catalog import load_all, write_any

REQUIRED = ("trade_calendar", "daily_bar", "daily_basic", "industry", "index_member", "stock_basic", "financial_indicator", "benchmark_index")
#: Fields that members must have, by table of dates and by table of reports.
FIELDS = {"daily_bar": ["amount", "adj_factor"]}
REPORT_FIELDS: dict[str, list[str]] = {}


# ---------------------------------------------------------------- gates


def manifest_reasons(manifest: dict | None) -> list[str]:
    """Why a data manifest doesn't let real research go on."""
    if manifest is None:
        return ["no data manifest"]
    out = []
    if manifest.get("mode") != "real":
        out.append("the manifest's mode is not real")
    if manifest.get("verification_error"):
        out.append(f"the manifest doesn't verify: {manifest['verification_error']}")
    if manifest.get("import_status") != "ready":
        out.append("the import is not ready")
    return out


def registry_reasons(manifest: dict | None) -> list[str]:
    """Why the sources aren't approved: errors, a missing hash, no signature."""
    registry = (manifest or {}).get("registry") or {}
    out = [str(x) for x in registry.get("errors", [] if registry.get("valid") else ["the source registry is not valid"])]
    if not registry.get("sha256"):
        out.append("the source registry has no hash")
    if registry.get("valid"):
        if registry.get("review_status") != "approved":
            out.append("the source registry is not approved")
        out += [f"the source registry lacks {k}" for k in ("reviewed_by", "reviewed_at") if not str(registry.get(k) or "").strip()]
    return out


def audit_tables(t: dict[str, DataFrame], least: float = 0.95) -> dict[str, DataFrame]:
    """Five audits, each with a column passed."""
    days = t["trade_calendar"].where("is_open").select("trade_date")
    late = A.financial_timing(t["financial_indicator"]).withColumn("passed", F.lit(False)).select("ts_code", "report_period", "problems", "passed")
    fine = t["financial_indicator"].select("ts_code", "report_period", F.lit("").alias("problems"), F.lit(True).alias("passed"))
    alive = A.survivorship(t["stock_basic"], t["index_member"], t["daily_bar"])
    return {
        "pit_timing": fine.join(late.select("ts_code", "report_period"), ["ts_code", "report_period"], "left_anti").unionByName(late),
        "financial_revisions": A.revision_chains(t["financial_indicator"]).withColumn("passed", F.col("ordered")),
        "survivorship": alive.withColumn("passed", ~F.col("member") | (F.col("listed") & F.col("has_bars"))),
        "universe_coverage": A.universe_coverage(days, t["index_member"], {"daily_bar": t["daily_bar"], "daily_basic": t["daily_basic"]}, t.get("suspension"), least),
        "benchmark_alignment": A.benchmark_alignment(days, t["benchmark_index"]).withColumn("passed", F.col("has_benchmark")),
    }


def audit_reasons(audits: dict[str, DataFrame]) -> list[str]:
    """An audit without rows says nothing, so it blocks like one with failed rows."""
    out = []
    for name, df in audits.items():
        rows, failed = df.agg(F.count("*"), F.count_if(~F.coalesce("passed", F.lit(False)))).first()
        if not rows:
            out.append(f"{name}: no rows to audit")
        elif failed:
            out.append(f"{name}: {failed} of {rows} rows failed")
    return out


def coverage_reasons(coverage: DataFrame, least: float = 0.95) -> list[str]:
    """Fields below `least` on any date."""
    low = coverage.where(F.col("coverage") < least).groupBy("table", "field").agg(F.count("*").alias("n"), F.min("coverage").alias("worst"), F.min("trade_date").alias("first"))
    rows = low.orderBy("table", "field").collect()  # a row a field
    return [f"{r['table']}.{r['field']}: below {least} on {r['n']} dates, {r['worst']:.4f} at worst, first on {r['first']}" for r in rows]


def label_reasons(labels: DataFrame, holdout: dt.date) -> list[str]:
    """Labels that overlap, are out of order, or reach into the holdout."""
    w = Window.orderBy("signal_date")
    seen = labels.withColumn("before", F.lag("label_end_date").over(w))
    n, order, overlap, late = seen.agg(
        F.count("*"), F.count_if(~((F.col("signal_date") < F.col("execution_date")) & (F.col("execution_date") <= F.col("label_end_date")) & (F.col("label_end_date") < F.col("availability_date")))),
        F.count_if(F.col("execution_date") <= F.col("before")), F.count_if(F.col("availability_date") >= F.lit(holdout)),
    ).first()
    why = {"no monthly labels": not n, f"{order} labels out of order": order, f"{overlap} labels overlap": overlap, f"{late} labels reach into the holdout": late}
    return [k for k, bad in why.items() if bad]


def start_reasons(t: dict[str, DataFrame], start: dt.date, slack_days: int = 7) -> list[str]:
    """Calendar and bars must begin within a week of the required start."""
    out = []
    for name in ("trade_calendar", "daily_bar"):
        first = t[name].agg(F.min("trade_date")).first()[0]
        if first is None or first > start + dt.timedelta(slack_days):
            out.append(f"{name} begins {first}, not by {start}")
    return out


# ---------------------------------------------------------------- operators


def monthly_factor_ic(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """signal_date, execution_date, label_end_date, availability_date, factor, rank_ic, neutral_rank_ic, valid, universe, coverage.

    rows: trade_date, ts_code, factor, value, neutral; labels: ts_code, signal_date,
    label_return and the three dates, which must be one each a signal date. Every
    asset of a signal date counts in its universe, whether or not it has a label.
    """
    met = rows.withColumnRenamed("trade_date", "signal_date").join(labels.select("ts_code", "signal_date", "label_return"), ["ts_code", "signal_date"], "left")
    timing = labels.groupBy("signal_date").agg(*(F.min(c).alias(c) for c in ("execution_date", "label_end_date", "availability_date")), *(F.max(c).alias(f"__{c}") for c in ("execution_date", "label_end_date", "availability_date")))
    same = F.lit(True)
    for c in ("execution_date", "label_end_date", "availability_date"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    timing = timing.withColumn("label_end_date", F.when(same, F.col("label_end_date")).otherwise(F.raise_error(F.concat(F.lit("more than one timing at "), F.col("signal_date").cast("string"))).cast("date")))
    keys = ["signal_date", "factor"]
    raw, neutral = (E.daily_ic(met, "label_return", keys, value) for value in ("value", "neutral"))
    size = met.groupBy(*keys).agg(F.count("*").alias("universe"), F.count_if(F.col("value").isNotNull() & F.col("label_return").isNotNull()).alias("valid"))
    out = size.join(raw.select(*keys, F.col("ic").alias("rank_ic")), keys, "left").join(neutral.select(*keys, F.col("ic").alias("neutral_rank_ic")), keys, "left").join(joins.lookup(timing), "signal_date")
    return out.select("signal_date", "execution_date", "label_end_date", "availability_date", "factor", "rank_ic", "neutral_rank_ic", "valid", "universe", (F.col("valid") / F.col("universe")).alias("coverage"))


# ---------------------------------------------------------------- steps


def _json(spark: SparkSession, at: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(at)


def _written(spark: SparkSession, out: str, name: str, df: DataFrame) -> DataFrame:
    write_any(df, f"{out}/{name}", mode="overwrite")
    return spark.read.schema(df.schema).parquet(f"{out}/{name}")


def build_sample(spark: SparkSession, folder: str, out: str, mode: str = "sample", manifest: dict | None = None, start: dt.date = dt.date(2015, 1, 1), holdout: dt.date = dt.date(2024, 1, 1), least: float = 0.95, exemptions: DataFrame | None = None, signature: C.Signature | None = None) -> dict:
    """Gates, then labels, factors' monthly ICs and spreads and the market's series, from standard tables."""
    if mode not in ("sample", "real"):
        raise ValueError(f"mode must be sample or real, not {mode}")
    t, out = load_all(spark, folder, views=False), out.rstrip("/")
    missing = [n for n in REQUIRED if n not in t or not t[n].limit(1).count()]
    gates: dict[str, list[str]] = {"tables": [f"no {n}" for n in missing]}
    if mode == "real":
        gates |= {"manifest": manifest_reasons(manifest), "registry": registry_reasons(manifest)}
    labels = None
    if not missing:
        days = t["trade_calendar"].where("is_open").select("trade_date")
        labels = _written(spark, out, "monthly_labels", joins.monthly_labels(days, str(holdout)))
        audits = audit_tables(t, least)
        covered = C.member_coverage(t["index_member"], days, {n: (t.get(n), f) for n, f in FIELDS.items()}, {n: (t.get(n), f) for n, f in REPORT_FIELDS.items()}, t.get("suspension"), exemptions, signature)
        covered = _written(spark, out, "member_coverage", covered)
        gates |= {"audits": audit_reasons(audits), "coverage": coverage_reasons(covered, least), "labels": label_reasons(labels, holdout)}
        if mode == "real":
            gates["start"] = start_reasons(t, start)
    reasons = [f"{g}: {r}" for g, rs in gates.items() for r in rs]
    status = "passed" if not reasons else "blocked_by_missing_tables" if missing else "blocked_by_quality"
    summary = {"step": "build-monthly-sample", "mode": mode, "status": status, "gates": {g: not rs for g, rs in gates.items()}, "reasons": reasons, "holdout": str(holdout), "exit_code": 0}
    if missing or (mode == "real" and reasons):
        summary["exit_code"] = 2
        _json(spark, f"{out}/summary.json", summary)
        return summary
    panel = factors.build_panel(t)
    names = [n for n in factors.REGISTRY if n in panel.columns]
    months = labels.select(F.col("signal_date").alias("trade_date"))
    chosen = panel.join(joins.lookup(months), "trade_date", "left_semi")
    done = _written(spark, out, "monthly_factors", X.process(chosen, names, {n: factors.REGISTRY[n].neutralize for n in names}).withColumnRenamed("raw", "value"))
    returns = _written(spark, out, "monthly_label_returns", joins.label_returns(labels, t["daily_bar"]))
    _written(spark, out, "monthly_factor_ic", monthly_factor_ic(done.select("trade_date", "ts_code", "factor", "value", "neutral"), returns))
    labelled = done.select("trade_date", "ts_code", "factor", F.col("standardized").alias("value")).join(returns.select(F.col("signal_date").alias("trade_date"), "ts_code", "availability_date", "label_return"), ["trade_date", "ts_code"])
    spread = E.group_returns(labelled, "label_return").select(F.col("trade_date").alias("signal_date"), "factor", F.col("spread").alias("ret"))
    _written(spark, out, "monthly_factor_returns", spread.join(joins.lookup(labels.select("signal_date", "availability_date")), "signal_date"))
    w = Window.orderBy("trade_date")
    bench = t["benchmark_index"].select("trade_date", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("ret"))
    ret = t["daily_bar"].select("trade_date", "ts_code", "amount", (F.try_divide(F.col("close") * F.col("adj_factor"), F.lag(F.col("close") * F.col("adj_factor")).over(Window.partitionBy("ts_code").orderBy("trade_date"))) - 1).alias("ret"))
    market = t["daily_bar"].select("trade_date", "ts_code", "amount").join(t["daily_basic"].select("trade_date", "ts_code", "turnover_rate"), ["trade_date", "ts_code"], "left")
    _written(spark, out, "standard_series", S.before_holdout(S.standard_series(ret, market, bench), holdout, "trade_date"))
    _written(spark, out, "benchmark_returns", S.before_holdout(bench.where("ret is not null"), holdout, "trade_date"))
    summary["tables"] = ["monthly_labels", "member_coverage", "monthly_factors", "monthly_label_returns", "monthly_factor_ic", "monthly_factor_returns", "standard_series", "benchmark_returns"]
    _json(spark, f"{out}/summary.json", summary)
    return summary


def _variables(series: DataFrame) -> DataFrame:
    daily = series.select(F.col("trade_date").alias("date"), F.col("trade_date").alias("available"), F.col("benchmark_log_return").alias("return"), F.col("realized_volatility_20").alias("volatility"), "breadth", F.col("log_median_amount").alias("liquidity"))
    return S.monthly_variables(daily)


def run_baselines(spark: SparkSession, sample: str, out: str, start: dt.date, end: dt.date, holdout: dt.date, least: int = 12, min_months: int = 36) -> dict:
    """Forecasts of monthly series in the window, their scores, and unit-root tests by forecast origin; a leak stops the step."""
    sample, out = sample.rstrip("/"), out.rstrip("/")
    variables = _variables(spark.read.parquet(f"{sample}/standard_series"))
    ic = S.before_holdout(spark.read.parquet(f"{sample}/monthly_factor_ic"), holdout, "availability_date")
    mean = ic.groupBy(F.trunc("availability_date", "MM").alias("m")).agg(F.max("availability_date").alias("date"), F.avg("rank_ic").alias("value")).select(F.lit("mean_rank_ic").alias("series"), "date", F.col("date").alias("available"), "value")
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("series"), F.col(c).alias("value")) for n, c in (("benchmark_log_return", "return"), ("realized_volatility_20", "volatility")))))
    series = _written(spark, out, "monthly_series", variables.select("date", "available", pairs.alias("p")).select("p.series", "date", "available", "p.value").unionByName(mean))
    forecasts = S.guarded(S.baseline_stage(series, start, end, holdout, least), S.forecast_is_late(), "forecasts", f"{out}/forecast_comparison")
    scores = _written(spark, out, "model_selection", E.forecast_scores(forecasts, ["series", "model"]))
    origins = forecasts.select("origin").distinct()
    _written(spark, out, "diagnostics", U.diagnostics(series.select("series", "date", "value"), origins=origins))
    months = forecasts.agg(F.count_distinct(F.trunc("target", "MM"))).first()[0]
    summary = {"step": "run-time-series-baselines", "window": [str(start), str(end)], "holdout": str(holdout), "oos_months": months, "eligible": months >= min_months, "models": scores.count(), "exit_code": 0 if months else 2}
    _json(spark, f"{out}/summary.json", summary)
    return summary


def run_models(spark: SparkSession, sample: str, out: str, holdout: dt.date, mode: str = "sample", gate_passed: bool = False, min_months: int = 36, least_regime: int = 36, least_volatility: int = 60) -> dict:
    """Kalman forecasts, regimes and volatility at every signal date before the holdout; what they may be used for."""
    sample, out = sample.rstrip("/"), out.rstrip("/")
    read = lambda name: spark.read.parquet(f"{sample}/{name}")
    ic = S.before_holdout(read("monthly_factor_ic"), holdout, "signal_date", "availability_date")
    dates = S.before_holdout(ic.select(F.col("signal_date").alias("trade_date")).distinct(), holdout, "trade_date")
    kalman = _written(spark, out, "factor_ic_forecasts", D.kalman_forecasts(ic.select("factor", F.col("rank_ic").alias("ic"), "availability_date"), dates))
    _written(spark, out, "trial_weights", D.trial_weights(kalman, cap=0.4))
    fits = _written(spark, out, "regime_fits", S.regime_fits(S.before_holdout(_variables(read("standard_series")), holdout, "available"), dates, least=least_regime))
    returns = S.before_holdout(read("monthly_factor_returns"), holdout, "availability_date").select(F.col("signal_date").alias("date"), F.col("availability_date").alias("available"), "factor", "ret")
    for name, df in (("regime_probabilities", S.regime_probabilities(fits)), ("regime_transitions", S.regime_transitions(fits)), ("regime_durations", S.regime_durations(fits)), ("regime_stability", S.regime_stability(fits)), ("regime_performance", S.regime_performance(fits, returns))):
        _written(spark, out, name, df)
    bench = S.before_holdout(read("benchmark_returns"), holdout, "trade_date").select(F.lit("benchmark").alias("series"), F.col("trade_date").alias("date"), "ret")
    volatility = _written(spark, out, "volatility_forecasts", S.volatility_stage(bench, dates, least=least_volatility))
    _written(spark, out, "volatility_comparison", S.volatility_comparison(volatility))
    any_ok = lambda df: bool(df.where("status = 'ok'").limit(1).count())
    months = kalman.where("forecast is not null").agg(F.count_distinct("test_date")).first()[0]
    rows = S.module_status({"kalman": bool(months), "regimes": any_ok(fits), "volatility": any_ok(volatility)}, months, mode, gate_passed, min_months)
    _written(spark, out, "status", spark.createDataFrame([tuple(r.values()) for r in rows], "module string, status string, eligible boolean, oos_months int, mode string, synthetic boolean, detail string"))
    summary = {"step": "run-time-series-models", "mode": mode, "holdout": str(holdout), "oos_months": months, "status": rows[-1]["status"], "modules": {r["module"]: r["status"] for r in rows}, "exit_code": 2 if mode == "real" and rows[-1]["status"] != "dynamic_ready" else 0}
    _json(spark, f"{out}/summary.json", summary)
    return summary
