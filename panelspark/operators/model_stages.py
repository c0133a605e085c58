"""Regime and volatility stages at every rebalance date, with a holdout cut and guards against leaks.

A model is one group: its dates are worked through in order inside the group, so
history is shuffled once and not copied for each date. A fit starts from the
date before's parameters and from one seeded start, and the likelier one stays.
"""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import col, safe_divide
from ..functions.stats import chi2_tail_column
from .joins import lookup
from .models import EWMA_DECAY, SEEDS, GaussianHMM, expanding_forecasts, fit_volatility, gjr_grid_forecast, stress_labels
from .unit_roots import arch_lm

#: Columns of the stages' tables; empty inputs give these, without rows.
SCHEMAS = {
    "regime_fits": "states int, as_of date, training_end date, n bigint, status string, seed int, loglik double, labels array<string>, probability array<double>, move array<array<double>>, means array<array<double>>, previous_as_of date, l1_change double, matched array<int>, path array<struct<date:date,label:string>>",
    "regime_probabilities": "as_of date, model string, states int, training_end date, n bigint, status string, bear double, neutral double, bull double, loglik double, seed int",
    "regime_transitions": "as_of date, model string, from_state string, to_state string, probability double",
    "regime_durations": "as_of date, model string, state string, expected_duration double",
    "regime_stability": "as_of date, model string, previous_as_of date, l1_change double, swapped boolean",
    "regime_performance": "as_of date, model string, state string, factor string, mean_return double, n bigint",
    "volatility_forecasts": "series string, as_of date, training_end date, target date, model string, n bigint, status string, variance double, annual_volatility double, actual double, error double, absolute_error double, qlike double, arch_lm_p double, extreme boolean",
    "volatility_comparison": "series string, model string, n bigint, rmse double, mae double, mean_qlike double, arch_rejection_rate double, extreme_mae double, target_bias double",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


# ---------------------------------------------------------------- holdout and leaks


class Leak(ValueError):
    """Rows that were not yet known at the time they are used for."""


def before_holdout(df: DataFrame, start: dt.date, *columns: str) -> DataFrame:
    """Rows whose every date column lies before the holdout; a null date is not known to, so its row goes."""
    if not columns:
        return df
    inside = F.lit(True)
    for c in columns:
        inside = inside & F.coalesce(F.col(c) < F.lit(start), F.lit(False))
    return df.where(inside)


def guarded(df: DataFrame, late: Column, name: str, at: str) -> DataFrame:
    """df written to `at` while the rows that are late are counted in the same job; with any, what was written is removed and Leak raised.

    A null verdict counts as late. The count is an observation of the rows as
    they are written, so a leak costs no second pass and nothing of it stays.
    """
    seen, folder = Observation(name), f"{at}.unchecked"
    bad = F.coalesce(late, F.lit(True))
    df.observe(seen, F.count_if(bad).alias("late"), F.count("*").alias("rows")).write.mode("overwrite").parquet(folder)
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if n := seen.get["late"]:
        fs.delete(path(folder), True)
        raise Leak(f"{name}: {n} of {seen.get['rows']} rows use what was not known yet")
    fs.delete(path(at), True)
    if not fs.rename(path(folder), path(at)):
        raise PySparkException(f"{folder} could not be moved to {at}")
    return spark.read.schema(df.schema).parquet(at)


def forecast_window(forecasts: DataFrame, start: dt.date, end: dt.date, holdout: dt.date) -> DataFrame:
    """Forecasts (train_end, origin, target, available) whose target lies in the evaluation window and before the holdout; the window must end before it."""
    if end >= holdout:
        raise ValueError(f"the evaluation ends {end}, not before the holdout {holdout}")
    return before_holdout(forecasts.where(F.col("target").between(F.lit(start), F.lit(end))), holdout, "target", "available")


def forecast_is_late() -> Column:
    """Whether a forecast was trained on its target, or could not be known when it was made."""
    return ~((F.col("train_end") < F.col("target")) & (F.col("origin") < F.col("available")))


BASELINES = "series string, model string, train_end date, origin date, target date, available date, forecast double, actual double"


def baseline_stage(series: DataFrame, start: dt.date, end: dt.date, holdout: dt.date, least: int = 12) -> DataFrame:
    """Expanding one-step forecasts (lag 1, means, EWMA, AR(1)) whose target lies in the window; BASELINES.

    series: series, date, available, value. A forecast's origin and end of
    training are the date before its target, and it can be scored once the target
    is available. What is dated or known at the holdout or later is not read.
    Write it with guarded(..., forecast_is_late(), ...).
    """
    names = [c.split()[0] for c in BASELINES.split(", ")]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        at, known = g["date"].tolist(), g["available"].tolist()
        rows = expanding_forecasts(g["value"].to_numpy(float), least=least)
        return pd.DataFrame([(key[0], r["model"], at[r["position"] - 1], at[r["position"] - 1], at[r["position"]], known[r["position"]], r["forecast"], r["actual"]) for r in rows], columns=names)

    rows = before_holdout(series.where("value is not null"), holdout, "date", "available").select("series", F.col("date").cast("date").alias("date"), F.col("available").cast("date").alias("available"), F.col("value").cast("double").alias("value"))
    return forecast_window(rows.groupBy("series").applyInPandas(run, BASELINES), start, end, holdout)


def standard_series(returns: DataFrame, market: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Market series by date: breadth, dispersion, log_median_amount, median_turnover, benchmark_log_return, realized_volatility_20.

    returns: trade_date, ret; market: trade_date, amount, turnover_rate;
    benchmark: trade_date, ret. The volatility is that of the last 20 dates of
    returns, 10 at least with a value, over a year. The last step is a window over
    dates, one row each.
    """
    daily = returns.where("ret is not null").groupBy("trade_date").agg(F.avg((F.col("ret") > 0).cast("double")).alias("breadth"), F.stddev_samp("ret").alias("dispersion"))
    half = F.lit(0.5)
    m = market.groupBy("trade_date").agg(F.percentile("amount", half).alias("amount"), F.percentile("turnover_rate", half).alias("median_turnover"))
    b = benchmark.select("trade_date", F.log1p(F.greatest(F.col("ret"), F.lit(-0.999999))).alias("benchmark_log_return"))
    out = daily.join(m, "trade_date", "left").join(b, "trade_date", "left").withColumn("log_median_amount", F.log(F.when(F.col("amount") != 0, F.col("amount"))))
    last = Window.orderBy("trade_date").rowsBetween(-19, 0)
    x = F.col("benchmark_log_return")
    return out.drop("amount").withColumn("realized_volatility_20", F.when(F.count(x).over(last) >= 10, F.stddev_samp(x).over(last) * math.sqrt(252.0)))


# ---------------------------------------------------------------- regimes


def monthly_variables(daily: DataFrame) -> DataFrame:
    """date, available, return, volatility, breadth, liquidity by month: returns add up, the last volatility counts, the others are means."""
    kept = daily.dropna(subset=["return", "volatility", "breadth", "liquidity"])
    g = kept.groupBy(F.trunc("date", "MM").alias("month")).agg(
        F.max("date").alias("date"), F.max("available").alias("available"), F.sum("return").alias("return"), F.max_by("volatility", F.struct("available", "date")).alias("volatility"),
        F.avg("breadth").alias("breadth"), F.avg("liquidity").alias("liquidity"),
    )
    return g.drop("month")


def matched_states(before: np.ndarray, now: np.ndarray) -> list[int]:
    """For each state of before, the state of now that stands for it: least sum of squared distances of means over all one-to-one matchings."""
    k = len(before)
    cost = ((before[:, None, :] - now[None]) ** 2).sum(axis=2)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by the set of states of now that are taken
    for i in range(k):
        step: dict[int, tuple[float, list[int]]] = {}
        for taken, (sum_, order) in best.items():
            for j in range(k):
                if not taken >> j & 1:
                    option = (sum_ + float(cost[i, j]), [*order, j])
                    step[taken | 1 << j] = min(step.get(taken | 1 << j, (math.inf, [])), option)
        best = step
    return best[(1 << k) - 1][1]


def regime_fits(variables: DataFrame, dates: DataFrame, states: tuple[int, ...] = (2, 3), least: int = 36, columns: tuple[str, ...] = ("return", "volatility", "breadth", "liquidity")) -> DataFrame:
    """SCHEMAS['regime_fits']: a row for each model and date, from variables available strictly before the date.

    variables: date, available and columns. States are matched with those of the
    date before by their means, in units of each column's spread, and l1_change is
    the change of probabilities so matched.
    """
    days = sorted({r[0] for r in dates.select(F.col("trade_date").cast("date")).distinct().collect()})  # rebalance dates: some hundred
    names = [c.split()[0] for c in SCHEMAS["regime_fits"].split(", ")]
    cols = list(columns)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        g = g.sort_values(["available", "date"])
        x, known, at = g[cols].to_numpy(float), g["available"].to_numpy(), g["date"].tolist()
        rows, last, prior = [], None, None
        for day in days:
            n = int(np.searchsorted(known, day))
            head = (k, day, known[n - 1] if n else None, n)
            if n < max(least, 3 * k) or (x[:n].std(axis=0) == 0).any():
                rows.append((*head, "insufficient_history", *[None] * 10))
                continue
            mean, spread = x[:n].mean(axis=0), x[:n].std(axis=0)
            z = (x[:n] - mean) / spread
            seed = SEEDS[len(rows) % len(SEEDS)]
            starts = [(GaussianHMM(k, s).fit(z), s) for s in (SEEDS if last is None else (seed,))]
            if last is not None:
                starts.append((GaussianHMM(k, last[1]).fit(z, start=last[0]), last[1]))
            last = max(starts, key=lambda m: m[0].loglik)
            m, seed = last
            p = m.filtered(z)
            label, means = stress_labels(m.mean, cols), m.mean * spread + mean
            change = matched = None
            if prior is not None:
                matched = matched_states(prior[2] / spread, means / spread)
                change = float(np.abs(p[-1][matched] - prior[1]).sum())
            path = [{"date": d, "label": label[s]} for d, s in zip(at[:n], p.argmax(axis=1), strict=True)]
            rows.append((*head, "ok", seed, m.loglik, label, p[-1].tolist(), m.move.tolist(), means.tolist(), prior[0] if prior else None, change, matched, path))
            prior = (day, p[-1], means)
        return pd.DataFrame(rows, columns=names)

    rows = variables.dropna(subset=["available", *cols]).select(F.explode(F.array(*(F.lit(k) for k in states))).alias("states"), F.col("date").cast("date").alias("date"), F.col("available").cast("date").alias("available"), *cols)
    return rows.groupBy("states").applyInPandas(run, SCHEMAS["regime_fits"])


def _model() -> Column:
    return F.concat(F.lit("hmm_"), F.col("states"), F.lit("_state")).alias("model")


def regime_probabilities(fits: DataFrame) -> DataFrame:
    pairs = F.arrays_zip("labels", "probability")
    of = lambda name: F.when(F.col("status") == "ok", F.aggregate(F.filter(pairs, lambda x: x["labels"] == name), F.lit(0.0), lambda a, x: a + x["probability"])).alias(name)
    return fits.select("as_of", _model(), "states", "training_end", "n", "status", of("bear"), of("neutral"), of("bull"), "loglik", "seed")


def regime_transitions(fits: DataFrame) -> DataFrame:
    """Probabilities of going from one state to another; states that share a label have a row each."""
    to = F.transform(F.arrays_zip("labels", "move"), lambda a: F.transform(F.arrays_zip(F.col("labels").alias("to"), a["move"].alias("p")), lambda b: F.struct(a["labels"].alias("from_state"), b["to"].alias("to_state"), b["p"].alias("probability"))))
    return fits.where("status = 'ok'").select("as_of", _model(), F.explode(F.flatten(to)).alias("t")).select("as_of", "model", "t.*")


def regime_durations(fits: DataFrame) -> DataFrame:
    """1 / (1 - probability to stay), at most 1e8."""
    rows = fits.where("status = 'ok'").select("as_of", _model(), F.posexplode("labels").alias("i", "state"), "move")
    return rows.select("as_of", "model", "state", (1.0 / F.greatest(1.0 - F.get(F.get("move", "i"), "i"), F.lit(1e-8))).alias("expected_duration"))


def regime_stability(fits: DataFrame) -> DataFrame:
    """L1 change of matched probabilities against the fit before; swapped: the states stand in another order."""
    return fits.where("l1_change is not null").select("as_of", _model(), "previous_as_of", "l1_change", (F.col("matched") != F.sequence(F.lit(0), F.col("states") - 1)).alias("swapped"))


def regime_performance(fits: DataFrame, returns: DataFrame) -> DataFrame:
    """Mean return of each factor by the state that each fit gives its signal date; returns (date, available, factor, ret) known strictly before the fit's date."""
    path = fits.where("status = 'ok'").select("as_of", _model(), F.explode("path").alias("p")).select("as_of", "model", "p.date", F.col("p.label").alias("state"))
    met = returns.where("ret is not null").join(lookup(path), "date").where(F.col("available") < F.col("as_of"))
    return met.groupBy("as_of", "model", "state", "factor").agg(F.avg("ret").alias("mean_return"), F.count("*").alias("n"))


# ---------------------------------------------------------------- volatility


def volatility_stage(returns: DataFrame, dates: DataFrame, least: int = 60, models: tuple[str, ...] = ("historical_20", "historical_60", "ewma", "gjr_grid", "garch", "gjr", "egarch"), per_year: int = 252, lags: int = 5) -> DataFrame:
    """SCHEMAS['volatility_forecasts']: next variance by series, date and model from returns (series, date, ret) strictly before the date.

    arch_lm_p tests the squares of the standardised residuals for what the model
    left in them; a constant variance leaves those of the returns. The target is
    the first return at or after the date; it is extreme if as large as the 0.95
    quantile of what was known.
    """
    days = sorted({r[0] for r in dates.select(F.col("trade_date").cast("date")).distinct().collect()})  # rebalance dates: some hundred
    names = [c.split()[0] for c in SCHEMAS["volatility_forecasts"].split(", ")]

    def one(model: str, r: np.ndarray) -> tuple[str, float | None, np.ndarray | float | None]:
        """Status, next variance, conditional variances."""
        if model.startswith("historical_"):
            v = float(r[-int(model[11:]) :].var(ddof=1))
            return "ok", v, v
        if model == "ewma":
            square = (r - r.mean()) ** 2
            level = np.empty(len(r))
            level[0] = square[0]
            for t in range(1, len(r)):
                level[t] = EWMA_DECAY * level[t - 1] + (1 - EWMA_DECAY) * square[t]
            return "ok", float(EWMA_DECAY * level[-1] + (1 - EWMA_DECAY) * square[-1]), level
        if model == "gjr_grid":
            f = gjr_grid_forecast(r)
            return ("insufficient_history", None, None) if f is None else ("ok", f * f, None)
        m = fit_volatility(r, model)
        return m["status"], None if m["forecast_vol"] is None else m["forecast_vol"] ** 2, m.get("conditional")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        r, at, rows = g["ret"].to_numpy(float), g["date"].to_numpy(), []
        for day in days:
            n = int(np.searchsorted(at, day))
            past, actual = r[:n], float(r[n] ** 2) if n < len(r) else None
            extreme = bool(n and n < len(r) and abs(r[n]) >= np.quantile(abs(past), 0.95))
            for model in models:
                head = (key[0], day, at[n - 1] if n else None, at[n] if n < len(r) else None, model, n)
                if n < (20 if model == "historical_20" else least):
                    rows.append((*head, "insufficient_history", None, None, actual, None, None, None, None, extreme))
                    continue
                status, v, conditional = one(model, past)
                v = None if v is None or not math.isfinite(v) else max(v, 1e-12)
                p = None
                if conditional is not None and n > lags + 5:
                    p = arch_lm(past / np.sqrt(np.maximum(conditional, 1e-12)), lags)[1]
                error = None if v is None or actual is None else actual - v
                rows.append((*head, status, v, None if v is None else math.sqrt(per_year * v), actual, error, None if error is None else abs(error), None if error is None else math.log(v) + actual / v, p, extreme))
        return pd.DataFrame(rows, columns=names)

    rows = returns.where("ret is not null").select("series", F.col("date").cast("date").alias("date"), F.col("ret").cast("double").alias("ret"))
    return rows.groupBy("series").applyInPandas(run, SCHEMAS["volatility_forecasts"])


def volatility_comparison(forecasts: DataFrame, per_year: int = 252, level: float = 0.05) -> DataFrame:
    """SCHEMAS['volatility_comparison']: errors, losses and rejections of the ARCH test by series and model."""
    ok = forecasts.where("status = 'ok' and error is not null")
    rejected = F.avg(F.when(F.col("arch_lm_p").isNotNull(), (F.col("arch_lm_p") < level).cast("double")))
    return ok.groupBy("series", "model").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("error") ** 2)).alias("rmse"), F.avg("absolute_error").alias("mae"), F.avg("qlike").alias("mean_qlike"), rejected.alias("arch_rejection_rate"),
        F.avg(F.when(F.col("extreme"), F.col("absolute_error"))).alias("extreme_mae"), F.avg(F.sqrt(per_year * F.col("variance")) - F.sqrt(per_year * F.col("actual"))).alias("target_bias"),
    )


def residual_arch(residuals: DataFrame, keys: list[str], order: str, z: str, lags: int = 5) -> DataFrame:
    """keys, n, r2, lm, p_value: squares of z regressed on their lags, by keys, without collecting a series.

    One window gives the lags, one grouped pass all moments; the normal equations
    are solved in expressions (Cholesky), and the chi-square tail is one too. A
    lag that adds nothing to the others (a zero pivot) is left out, as in a
    least-squares fit of least norm. Rows with a null z don't count.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = residuals.where(F.col(z).isNotNull()).select(*keys, order, (F.col(z).cast("double") ** 2).alias("s0"))
    rows = rows.select(*keys, "s0", *(F.lag("s0", k).over(w).alias(f"s{k}") for k in range(1, lags + 1))).where(F.col(f"s{lags}").isNotNull())
    pairs = [(i, j) for i in range(lags + 1) for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.covar_pop(f"s{i}", f"s{j}").alias(f"c{i}_{j}") for i, j in pairs))
    c = lambda i, j: F.col(f"c{max(i, j)}_{min(i, j)}")
    for j in range(1, lags + 1):  # a column of the triangle at a time, then the solution's j-th part
        pivot = c(j, j) - sum((F.col(f"t{j}_{m}") ** 2 for m in range(1, j)), F.lit(0.0))
        out = out.withColumn(f"t{j}_{j}", F.when(pivot > 1e-12 * c(j, j), F.sqrt(pivot)))
        below = {f"t{i}_{j}": F.coalesce((c(i, j) - sum((F.col(f"t{i}_{m}") * F.col(f"t{j}_{m}") for m in range(1, j)), F.lit(0.0))) / F.col(f"t{j}_{j}"), F.lit(0.0)) for i in range(j + 1, lags + 1)}
        below[f"y{j}"] = F.coalesce((c(j, 0) - sum((F.col(f"t{j}_{m}") * F.col(f"y{m}") for m in range(1, j)), F.lit(0.0))) / F.col(f"t{j}_{j}"), F.lit(0.0))
        out = out.withColumns(below)
    r2 = F.greatest(F.coalesce(safe_divide(sum((col(f"y{j}") ** 2 for j in range(1, lags + 1)), F.lit(0.0)), F.col("c0_0")), F.lit(0.0)), F.lit(0.0))
    return out.select(*keys, "n", r2.alias("r2")).withColumn("lm", F.col("n") * F.col("r2")).withColumn("p_value", chi2_tail_column("lm", lags))


def module_status(ran: dict[str, bool], oos_months: int, mode: str, gate_passed: bool, least: int = 36) -> list[dict]:
    """A row a module and one over all: what ran, whether there are enough months, and whether results may be used."""
    if mode not in ("sample", "real"):
        raise ValueError(f"mode must be sample or real, not {mode}")
    if least < 36:
        raise ValueError("at least 36 months must be asked for")
    enough = oos_months >= least
    common = {"eligible": enough, "oos_months": oos_months, "mode": mode, "synthetic": mode == "sample"}
    rows = [{"module": m, "status": "candidate_complete" if ok else "insufficient_history", **common, "detail": "" if ok else "no fit at any date"} for m, ok in ran.items()]
    ready = mode == "real" and enough and gate_passed
    why = "all gates passed" if ready else "sample data never promote" if mode == "sample" else f"gate_passed={gate_passed}; enough_months={enough}"
    return [*rows, {"module": "overall", "status": "dynamic_ready" if ready else "insufficient_history", **common, "detail": why}]
