"""Model runs over many series and dates: grids, regimes, volatility, weights, exposure, ablation, promotion."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from ..functions.stats import benjamini_hochberg
from .joins import lookup
from .models import EWMA_ALPHA, dcc_covariance, diagnostics, expanding_forecasts, fit_best_hmm, fit_volatility, gjr_grid_forecast, kalman_column, nearest_psd, risk_contributions, spa_test, stress_labels

# The pre-registered grid.
GRID_Q, GRID_R, GRID_PENALTY = (0.0001, 0.001, 0.01), (0.005, 0.01, 0.02), (0.0, 0.2, 0.4)


def trial_id(q: float, r: float, penalty: float) -> str:
    return f"q{q:g}-r{r:g}-p{penalty:g}"


def trial_registry() -> list[dict]:
    return [{"trial_id": trial_id(q, r, p), "q": q, "r": r, "penalty": p} for q in GRID_Q for r in GRID_R for p in GRID_PENALTY]


def validate_registry(rows: list[dict]) -> None:
    """Exactly the registered triples, each once."""
    want = sorted((x["q"], x["r"], x["penalty"]) for x in trial_registry())
    if sorted((float(x["q"]), float(x["r"]), float(x["penalty"])) for x in rows) != want:
        raise ValueError("trials differ from the registered grid")


def history(series: DataFrame, dates: DataFrame, keys: list[str], value: str, available: str) -> DataFrame:
    """(test_date, keys, xs): values available strictly before each date, in order of availability."""
    t = lookup(dates.select(F.col("trade_date").alias("test_date")).distinct())
    rows = series.where(F.col(value).isNotNull()).join(t, F.col(available) < F.col("test_date"))
    xs = F.transform(F.array_sort(F.collect_list(F.struct(F.col(available).alias("d"), F.col(value).alias("x")))), lambda s: s["x"])
    return rows.groupBy("test_date", *keys).agg(xs.alias("xs"))  # one monthly series: some hundred values


def kalman_forecasts(ic: DataFrame, dates: DataFrame, available: str = "availability_date") -> DataFrame:
    """(test_date, factor, q, r, forecast, variance, n) over the grid's (q, r); the penalties share them."""
    h = history(ic, dates, ["factor"], "ic", available)
    grid = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.lit(r).alias("r"), kalman_column("xs", q, r).alias("k")) for q in GRID_Q for r in GRID_R)))
    return h.select("test_date", "factor", grid.alias("g")).select("test_date", "factor", "g.q", "g.r", "g.k.forecast", "g.k.variance", "g.k.n")


def cap_redistribute(w: np.ndarray, cap: float) -> np.ndarray:
    """Weights at most cap; the excess goes to the others in proportion, until none is above."""
    w = w / w.sum() if w.sum() > 0 else w
    fixed = np.zeros(len(w), bool)
    while len(w) and (w > cap + 1e-12).any() and cap * len(w) >= 1:
        fixed |= w > cap
        w = np.where(fixed, cap, w)
        free = w[~fixed].sum()
        if free <= 0:
            break
        w[~fixed] *= (1 - cap * fixed.sum()) / free
    return w


def cap_clip(w: np.ndarray, cap: float, rounds: int = 50) -> np.ndarray:
    """Clip at cap and normalise again and again: the other fixed point, below cap where too few weights carry the rest."""
    for _ in range(rounds):
        if w.sum() <= 0:
            break
        w = np.minimum(w / w.sum(), cap)
        if abs(w.sum() - 1) < 1e-12:
            break
    return w


WEIGHTS = "test_date date, trial_id string, factor string, weight double, direction double, turnover double, hhi double"


def trial_weights(forecasts: DataFrame, cap: float = 0.2, top: int = 10) -> DataFrame:
    """Weights by trial and date: strength |forecast| / sd, best `top`, capped, blended with the weights before by the penalty."""
    penalties = F.explode(F.array(*(F.lit(float(p)) for p in GRID_PENALTY)))
    rows = forecasts.where("forecast is not null").select("*", penalties.alias("penalty"))
    rows = rows.withColumn("trial_id", F.format_string("q%s-r%s-p%s", F.col("q").cast("string"), F.col("r").cast("string"), F.col("penalty").cast("string")))
    rows = rows.withColumn("strength", F.abs("forecast") / F.sqrt("variance"))

    def blend(trial: pd.DataFrame) -> pd.DataFrame:
        out, before = [], {}
        for day, g in trial.sort_values(["test_date", "factor"]).groupby("test_date"):
            g = g.sort_values(["strength", "factor"], ascending=[False, True]).head(top)
            if len(g) < math.ceil(1 / cap):
                continue
            new = dict(zip(g["factor"], cap_redistribute(g["strength"].to_numpy(float), cap), strict=True))
            sign = dict(zip(g["factor"], np.sign(g["forecast"]), strict=True))
            k = float(trial["penalty"].iat[0]) if before else 0.0
            names = sorted({*new, *before})
            w = cap_redistribute(np.array([(1 - k) * new.get(f, 0.0) + k * before.get(f, (0.0, 0.0))[0] for f in names]), cap)
            moved = 0.5 * sum(abs(x - before.get(f, (0.0, 0.0))[0]) for f, x in zip(names, w, strict=True))
            before = {f: (x, sign.get(f, before.get(f, (0.0, 0.0))[1])) for f, x in zip(names, w, strict=True) if x > 1e-12}
            out += [(day, trial["trial_id"].iat[0], f, x, s, moved, float((w * w).sum())) for f, (x, s) in before.items()]
        return pd.DataFrame(out, columns=[c.split()[0] for c in WEIGHTS.split(", ")])

    return rows.groupBy("trial_id").applyInPandas(blend, WEIGHTS)


def significant_weights(ic: DataFrame, inference: DataFrame, forecasts: DataFrame, cap: float = 0.2, most_q: float = 0.05, top: int = 10) -> DataFrame:
    """(test_date, factor, weight, direction): factors with q-value at most most_q, by strength, clipped at cap."""
    f = forecasts.join(inference.select("test_date", "factor", "q_value"), ["test_date", "factor"]).where((F.col("q_value") <= most_q) & F.col("forecast").isNotNull())
    f = f.withColumn("strength", F.abs("forecast") / F.sqrt("variance"))
    f = f.withColumn("r", F.row_number().over(Window.partitionBy("test_date").orderBy(F.desc("strength"), "factor"))).where(F.col("r") <= top)

    def capped(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"test_date": g["test_date"], "factor": g["factor"], "weight": cap_clip(g["strength"].to_numpy(float), cap), "direction": np.sign(g["forecast"])})

    return f.select("test_date", "factor", "forecast", "strength").groupBy("test_date").applyInPandas(capped, "test_date date, factor string, weight double, direction double")


REGIME = "test_date date, states int, state int, label string, probability double, duration double, loglik double, status string"


def regimes(variables: DataFrame, dates: DataFrame, columns: list[str], states: tuple[int, ...] = (2, 3), least: int = 24, inclusive: bool = False) -> DataFrame:
    """Filtered state probabilities at each date from variables dated strictly before it (inclusive: at it too, as earlier tables had it); one grouped model a (date, states)."""
    t = lookup(dates.select(F.col("trade_date").alias("test_date")).distinct())
    known = F.col("date") <= F.col("test_date") if inclusive else F.col("date") < F.col("test_date")
    rows = variables.join(t, known).select("test_date", "date", *columns, F.explode(F.array(*(F.lit(k) for k in states))).alias("states"))

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("date")[columns].astype(float).dropna().to_numpy()
        names = [c.split()[0] for c in REGIME.split(", ")]
        if len(x) < least or (x.std(axis=0) == 0).any():
            return pd.DataFrame([(key[0], key[1], None, None, None, None, None, "insufficient_history")], columns=names)
        x = (x - x.mean(axis=0)) / x.std(axis=0)
        m = fit_best_hmm(x, int(key[1]))
        p, label = m.filtered(x)[-1], stress_labels(m.mean, columns)
        stay = np.clip(np.diag(m.move), 0, 1 - 1e-9)
        return pd.DataFrame([(key[0], key[1], i, label[i], float(p[i]), float(1 / (1 - stay[i])), m.loglik, "ok") for i in range(m.k)], columns=names)

    return rows.groupBy("test_date", "states").applyInPandas(fit, REGIME)


VOLATILITY = "series string, test_date date, model string, forecast_vol double, status string"


def volatility_forecasts(returns: DataFrame, dates: DataFrame, least: int = 36, kinds: tuple[str, ...] = ("garch", "gjr", "egarch"), inclusive: bool = False) -> DataFrame:
    """Historical (last 20, last 60), EWMA, grid GJR and fitted (kinds) next-step volatility by series and date, from returns before it (inclusive: at it too). returns: series, date, ret."""
    t = lookup(dates.select(F.col("trade_date").alias("test_date")).distinct())
    known = F.col("date") <= F.col("test_date") if inclusive else F.col("date") < F.col("test_date")
    rows = returns.where("ret is not null").join(t, known).select("series", "test_date", "date", "ret")

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        r, out = g.sort_values("date")["ret"].to_numpy(float), []
        out.append(("historical_20", float(r[-20:].std(ddof=1)), "ok") if len(r) >= 20 else ("historical_20", None, "insufficient_history"))
        if len(r) < least:
            out.append(("all", None, "insufficient_history"))
        else:
            square = (r - r.mean()) ** 2
            v = square[0]
            for x in square[1:]:
                v = 0.94 * v + 0.06 * x
            grid = gjr_grid_forecast(r)
            out += [("historical_60", float(r[-60:].std(ddof=1)), "ok"), ("ewma", math.sqrt(0.94 * v + 0.06 * square[-1]), "ok"), ("gjr_grid", grid, "insufficient_history" if grid is None else "ok")]
            for kind in kinds:
                m = fit_volatility(r, kind)
                out.append((kind, m["forecast_vol"], m["status"]))
        return pd.DataFrame([(key[0], key[1], *x) for x in out], columns=["series", "test_date", "model", "forecast_vol", "status"])

    return rows.groupBy("series", "test_date").applyInPandas(fit, VOLATILITY)


def volatility_comparison(forecasts: DataFrame, returns: DataFrame, share: float = 0.95) -> DataFrame:
    """By series and model: forecasts, mean error, absolute error and quasi-likelihood loss of variances, extreme next returns.

    A forecast's target is the first return at or after its date; it is extreme
    if it is as large as the `share` quantile of what was known before.
    """
    r = returns.where("ret is not null").select("series", "date", "ret")
    dates = forecasts.where("forecast_vol is not null").select("series", "test_date").distinct()
    met = dates.join(r, "series").groupBy("series", "test_date").agg(
        F.min_by("ret", F.when(F.col("date") >= F.col("test_date"), F.col("date"))).alias("next"),
        F.max(F.when(F.col("date") >= F.col("test_date"), True)).alias("open"),
        F.percentile(F.when(F.col("date") < F.col("test_date"), F.abs("ret")), F.lit(share)).alias("edge"),
    )
    variance = F.greatest(F.col("forecast_vol") ** 2, F.lit(1e-12))
    rows = forecasts.where("forecast_vol is not null").join(met.where("open"), ["series", "test_date"]).select("series", "model", variance.alias("v"), (F.col("next") ** 2).alias("a"), (F.abs("next") >= F.col("edge")).alias("extreme"))
    return rows.groupBy("series", "model").agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("v")).alias("mean_error"), F.avg(F.abs(F.col("a") - F.col("v"))).alias("mean_absolute_error"), F.avg(F.log("v") + F.col("a") / F.col("v")).alias("qlike"), F.count_if("extreme").alias("extremes"))


COVARIANCE = "test_date date, factor_a string, factor_b string, covariance double, risk_share double, status string"


def dynamic_covariances(spreads: DataFrame, dates: DataFrame, least: int = 20) -> DataFrame:
    """Dynamic-correlation covariance of factor returns by date, repaired to be positive, with equal-weight risk shares. spreads: date, factor, ret."""
    t = lookup(dates.select(F.col("trade_date").alias("test_date")).distinct())
    rows = spreads.where("ret is not null").join(t, F.col("date") < F.col("test_date")).select("test_date", "date", "factor", "ret")

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot_table(index="date", columns="factor", values="ret").dropna()
        if len(wide) < least:
            return pd.DataFrame([(key[0], None, None, None, None, "insufficient_history")], columns=[c.split()[0] for c in COVARIANCE.split(", ")])
        c = nearest_psd(dcc_covariance(wide.to_numpy(float)))
        share = risk_contributions(c, np.full(len(c), 1 / len(c)))
        n = list(wide.columns)
        return pd.DataFrame([(key[0], a, b, c[i, j], share[i] if i == j else None, "ok") for i, a in enumerate(n) for j, b in enumerate(n)], columns=[x.split()[0] for x in COVARIANCE.split(", ")])

    return rows.groupBy("test_date").applyInPandas(fit, COVARIANCE)


FORECAST = "series string, position int, model string, forecast double, actual double"


def baseline_forecasts(series: DataFrame, least: int = 12) -> DataFrame:
    """Expanding one-step forecasts of every series. series: series, date, value."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("date")["value"].dropna().to_numpy(float)
        rows = expanding_forecasts(x, least=least)
        return pd.DataFrame([(key[0], r["position"], r["model"], r["forecast"], r["actual"]) for r in rows], columns=["series", "position", "model", "forecast", "actual"])

    return series.groupBy("series").applyInPandas(run, FORECAST)


def series_diagnostics(series: DataFrame) -> DataFrame:
    """(series, name, value) of the diagnostics of each series."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        d = diagnostics(g.sort_values("date")["value"].to_numpy(float))
        return pd.DataFrame([(key[0], k, None if v is None or isinstance(v, str) else float(v), v if isinstance(v, str) else None) for k, v in d.items()], columns=["series", "name", "value", "note"])

    return series.groupBy("series").applyInPandas(run, "series string, name string, value double, note string")


def exposure_scalars(bear: DataFrame, vol: DataFrame, target: float = 0.15, least: float = 0.9) -> DataFrame:
    """(trade_date, scalar): (1 - (1 - least) * P(bear)) * min(1, target / volatility), within [least, 1]."""
    j = bear.join(vol, "trade_date", "full_outer")
    a = 1 - (1 - least) * F.coalesce("bear_probability", F.lit(0.0))
    b = F.least(F.lit(1.0), F.coalesce(safe_divide(F.lit(target), "volatility"), F.lit(1.0)))
    return j.select("trade_date", F.greatest(F.least(a * b, F.lit(1.0)), F.lit(least)).alias("scalar"))


def state_variables(bar: DataFrame) -> DataFrame:
    """Market state by date: breadth, dispersion, log median amount, mean return. bar: trade_date, ret, amount."""
    return bar.where("ret is not null").groupBy("trade_date").agg(F.avg((F.col("ret") > 0).cast("double")).alias("breadth"), F.stddev_samp("ret").alias("dispersion"), F.log(F.percentile("amount", F.lit(0.5))).alias("liquidity"), F.avg("ret").alias("market_return"))


def scheme_weights(ic: DataFrame, dates: DataFrame, available: str = "availability_date") -> DataFrame:
    """(test_date, scheme, factor, weight): signed weights by static mean, 12 and 24 last and EWMA of the IC known before each date; gross 1."""
    h = history(ic, dates, ["factor"], "ic", available)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    tail = lambda n: F.slice("xs", -1 * F.least(F.size("xs"), F.lit(n)), F.lit(n))
    ewma = F.aggregate("xs", F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(0.9 * a + 0.1 * x))
    schemes = F.explode(F.array(*(F.struct(F.lit(n).alias("scheme"), v.alias("v")) for n, v in (("static", mean(F.col("xs"))), ("rolling_12", mean(tail(12))), ("rolling_24", mean(tail(24))), ("ewma", ewma)))))
    rows = h.where(F.size("xs") > 0).select("test_date", "factor", schemes.alias("s")).select("test_date", "s.scheme", "factor", "s.v")
    return rows.select("test_date", "scheme", "factor", safe_divide("v", F.sum(F.abs("v")).over(Window.partitionBy("test_date", "scheme"))).alias("weight"))


# ---------------------------------------------------------------- ablation and promotion

# Portfolios of the ablation: weight scheme, regime scaling, volatility scaling.
PORTFOLIOS = {"A": ("static", False, False), "B": ("rule", False, False), "C": ("kalman", False, False), "D": ("static", True, False), "E": ("static", False, True), "F": ("kalman", True, False), "G": ("kalman", True, True)}


def regime_scalars(states: DataFrame, least: float = 0.9) -> DataFrame:
    """(date, regime): 1 - (1 - least) * P(bear) of three-state models where they are fitted, else of two-state ones."""
    bear = states.where("status = 'ok' and label = 'bear'").groupBy("test_date").agg(F.max_by("probability", "states").alias("p"))
    return bear.select(F.col("test_date").alias("date"), (1 - (1 - least) * F.col("p")).alias("regime"))


def volatility_scalars(forecasts: DataFrame, model: str = "gjr", per_year: int = 252, target: float = 0.15, least: float = 0.9) -> DataFrame:
    """(date, volatility): target over the model's yearly volatility, within [least, 1]."""
    yearly = F.col("forecast_vol") * math.sqrt(per_year)
    rows = forecasts.where((F.col("model") == model) & (F.col("status") == "ok") & (yearly > 0))
    return rows.select(F.col("test_date").alias("date"), F.greatest(F.least(target / yearly, F.lit(1.0)), F.lit(least)).alias("volatility"))


def risk_scaled(weights: DataFrame, covariances: DataFrame) -> DataFrame:
    """weights (scheme, date, factor, weight) over the factors' conditional deviations, gross 1; as they are where fewer than two are known."""
    own = covariances.where("factor_a = factor_b and covariance > 0").select(F.col("test_date").alias("date"), F.col("factor_a").alias("factor"), F.col("covariance").alias("__c"))
    w = Window.partitionBy("scheme", "date")
    rows = weights.join(own, ["date", "factor"], "left").withColumn("__n", F.count("__c").over(w)).withColumn("__x", F.col("weight") / F.sqrt("__c"))
    scaled = F.coalesce(safe_divide("__x", F.sum(F.abs("__x")).over(w)), F.col("weight"))
    return rows.withColumn("__s", F.when(F.col("__n") >= 2, scaled).otherwise(F.col("weight"))).where((F.col("__n") < 2) | F.col("__c").isNotNull()).select("scheme", "date", "factor", F.col("__s").alias("weight"))


def ablation(weights: DataFrame, returns: DataFrame, scalars: DataFrame, costs: float = 0.0015, covariances: DataFrame | None = None) -> DataFrame:
    """(portfolio, date, gross, turnover, cost, net). weights: scheme, date, factor, weight (signed); returns: date, factor, ret; scalars: date, regime, volatility.

    With covariances, portfolios with volatility scaling take risk-scaled weights.
    """
    spark = weights.sparkSession
    table = F.broadcast(spark.createDataFrame([(p, *x) for p, x in PORTFOLIOS.items()], "portfolio string, scheme string, by_regime boolean, by_vol boolean"))
    dealt = weights.join(table, "scheme")
    if covariances is not None:
        dealt = dealt.where("not by_vol").unionByName(risk_scaled(weights, covariances).join(table.where("by_vol"), "scheme"), allowMissingColumns=True)
    w = dealt.join(lookup(scalars.withColumnsRenamed({"regime": "__r", "volatility": "__v"})), "date", "left")
    scale = F.when(F.col("by_regime"), F.coalesce("__r", F.lit(1.0))).otherwise(1.0) * F.when(F.col("by_vol"), F.coalesce("__v", F.lit(1.0))).otherwise(1.0)
    w = w.select("portfolio", "date", "factor", (F.col("weight") * scale).alias("w"))
    days = w.select("portfolio", "date").distinct().withColumn("next", F.lead("date").over(Window.partitionBy("portfolio").orderBy("date")))
    before = w.join(days, ["portfolio", "date"]).where("next is not null").select("portfolio", F.col("next").alias("date"), "factor", F.col("w").alias("p"))
    both = w.join(before, ["portfolio", "date", "factor"], "full_outer").join(returns, ["date", "factor"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    g = both.groupBy("portfolio", "date").agg(F.sum(z("w") * z("ret")).alias("gross"), (F.sum(F.abs(z("w") - z("p"))) / 2).alias("turnover"))
    return g.withColumn("cost", 2 * F.col("turnover") * costs).withColumn("net", F.col("gross") - F.col("cost"))


def common_interval(rows: DataFrame, key: str = "portfolio", date: str = "date") -> DataFrame:
    """Rows from the latest first date to the earliest last date over all keys."""
    spans = rows.groupBy(key).agg(F.min(date).alias("a"), F.max(date).alias("b")).agg(F.max("a").alias("__a"), F.min("b").alias("__b"))
    return rows.join(F.broadcast(spans), (F.col(date) >= F.col("__a")) & (F.col(date) <= F.col("__b"))).drop("__a", "__b")


# Which portfolio is compared with which.
COMPARISONS = (("C", "A"), ("D", "A"), ("E", "A"), ("F", "C"), ("G", "F"), ("G", "A"))


def incremental(rows: DataFrame, per_year: int = 12) -> DataFrame:
    """(candidate, base, months, mean_gain, yearly_gain, positive_share, t_value) of net returns on the dates of both."""
    pairs = F.broadcast(rows.sparkSession.createDataFrame(COMPARISONS, "candidate string, base string"))
    net = rows.select("portfolio", "date", "net")
    met = net.join(pairs, F.col("portfolio") == F.col("candidate")).drop("portfolio").join(net.select(F.col("portfolio").alias("base"), "date", F.col("net").alias("__b")), ["base", "date"])
    gain = F.col("net") - F.col("__b")
    g = met.groupBy("candidate", "base").agg(F.count("*").alias("months"), F.avg(gain).alias("mean_gain"), F.avg((gain > 0).cast("double")).alias("positive_share"), F.stddev_samp(gain).alias("__s"))
    return g.select("candidate", "base", "months", "mean_gain", (F.col("mean_gain") * per_year).alias("yearly_gain"), "positive_share", safe_divide(F.col("mean_gain") * F.sqrt("months"), F.col("__s")).alias("t_value"))


def cost_sensitivity(rows: DataFrame, scales: tuple[float, ...] = (0.0, 0.5, 1.0, 2.0)) -> DataFrame:
    """Mean net return by portfolio and cost scale: net is linear in costs, so nothing is simulated again."""
    s = F.explode(F.array(*(F.lit(float(x)) for x in scales)))
    return rows.select("portfolio", "gross", "cost", s.alias("cost_scale")).groupBy("portfolio", "cost_scale").agg(F.avg(F.col("gross") - F.col("cost") * F.col("cost_scale")).alias("mean_net"))


# Least or most value of each gate.
GATES = {"oos_months": (">=", 36), "annual_gain": (">", 0.0), "positive_years": (">", 0.5), "ir_gain": (">=", 0.15), "drawdown_change": (">=", -0.10), "least_p": ("<=", 0.05), "deflated_sharpe": (">=", 0.95), "overfitting": ("<=", 0.20), "violations": ("<=", 0), "trial_coverage": (">=", 1.0)}
LEVELS = ("rejected", "insufficient_evidence", "research_candidate", "production_candidate")


def promotion(metrics: dict[str, float | None], sample_mode: bool = False) -> dict:
    """Ten gates and the level they allow; a missing figure fails its gate."""
    def passed(name: str) -> bool:
        sign, bar = GATES[name]
        x = metrics.get(name)
        return x is not None and {">=": x >= bar, ">": x > bar, "<=": x <= bar}[sign]

    gates = {n: passed(n) for n in GATES}
    unknown = any(metrics.get(n) is None for n in GATES)
    level = 3 if all(gates.values()) else 1 if unknown or not gates["oos_months"] else 2 if gates["annual_gain"] and gates["violations"] and gates["trial_coverage"] else 0
    level = min(level, 2) if sample_mode else level
    return {"gates": gates, "level": level, "conclusion": LEVELS[level], "dynamic_ready": level == 3}


def promotion_of(rows: DataFrame, base: str = "A", candidate: str = "G", **known) -> dict:
    """Promotion metrics of two portfolios' net returns (some hundred months, collected), with known figures added."""
    from .models import deflated_sharpe, diebold_mariano

    p = rows.where(F.col("portfolio").isin(base, candidate)).groupBy("date").pivot("portfolio", [base, candidate]).agg(F.first("net")).orderBy("date").toPandas().dropna()
    a, b = p[base].to_numpy(float), p[candidate].to_numpy(float)
    n = len(p)
    if n < 2:
        return promotion({"oos_months": n} | known)
    year = pd.to_datetime(p["date"]).dt.year
    fall = lambda r: float((np.cumprod(1 + r) / np.maximum.accumulate(np.cumprod(1 + r)) - 1).min())
    ratio = lambda r: float(r.mean() / r.std(ddof=1) * math.sqrt(12)) if r.std(ddof=1) > 0 else 0.0
    dm, spa = diebold_mariano(a, b)["p_value"], spa_test((b - a)[:, None])
    ps = [x for x in (dm, spa) if x is not None]
    gains = pd.Series(b - a).groupby(year).sum()
    found = {"oos_months": n, "annual_gain": float((b.mean() - a.mean()) * 12), "positive_years": float((gains > 0).mean()), "ir_gain": ratio(b) - ratio(a), "drawdown_change": fall(b) - fall(a), "least_p": min(ps) if ps else None, "deflated_sharpe": deflated_sharpe(b, 27, 12)}
    return promotion(found | known) | {"metrics": json.loads(json.dumps(found | known))}


def inference_by_date(ic: DataFrame, dates: DataFrame, available: str = "availability_date", lags: int = 3) -> DataFrame:
    """(test_date, factor, mean, nw_p, q_value) from ICs known before each date."""
    from ..functions.stats import newey_west

    t = lookup(dates.select(F.col("trade_date").alias("test_date")).distinct())
    rows = ic.where("ic is not null").join(t, F.col(available) < F.col("test_date"))
    return benjamini_hochberg(newey_west(rows, "ic", ["test_date", "factor"], available, lags), "nw_p", ["test_date"])


class Forecaster:
    """Fit, update and forecast of one series with monotone time: what comes late is refused."""

    MODELS = ("historical_mean", "ewma", "kalman", "gjr")

    def __init__(self, model: str = "kalman", q: float = 0.001, r: float = 0.01, alpha: float = EWMA_ALPHA) -> None:
        if model not in self.MODELS:
            raise ValueError(f"unknown model {model}")
        self.model, self.q, self.r, self.alpha, self.xs, self.cut = model, q, r, alpha, [], None

    def fit(self, rows: Iterator[tuple]) -> Forecaster:
        self.xs, self.cut = [], None
        for at, x in sorted(rows):
            self.update(at, x)
        return self

    def update(self, at, x: float) -> None:
        if self.cut is not None and at <= self.cut:
            raise ValueError(f"{at} isn't after {self.cut}")
        self.cut = at
        self.xs.append(float(x))

    def forecast(self, target) -> dict:
        from .models import kalman

        if self.cut is None or target <= self.cut:
            raise ValueError("a forecast's target must be later than all that is known")
        x, variance = np.array(self.xs), None
        if self.model == "historical_mean":
            value = float(x.mean())
        elif self.model == "ewma":
            value = x[0]
            for y in x[1:]:
                value = (1 - self.alpha) * value + self.alpha * y
        elif self.model == "kalman":
            m, v = kalman(x, self.q, self.r)
            value, variance = float(m[-1]), float(v[-1])
        else:
            value = gjr_grid_forecast(x)
        return {"model": self.model, "as_of": self.cut, "target": target, "value": value, "variance": variance, "n": len(x)}


def strategy_comparison(navs: DataFrame, trials: int, per_year: int = 252, key: str = "strategy", date: str = "date") -> DataFrame:
    """Performance of strategies on their common active interval with the deflated Sharpe probability. navs: strategy, date, nav, holding_count.

    A strategy is active from its first holding; the interval starts at the latest of these.
    """
    from .models import deflated_sharpe
    from .performance import performance, returns_of

    first = navs.where("holding_count > 0").groupBy(key).agg(F.min(date).alias("a")).agg(F.max("a").alias("__a"))  # one row
    rows = navs.join(F.broadcast(first), F.col(date) >= F.col("__a")).drop("__a")

    def deflate(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(k[0], deflated_sharpe(g["ret"].to_numpy(float), trials, per_year))], columns=[key, "deflated_sharpe"])

    table = performance(rows, [key], date=date, per_year=per_year)
    deflated = returns_of(rows, "nav", date, [key]).where("ret is not null").select(key, "ret").groupBy(key).applyInPandas(deflate, f"{key} string, deflated_sharpe double")
    return table.join(deflated, key, "left")


def strategy_audit(returns: DataFrame, trials: int, per_year: int = 252, least_months: int = 36, key: str = "strategy", date: str = "date", ret: str = "ret") -> DataFrame:
    """audit_type, model, observations, oos_months, trial_count, dsr_probability, pbo, status: a row a strategy and one of overfitting over all.

    Returns are cut to the interval on which every strategy has some. A strategy
    is eligible with enough months and a deflated Sharpe probability of 0.95.
    """
    from .models import backtest_overfitting, deflated_sharpe

    rows = returns.where(F.col(ret).isNotNull())
    span = rows.groupBy(key).agg(F.min(date).alias("a"), F.max(date).alias("b")).agg(F.max("a").alias("__a"), F.min("b").alias("__b"))  # one row
    rows = rows.join(F.broadcast(span), F.col(date).between(F.col("__a"), F.col("__b"))).select(key, date, ret)

    def deflate(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        months = g[date].map(lambda d: (d.year, d.month)).nunique()
        p = deflated_sharpe(g.sort_values(date)[ret].to_numpy(float), trials, per_year)
        good = p is not None and months >= least_months and p >= 0.95
        return pd.DataFrame([("deflated_sharpe", str(k[0]), len(g), months, trials, p, None, "eligible" if good else "not_promoted")], columns=[c.split()[0] for c in AUDIT.split(", ")])

    each = rows.groupBy(key).applyInPandas(deflate, AUDIT)
    whole = rows.agg(F.count_distinct(date).alias("observations"), F.count_distinct(F.trunc(date, "MM")).alias("oos_months"))
    pbo = backtest_overfitting(rows, key, date, ret)
    all_ = pbo.crossJoin(F.broadcast(whole)).select(  # one row each
        F.lit("probability_of_backtest_overfitting").alias("audit_type"), F.lit("all_strategies").alias("model"), "observations", "oos_months", F.lit(trials).cast("bigint").alias("trial_count"),
        F.lit(None).cast("double").alias("dsr_probability"), "pbo", F.when(F.col("splits") > 0, "ok").otherwise("insufficient_history").alias("status"),
    )
    return each.unionByName(all_)


AUDIT = "audit_type string, model string, observations bigint, oos_months bigint, trial_count bigint, dsr_probability double, pbo double, status string"
