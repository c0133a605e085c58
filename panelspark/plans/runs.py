"""End-to-end runs over a folder of standard tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import factors, governance, joins, universe
from ..operators import performance as P
from ..operators import portfolio as B
from ..operators import processing as X
from ..operators import simulator as M
from ..sources.catalog import load_all, write_any
from ..sources.sample import write_sample


def research(spark: SparkSession, folder: str, out: str, config: governance.Config | None = None, run_id: str = "run") -> dict[str, DataFrame]:
    """Panel, processing, ICs, groups, walk-forward, portfolio, simulation and performance; artifacts under out/run_id, which must be new."""
    c = config or governance.Config()
    at = f"{out.rstrip('/')}/{run_id}"
    tables = load_all(spark, folder)
    calendar = tables["trade_calendar"].where("is_open").select("trade_date")

    def may_hold(bar: DataFrame) -> DataFrame:
        return universe.filter_universe(bar, calendar, basics=tables.get("stock_basic"), members=tables.get("index_member"), st=tables.get("st_status"), suspension=tables.get("suspension"), min_sessions=120)

    panel = factors.build_panel(tables, (5, 10, c.research.horizon, 60), may_hold)
    write_any(panel, f"{at}/panel")
    panel = spark.read.schema(panel.schema).parquet(f"{at}/panel")  # later steps start from the written panel
    target = f"future_return_{c.research.horizon}"
    names = [n for n in factors.REGISTRY if n in panel.columns]
    done = X.process(panel, names, {n: factors.REGISTRY[n].neutralize for n in names}, c.mad_n)
    write_any(done, f"{at}/processed")
    done = spark.read.schema(done.schema).parquet(f"{at}/processed")
    labelled = done.withColumn("value", F.col("standardized")).join(panel.select("trade_date", "ts_code", target, "target_return_end_date"), ["trade_date", "ts_code"])
    ic = E.daily_ic(labelled, target)
    ends = joins.attach_timing(ic.select("trade_date", "factor", "ic"), calendar, c.research.horizon).withColumnRenamed("target_return_end_date", "label_end")
    coverage = X.coverage(panel, names, ["trade_date"])
    months = joins.month_end_sessions(panel.select("trade_date").distinct())
    wf = E.walk_forward(ends, months, coverage.select("trade_date", "factor", "coverage"), train_months=c.research.train_months, validation_months=c.research.validation_months, least_dates=c.research.least_dates, max_factors=c.research.max_factors)
    walked = E.weighted_scores(labelled, wf)
    plain = labelled.where("value is not null").join(joins.lookup(months), "trade_date", "left_semi").groupBy("trade_date", "ts_code").agg(F.avg("value").alias("score"))
    score = walked.select("trade_date", "ts_code", "score") if walked.limit(1).count() else plain  # short samples have no walk-forward yet
    book = B.rank_portfolio(score, c.book.top, c.book.max_weight, min(c.book.min_holdings, c.book.top))
    rules = M.Rules(cash=c.book.cash, lot=c.book.lot, participation=c.book.participation, max_turnover=c.book.max_turnover)
    sim = M.run_scenarios(universe.mark_tradability(tables["daily_bar"]), book, {"base": (rules, B.Costs())})
    nav = M.part(sim, "nav")
    results = {
        "factor_ic": ic, "ic_summary": E.ic_summary(ic, ["factor"]), "group_returns": E.group_returns(labelled, target), "coverage": coverage, "walk_forward": wf, "portfolio": book,
        "nav": nav, "orders": M.part(sim, "order"), "positions": M.part(sim, "position"), "performance": P.performance(nav.withColumnRenamed("trade_date", "date"), ["scenario"]),
    }
    for name, df in results.items():
        write_any(df, f"{at}/{name}")
    meta = governance.run_metadata(run_id, c, governance.data_manifest({"daily_bar": tables["daily_bar"]}))
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{at}/run_metadata.json")
    return {name: spark.read.schema(df.schema).parquet(f"{at}/{name}") for name, df in results.items()}


def sample_run(spark: SparkSession, folder: str, stocks: int = 60, days: int = 180) -> dict[str, DataFrame]:
    """The sample bundle written, then a small research run over it."""
    write_sample(spark, f"{folder}/tables", stocks=stocks, days=days)
    small = governance.Config(book=governance.Book(top=10, max_weight=0.1, min_holdings=5), research=governance.Research(horizon=5))
    return research(spark, f"{folder}/tables", folder, small, "sample")


def describe(folder: str) -> dict:
    """Artifacts of a run in a local folder."""
    root = Path(folder)
    return {"artifacts": sorted(p.name for p in root.iterdir() if p.is_dir()), "metadata": [json.loads(line) for f in root.glob("run_metadata.json/part-*") for line in f.read_text().splitlines()]}
