"""Command line: sample data, imports, checks, runs and queries. Exit codes: 0 fine, 1 error or blocking issue, 2 gate not reached."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

VERSION = "0.1.0"


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("panelspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(x) -> int:
    print(json.dumps(x, indent=1, sort_keys=True, default=str))
    return 0


def generate_sample(a) -> int:
    from .sources.sample import write_sample

    return _show(write_sample(_spark(), a.out, a.format))


def run_sample(a) -> int:
    from .plans.runs import sample_run

    return _show([r.asDict() for r in sample_run(_spark(), a.out)["performance"].collect()])


def run_research(a) -> int:
    from .operators.governance import load_config
    from .plans.runs import research

    config = load_config(json.loads(Path(a.config).read_text())) if a.config else None
    return _show([r.asDict() for r in research(_spark(), a.data, a.out, config, a.run_id)["performance"].collect()])


def import_data(a) -> int:
    from .sources.catalog import import_tables

    manifest = import_tables(_spark(), a.data, a.out, json.loads(Path(a.mapping).read_text()), a.format, a.mode)
    Path(a.manifest).write_text(json.dumps(manifest, indent=1))
    return _show({"data_version": manifest["data_version"], "tables": sorted(manifest["tables"])})


def quality_check(a) -> int:
    from .operators.audits import bar_checks, financial_timing
    from .operators.governance import issues_report
    from .sources.catalog import load_all

    t, issues = load_all(_spark(), a.data, views=False), []
    row = bar_checks(t["daily_bar"]).first().asDict()
    issues += [{"severity": "blocking" if k in ("bad_range", "not_positive", "negative", "placeholder_factors") else "review", "table": "daily_bar", "message": f"{k}: {v}"} for k, v in row.items() if k != "rows" and v]
    if "financial_indicator" in t and (n := financial_timing(t["financial_indicator"]).count()):
        issues.append({"severity": "blocking", "table": "financial_indicator", "message": f"timing: {n}"})
    report = issues_report(issues)
    print(report["markdown"] or "no issues")
    return 1 if report["blocked"] else 0


def gate(a) -> int:
    from .operators.audits import gate as verdict
    from .operators.audits import universe_coverage
    from .sources.catalog import load_all

    t = load_all(_spark(), a.data, views=False)
    days = t["trade_calendar"].where("is_open").select("trade_date")
    c = universe_coverage(days, t["index_member"], {"daily_bar": t["daily_bar"], "daily_basic": t["daily_basic"]}, t.get("suspension"))
    v = verdict({"universe_coverage": not c.where("not passed").limit(1).count()})
    _show(v)
    return 0 if v["passed"] else 2


def verify_data(a) -> int:
    from .operators.governance import verify_manifest
    from .sources.catalog import load_all

    bad = verify_manifest(json.loads(Path(a.manifest).read_text()), load_all(_spark(), a.data, views=False))
    _show({"changed": bad})
    return 1 if bad else 0


def write_manifest(a) -> int:
    from .operators.governance import data_manifest
    from .sources.catalog import load_all

    Path(a.manifest).write_text(json.dumps(data_manifest(load_all(_spark(), a.data, views=False)), indent=1))
    return 0


def validate_config(a) -> int:
    from .operators.governance import config_sha256, load_config

    return _show({"sha256": config_sha256(load_config(json.loads(Path(a.config).read_text())))})


def validate_protocol(a) -> int:
    from .operators.governance import validate_research_protocol

    return _show(validate_research_protocol(json.loads(Path(a.config).read_text())))


def text_events(a) -> int:
    from .operators import text_events as V

    spark = _spark()
    e = V.prepare(spark.read.parquet(a.data))
    e.write.mode("error").parquet(f"{a.out}/prepared")
    e = spark.read.parquet(f"{a.out}/prepared")
    if a.step in ("label", "represent"):
        V.label(e).write.mode("error").parquet(f"{a.out}/labels")
    if a.step == "represent":
        V.representation(e, spark.read.parquet(f"{a.out}/labels").drop("cached"), "1").write.mode("error").parquet(f"{a.out}/representation")
    return _show([r.asDict() for r in V.quality_report(e).collect()])


def describe_run(a) -> int:
    from .plans.runs import describe

    return _show(describe(a.data))


def _date(x: str):
    import datetime as dt

    return dt.date.fromisoformat(x)


def build_monthly_sample(a) -> int:
    from .plans.monthly import build_sample

    manifest = json.loads(Path(a.manifest).read_text()) if a.manifest else None
    s = build_sample(_spark(), a.data, a.out, a.mode, manifest, _date(a.start), _date(a.holdout))
    _show(s)
    return s["exit_code"]


def time_series_baselines(a) -> int:
    from .plans.monthly import run_baselines

    s = run_baselines(_spark(), a.data, a.out, _date(a.start), _date(a.end), _date(a.holdout))
    _show(s)
    return s["exit_code"]


def time_series_models(a) -> int:
    from .plans.monthly import run_models

    s = run_models(_spark(), a.data, a.out, _date(a.holdout), a.mode, a.gate_passed == "yes")
    _show(s)
    return s["exit_code"]


def quality_steps(a) -> int:
    from .plans.quality import run, steps

    return _show(run(steps(tests=a.tests == "yes")))


def run_query(a) -> int:
    from .plans.catalogue import QUERIES

    if a.name not in QUERIES:
        print("\n".join(sorted(QUERIES)))
        return 1
    QUERIES[a.name](_spark(), a.data).show(a.rows, truncate=False)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("panelspark", description=__doc__)
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)

    def add(command: str, f, *options: str, **fixed) -> None:
        q = sub.add_parser(command)
        for o in options:
            kinds = {"rows": {"type": int, "default": 20}, "format": {"default": "parquet"}, "mode": {"default": "sample"}, "run_id": {"default": "run"}, "config?": {"default": None}, "manifest?": {"default": None}, "start": {"default": "2015-01-01"}, "end": {"default": "2023-12-31"}, "holdout": {"default": "2024-01-01"}, "gate_passed": {"default": "no", "choices": ["yes", "no"]}, "tests": {"default": "yes", "choices": ["yes", "no"]}}
            q.add_argument(f"--{o.rstrip('?').replace('_', '-')}", dest=o.rstrip("?"), **kinds.get(o, {"required": True}))
        q.set_defaults(f=f, **fixed)

    add("generate-sample", generate_sample, "out", "format")
    add("run-sample", run_sample, "out")
    add("run-research", run_research, "data", "out", "config?", "run_id")
    add("import-data", import_data, "data", "out", "mapping", "manifest", "format", "mode")
    add("quality-check", quality_check, "data")
    add("gate", gate, "data")
    add("write-manifest", write_manifest, "data", "manifest")
    add("verify-data", verify_data, "data", "manifest")
    add("validate-config", validate_config, "config")
    add("validate-protocol", validate_protocol, "config")
    for step, name in (("prepare", "prepare-text-events"), ("label", "label-events"), ("represent", "build-label-representation")):
        add(name, text_events, "data", "out", step=step)
    add("describe-run", describe_run, "data")
    add("run-quality-checks", quality_steps, "tests")
    add("query", run_query, "name", "data", "rows")
    add("build-monthly-sample", build_monthly_sample, "data", "out", "mode", "manifest?", "start", "holdout")
    add("run-time-series-baselines", time_series_baselines, "data", "out", "start", "end", "holdout")
    add("run-time-series-models", time_series_models, "data", "out", "holdout", "mode", "gate_passed")
    for command, name in (("run-robustness", "execution_scenarios"), ("run-portfolio-ablation", "ablation"), ("run-promotion-audit", "promotion_audit")):
        add(command, run_query, "data", "rows", name=name)
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        return a.f(a)
    except (ValueError, FileNotFoundError, FileExistsError, KeyError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
