"""Driver-side rules over small documents: configs, protocols, registries, manifests, evidence, run metadata."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, date, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import content_hash
from ..sources.schema import duplicate_keys
from .text_events import fingerprint


@dataclass(frozen=True)
class Research:
    start: str = "2018-01-01"
    frequency: str = "month_end"
    horizon: int = 20
    train_months: int = 24
    validation_months: int = 6
    least_dates: int = 6
    least_ic: float = 0.01
    least_coverage: float = 0.30
    max_factors: int = 12
    holdout_start: str = "2024-01-01"


@dataclass(frozen=True)
class Book:
    top: int = 50
    max_weight: float = 0.05
    min_holdings: int = 30
    max_industry: float = 0.30
    max_cash: float = 0.10
    lot: int = 100
    max_turnover: float = 0.5
    participation: float = 0.05
    cash: float = 1_000_000.0


@dataclass(frozen=True)
class Config:
    research: Research = field(default_factory=Research)
    book: Book = field(default_factory=Book)
    mad_n: float = 3.0
    neutralize: bool = True


def load_config(raw: dict) -> Config:
    """A config from nested dicts; keys that nothing reads, and values out of range, raise."""

    def build(kind, part: dict, at: str):
        known = {f.name for f in fields(kind)}
        if odd := sorted(set(part) - known):
            raise ValueError(f"unused keys: {', '.join(f'{at}{k}' for k in odd)}")
        return kind(**part)

    raw = dict(raw)
    c = build(Config, {k: (build(Research, v, "research.") if k == "research" else build(Book, v, "book.") if k == "book" else v) for k, v in raw.items()}, "")
    problems = []
    for name, ok in {
        "research.horizon": c.research.horizon > 0, "research.least_coverage": 0 <= c.research.least_coverage <= 1, "research.max_factors": c.research.max_factors > 0,
        "book.max_weight": 0 < c.book.max_weight <= 1, "book.top": c.book.top * c.book.max_weight >= 1, "book.min_holdings": 0 < c.book.min_holdings <= c.book.top, "book.participation": 0 < c.book.participation <= 1,
        "book.max_industry": 0 < c.book.max_industry <= 1, "mad_n": c.mad_n > 0,
    }.items():
        if not ok:
            problems.append(name)
    if problems:
        raise ValueError(f"values out of range: {', '.join(problems)}")
    return c


def config_sha256(c: Config) -> str:
    return fingerprint(asdict(c))


def validate_research_protocol(p: dict) -> dict:
    """The protocol with its fingerprint; open fields or a holdout inside the sample raise."""
    missing = [k for k in ("protocol_id", "sample_start", "sample_end", "final_holdout_start", "primary_metric", "frozen_on") if not p.get(k)]
    if missing:
        raise ValueError(f"protocol lacks {missing}")
    if date.fromisoformat(str(p["final_holdout_start"])) <= date.fromisoformat(str(p["sample_end"])):
        raise ValueError("the holdout starts within the sample")
    return p | {"sha256": fingerprint(p)}


def validate_sources(registry: list[dict], tables: list[str]) -> list[str]:
    """Problems of a source registry: unsigned, unlicensed or missing tables."""
    by = {r.get("table"): r for r in registry}
    out = [f"missing:{t}" for t in tables if t not in by]
    for t, r in by.items():
        out += [f"{k}:{t}" for k in ("source_id", "license", "approved_by", "approved_on") if not r.get(k)]
    return sorted(out)


def data_manifest(tables: dict[str, DataFrame]) -> dict:
    parts = {n: {"rows": df.count(), "sha256": content_hash(df), "columns": sorted(df.columns)} for n, df in sorted(tables.items())}
    return {"tables": parts, "data_version": fingerprint(parts)}


def verify_manifest(manifest: dict, tables: dict[str, DataFrame]) -> list[str]:
    """Tables that differ from their manifest."""
    now = data_manifest(tables)
    names = sorted({*manifest["tables"], *now["tables"]})
    return [n for n in names if manifest["tables"].get(n) != now["tables"].get(n)]


def history_gate(df: DataFrame, least_dates: int, date_column: str = "trade_date") -> None:
    n = df.select(F.count_distinct(date_column)).first()[0]
    if n < least_dates:
        raise ValueError(f"{n} dates of history; {least_dates} are needed")


def choose_benchmark(bench: DataFrame, code: str | None) -> DataFrame:
    """The named index, or the only one there is."""
    codes = [r[0] for r in bench.select("index_code").distinct().limit(2).collect()]
    if code is None and len(codes) != 1:
        raise ValueError("name a benchmark: there are several")
    return bench.where(F.col("index_code") == (code or codes[0]))


def check_handoff(frame: DataFrame, key: str = "date") -> DataFrame:
    """A series without NULL and without repeated dates, or an error."""
    if frame.where(" or ".join(f"{c} is null" for c in frame.columns)).limit(1).count() or duplicate_keys(frame, [key]).limit(1).count():
        raise ValueError("hand-off frame with open values or repeated dates")
    return frame


def evidence(claims: dict[str, list[str]], folder: str) -> dict:
    """Claims with the files that back them and whether those are there."""
    root = Path(folder)
    out = {c: {"files": {f: (root / f).is_file() for f in files}} for c, files in claims.items()}
    for c in out.values():
        c["supported"] = bool(c["files"]) and all(c["files"].values())
    return out


def run_metadata(run_id: str, config: Config, manifest: dict | None = None, code_dir: str | None = None) -> dict:
    tree = hashlib.sha256()
    for p in sorted(Path(code_dir).rglob("*.py")) if code_dir else []:
        tree.update(p.read_bytes())
    return {"run_id": run_id, "created": datetime.now(UTC).isoformat(), "config_sha256": config_sha256(config), "data_version": (manifest or {}).get("data_version"), "code_sha256": tree.hexdigest() if code_dir else None}


def issues_report(issues: list[dict]) -> dict:
    """Counts by severity; any blocking issue blocks."""
    counts: dict[str, int] = {}
    for i in issues:
        counts[i["severity"]] = counts.get(i["severity"], 0) + 1
    return {"counts": counts, "blocked": counts.get("blocking", 0) > 0, "markdown": "\n".join(f"- **{i['severity']}** {i['table']}: {i['message']}" for i in issues), "json": json.dumps(issues, sort_keys=True)}
