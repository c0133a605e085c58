"""A bounded probe of a supplier's interface before any real acquisition: a scope that can't grow, a manifest first, nothing secret kept.

A dry run writes what would be asked and stops. A real one needs the user's word
that the use is licensed and a token; it sends one request through a callable,
keeps sizes, hashes and names of the answer and never the answer itself. Every
way out writes the manifest; the exit code is 0 only if the probe passed, else 2.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

#: The most that a probe may ask for, and the largest answer that is read.
CODES, DAYS, INDICATORS, MOST_BYTES = 2, (2, 3), (1, 3), 2 << 20
SUFFIXES = (".SH", ".SZ")
REDACTED, MOST_TEXT = "<redacted>", 500


class ProbeError(ValueError):
    """A scope that is too wide, or an answer that breaks the rules."""


@dataclass(frozen=True)
class Scope:
    endpoint: str
    codes: tuple[str, ...]
    indicators: tuple[str, ...]
    start: dt.date
    end: dt.date
    parameters: dict[str, str] = field(default_factory=dict)

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    def problems(self, endpoint: str, offered: frozenset[str]) -> list[str]:
        """Why the scope is not that of a probe of this endpoint with these indicators."""
        checks = {
            f"the endpoint is not {endpoint}": self.endpoint == endpoint and endpoint.startswith("https://"),
            f"{len(self.codes)} securities, not {CODES}": len(set(self.codes)) == len(self.codes) == CODES,
            f"{self.days} days, not {DAYS[0]} to {DAYS[1]}": DAYS[0] <= self.days <= DAYS[1],
            f"{len(self.indicators)} indicators, not {INDICATORS[0]} to {INDICATORS[1]}": INDICATORS[0] <= len(self.indicators) <= INDICATORS[1],
            f"indicators that are not offered: {sorted(set(self.indicators) - offered)}": set(self.indicators) <= offered,
            f"securities beyond {', '.join(SUFFIXES)}": all(c.endswith(SUFFIXES) for c in self.codes),
        }
        return [why for why, fine in checks.items() if not fine]

    def request(self) -> dict:
        return {"codes": ",".join(self.codes), "indicators": ",".join(self.indicators), "start": self.start.isoformat(), "end": self.end.isoformat(), "parameters": dict(sorted(self.parameters.items()))}


def read_scope(path: str) -> Scope:
    p = json.loads(Path(path).read_text(encoding="utf-8"))["probe"]
    day = dt.date.fromisoformat
    return Scope(str(p["endpoint"]), tuple(map(str, p["codes"])), tuple(map(str, p["indicators"])), day(p["start_date"]), day(p["end_date"]), {str(k): str(v) for k, v in p.get("parameters", {}).items()})


def redacted(value: object, secrets: tuple[str, ...]) -> str:
    text = str(value)
    for s in filter(None, secrets):
        text = text.replace(s, REDACTED)
    return text[:MOST_TEXT]


def answered(send: Callable[[str, bytes, str, int], tuple[int, bytes]], scope: Scope, token: str) -> dict:
    """What the answer to the one request was like. send(endpoint, body, token, most bytes) -> status, bytes (one more than the most, if there are more)."""
    began = time.perf_counter()
    status, raw = send(scope.endpoint, json.dumps(scope.request(), ensure_ascii=False).encode(), token, MOST_BYTES)
    taken = round((time.perf_counter() - began) * 1000, 3)
    if len(raw) > MOST_BYTES:
        raise ProbeError(f"the answer is larger than {MOST_BYTES} bytes")
    try:
        body = json.loads(raw.decode("utf-8"))
    except ValueError as e:
        raise ProbeError("the answer is not JSON") from e
    fields = {str(k).lower(): v for k, v in body.items()} if isinstance(body, dict) else {}
    code, message = fields.get("errorcode", fields.get("error_code")), fields.get("errmsg", fields.get("message"))
    return {
        "status": "success" if status == 200 and str(code) in ("0", "0.0") else "remote_error", "http_status": status, "latency_ms": taken, "bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest(), "keys": sorted(fields),
        "error_code": code, "error_message": None if message is None else redacted(message, (token,)), "raw_kept": False,
    }


def probe(scope: Scope, out: str, *, endpoint: str, offered: frozenset[str], send: Callable | None = None, token: str = "", execute: bool = False, licensed: bool = False) -> int:
    """Writes the manifest to out and returns the exit code; a scope that is too wide raises before anything is written."""
    if why := scope.problems(endpoint, offered):
        raise ProbeError("; ".join(why))
    request = json.dumps(scope.request(), sort_keys=True, ensure_ascii=False)
    manifest = {
        "schema_version": 1, "created_at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"), "scope": scope.request() | {"endpoint": scope.endpoint, "days": scope.days}, "request_sha256": hashlib.sha256(request.encode()).hexdigest(),
        "token_configured": bool(token), "licence_acknowledged": licensed, "dry_run": True, "request_sent": False, "response": None, "status": "ready_not_executed" if token else "blocked_missing_token",
    }
    try:
        if not execute:
            return 2
        if not licensed:
            manifest["status"] = "blocked_licence_not_acknowledged"
            return 2
        if not token or send is None:
            return 2
        manifest |= {"dry_run": False, "request_sent": True}
        try:
            manifest["response"] = answered(send, scope, token)
        except (OSError, ProbeError) as e:
            manifest |= {"status": "blocked_probe_failure", "response": {"status": type(e).__name__, "message": redacted(e, (token,))}}
            return 2
        passed = manifest["response"]["status"] == "success"
        manifest["status"] = "passed" if passed else "blocked_remote_error"
        return 0 if passed else 2
    finally:
        at = Path(out)
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(json.dumps(manifest, ensure_ascii=False, indent=1) + "\n", encoding="utf-8")
