"""The repository's own checks in order: everything compiles, tests pass, the command line runs over fresh sample data."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def steps(tests: bool = True, root: Path = ROOT) -> list[tuple[str, list[str]]]:
    """(name, command) of each step; {work} stands for a folder that is made for the run."""
    command = [sys.executable, "-m", "panelspark.cli"]
    out = [("compile", [sys.executable, "-m", "compileall", "-q", "panelspark", "tests"])]
    if tests:
        out.append(("tests", [sys.executable, "-m", "pytest", "-q", "-x", "tests"]))
    return [*out, ("cli-sample", [*command, "generate-sample", "--out", "{work}/data"]), ("cli-check", [*command, "quality-check", "--data", "{work}/data"]), ("cli-manifest", [*command, "write-manifest", "--data", "{work}/data", "--manifest", "{work}/manifest.json"])]


def run(todo: list[tuple[str, list[str]]], root: Path = ROOT) -> list[dict]:
    """name, returncode and seconds of each step; the first that fails raises with its output's end, and no other is run."""
    env = os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, [str(root), os.environ.get("PYTHONPATH")]))}
    done = []
    with tempfile.TemporaryDirectory(prefix="panelspark-quality-") as work:
        for name, command in todo:
            began = time.monotonic()
            p = subprocess.run([x.replace("{work}", work) for x in command], cwd=root, env=env, capture_output=True, text=True, check=False)
            if p.returncode:
                raise RuntimeError(f"{name} failed with {p.returncode}: {(p.stdout + p.stderr)[-1500:]}")
            done.append({"name": name, "returncode": 0, "seconds": round(time.monotonic() - began, 1)})
    return done
