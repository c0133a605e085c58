"""All registered queries of the library."""

from __future__ import annotations

from . import model_queries, more_queries, oracles, panel_queries, research_queries, stage_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
