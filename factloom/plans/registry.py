"""Queries of the library's own operators, by registered name, with their SQL."""

from __future__ import annotations

from . import run_queries  # noqa: F401
from .queries import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "risk_score"
