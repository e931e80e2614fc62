"""All registered queries of the factor engine."""

from __future__ import annotations

from . import characteristics, more, portfolio, regimes, relational, scores, valuation  # noqa: F401
from .registry import ORACLE, QUERIES, Query


def all_queries() -> dict[str, Query]:
    return QUERIES


def all_sql() -> dict[str, str]:
    return ORACLE
