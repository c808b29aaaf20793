"""All registered queries."""

from __future__ import annotations

from spotweave.plans import queries_core, queries_data, queries_neighbours  # noqa: F401
from spotweave.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
