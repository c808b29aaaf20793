"""Bringing a mapping onto a fixed domain of rows and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def reindex_fill(mapping: DataFrame, rows: DataFrame, k: int, fill: float = 0.0) -> DataFrame:
    """``(obs_id, state, p)`` for all rows and states 0..k-1; absent cells get ``fill``.

    Rows and states outside the domain are dropped; values are not rescaled.
    """
    states = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("state")
    domain = rows.select("obs_id", states)
    return domain.join(mapping.select("obs_id", "state", "p"), ["obs_id", "state"], "left").na.fill(fill, ["p"])
