"""Row normalisations of a long count matrix.

All of them are windows over ``obs_id``: a matrix row holds at most one value per
feature, so such a window is bounded by the feature count, and several of them on
one input share a single shuffle (none on a table bucketed by ``obs_id``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotweave.functions.scalars import col

TARGET_SUM = 1e4  # total of a row after normalisation
L2_EPS = 1e-8
FREQUENCY_EPS = 1e-8


def _row_sum(expr: Column) -> Column:
    return F.sum(expr).over(W.partitionBy("obs_id"))


def lognorm(counts: DataFrame, out: str = "lx", target: float = TARGET_SUM) -> DataFrame:
    """Adds ``ln(1 + target * x / row total)``; a row whose total is 0 stays 0."""
    total = _row_sum(F.col("x"))
    return counts.withColumn(
        out, F.when(total > 0, F.log1p(F.try_divide(target * F.col("x"), total))).otherwise(F.lit(0.0))
    )


def restrict_features(counts: DataFrame, features: DataFrame) -> DataFrame:
    """Keeps the listed features. Written as a semi join: the list never widens rows."""
    return counts.join(features.select("feature"), "feature", "left_semi")


def lognorm_shared(counts: DataFrame, shared: DataFrame, out: str = "lx") -> DataFrame:
    """``lognorm`` whose row totals come from the shared features alone."""
    return lognorm(restrict_features(counts, shared).select("obs_id", "feature", "x"), out)


def unit_rows(counts: DataFrame, out: str = "u", eps: float = L2_EPS) -> DataFrame:
    """Adds ``x / (row L2 norm + eps)``."""
    return counts.withColumn(out, F.col("x") / (F.sqrt(_row_sum(F.col("x") * F.col("x"))) + eps))


def relative_frequency(
    profiles: DataFrame, key: str, value: str, out: str = "f", eps: float = FREQUENCY_EPS
) -> DataFrame:
    """Adds ``value / (row total + eps)`` for rows keyed by ``key``."""
    return profiles.withColumn(
        out, col(value) / (F.sum(value).over(W.partitionBy(key)) + F.lit(eps))
    )
