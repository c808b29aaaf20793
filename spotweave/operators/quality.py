"""One-hotness, confidence and distribution summaries of a mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotweave.functions.indexing import exact_quantiles
from spotweave.functions.scalars import clip01, fraction_true

LOG_EPS = 1e-12


def entropy_confidence(mapping: DataFrame) -> DataFrame:
    """``(k, obs_id, confidence)``: ``1 + sum p ln(p + eps) / ln k`` in [0, 1]; 1 for k = 1."""
    h = F.sum(F.col("p") * F.log(F.col("p") + LOG_EPS))
    return mapping.groupBy("obs_id", "k").agg(h.alias("_h")).select(
        "k",
        "obs_id",
        F.when(F.col("k") == 1, F.lit(1.0))
        .otherwise(clip01(1.0 + F.try_divide(F.col("_h"), F.log("k"))))
        .alias("confidence"),
    )


def onehot_per_row(mapping: DataFrame) -> DataFrame:
    """``(k, obs_id, max_prob, gini_impurity, entropy)`` of each normalised row.

    Negative values count as 0 and a row sums to 1 unless it is all zero. Both
    impurities are scaled by their maximum over k states, not over the non-zero
    ones; for k = 1 they are 0.
    """
    p = F.greatest(F.col("p"), F.lit(0.0))
    total = mapping.groupBy("obs_id", "k").agg(
        F.sum(p).alias("_t"),
        F.max(p).alias("_m"),
        F.sum(p * p).alias("_q"),
        F.sum(F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))).alias("_pl"),
    )
    # With q = p / t: sum q^2 = sum p^2 / t^2 and sum q ln q = sum p ln p / t - ln t.
    t = F.when(F.col("_t") > 0, F.col("_t")).otherwise(F.lit(1.0))
    plogp = F.when(F.col("_t") > 0, F.col("_pl") / t - F.log(t)).otherwise(F.lit(0.0))
    many = F.col("k") > 1
    return total.select(
        "k",
        "obs_id",
        (F.col("_m") / t).alias("max_prob"),
        F.when(
            many, F.try_divide(1.0 - F.col("_q") / (t * t), 1.0 - F.try_divide(F.lit(1.0), F.col("k")))
        ).otherwise(F.lit(0.0)).alias("gini_impurity"),
        F.when(many, F.try_divide(-plogp, F.log("k"))).otherwise(F.lit(0.0)).alias("entropy"),
    )


def onehot_summary(rows: DataFrame) -> DataFrame:
    """Per k: count, states, mean / median / population deviation of the three
    measures, and the shares of rows whose largest p is above 0.5, 0.9, 0.99."""
    measures = ["max_prob", "gini_impurity", "entropy"]
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for m in measures:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    for bound, name in ((0.5, "50"), (0.9, "90"), (0.99, "99")):
        aggs.append(fraction_true(F.col("max_prob") > bound).alias(f"frac_above_{name}"))
    out = rows.groupBy("k").agg(*aggs).withColumn("n_cols", F.col("k"))
    # One pass for the three medians: the measure is part of the key.
    long = rows.select(
        "k",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in measures])
        ).alias("e"),
    ).select("k", "e.measure", "e.v")
    medians = (
        exact_quantiles(long, ["k", "measure"], "v", [0.5])
        .groupBy("k")
        .pivot("measure", measures)
        .agg(F.first("q_0"))
    )
    for m in measures:
        medians = medians.withColumnRenamed(m, f"{m}_median")
    return out.join(medians, "k")


def confidence_summary(assigned: DataFrame) -> DataFrame:
    """Per k: count, mean, median, min, max, population deviation, and the shares at
    or above 0.5 and 0.9."""
    c = F.col("confidence")
    out = assigned.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(c).alias("mean"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.stddev_pop(c).alias("std"),
        fraction_true(c >= 0.5).alias("frac_at_least_50"),
        fraction_true(c >= 0.9).alias("frac_at_least_90"),
    )
    return out.join(exact_quantiles(assigned, ["k"], "confidence", [0.5]).withColumnRenamed("q_0", "median"), "k")


def unit_histogram(rows: DataFrame, keys: list[str], value: str, bins: int = 40) -> DataFrame:
    """``(keys, bin, n)``: counts in equal bins of [0, 1], the value 1 in the last one."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def auto_histogram(rows: DataFrame, keys: list[str], value: str, most: int = 40) -> DataFrame:
    """``(keys, low, width, n)``: counts in bins of the least width of 1, 2 or 5 times a power of ten
    that takes at most ``most`` bins over the group's range. A group of one value has bins of 0.01.
    NULLs are left out."""
    known = rows.where(F.col(value).isNotNull())
    ends = known.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("_r"))
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.col("_r") / most)))
    step = F.round(F.col("_r") / most / unit, 9)
    wide = F.when(step <= 1, 1.0).when(step <= 2, 2.0).when(step <= 5, 5.0).otherwise(10.0) * unit
    width = F.when(F.col("_r") < 1e-9, F.lit(0.01)).otherwise(wide)
    # One row per group.
    sized = known.join(F.broadcast(ends.select(*keys, F.round(width, 12).alias("width"))), keys)
    at = F.floor(F.round(F.col(value) / F.col("width"), 9))
    return sized.groupBy(*keys, "width", at.alias("_at")).agg(F.count(F.lit(1)).alias("n")).select(*keys, (F.col("_at") * F.col("width")).alias("low"), "width", "n")


def box_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, n, q1, median, q3, low, high)`` for a box plot."""
    spread = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    quart = exact_quantiles(rows, keys, value, [0.25, 0.5, 0.75])
    return spread.join(quart, keys).select(
        *keys,
        "n",
        F.col("q_0").alias("q1"),
        F.col("q_1").alias("median"),
        F.col("q_2").alias("q3"),
        "low",
        "high",
    )


def below_threshold(assigned: DataFrame, threshold: float) -> DataFrame:
    """Marks rows whose confidence is under a threshold; 0 or less marks none."""
    flag = (F.col("confidence") < threshold) if threshold > 0 else F.lit(False)
    return assigned.withColumn("below", F.coalesce(flag, F.lit(False)))


def metric_by_mapper(metrics: DataFrame, mappers: list[str]) -> DataFrame:
    """Pivot: one row per metric, one column per mapper."""
    return metrics.groupBy("metric").pivot("mapper", mappers).agg(F.first("value"))
