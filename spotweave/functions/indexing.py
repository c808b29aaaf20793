"""Dense row numbers and exact quantiles without a one-task global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from spotweave.session import cut_lineage

# Number of hash buckets of dense_index: a fixed size, so the offsets table is too.
INDEX_BUCKETS = 1024
# percentile_approx guarantees a rank error of n / ACCURACY; it only brackets the
# exact answer, so this trades bracket width against sketch size.
ACCURACY = 10_000


def dense_index(df: DataFrame, key: str, out: str = "i", buckets: int = INDEX_BUCKETS) -> DataFrame:
    """Adds a bijective 0..n-1 index of the distinct keys of ``df``.

    Keys are numbered inside hash buckets and shifted by the bucket's offset. The
    order carries no meaning; only the bijection does.
    """
    spread = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    # At most ``buckets`` rows reach this running sum.
    offsets = (
        spread.groupBy("_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_off",
            F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)),
        )
        .select("_b", F.coalesce("_off", F.lit(0)).alias("_off"))
    )
    numbered = spread.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(key)))
    return (
        numbered.join(offsets, "_b")
        .withColumn(out, (F.col("_off") + F.col("_r") - 1).cast("bigint"))
        .drop("_b", "_r", "_off")
    )


def ordered_index(df: DataFrame, order: Sequence[str], out: str = "i", parts: int | None = None) -> DataFrame:
    """Adds 0..n-1 in the order of the ``order`` columns (ties share no promise).

    Rows move once, into ranges of that order (``parts`` of them, by default as many as
    the session deals), and are numbered where they lie; one count per range does the rest.
    """
    ranges = df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    # Written, so that a repeated task cannot number its rows in another way.
    numbered = cut_lineage(ranges.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    # A row per range reaches this running sum.
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    shift = F.broadcast(counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    joined = numbered.withColumn("_part", part).join(shift, "_part")
    return joined.withColumn(out, (F.col("_before") + place).cast("bigint")).drop("_part", "_before", "_at")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """Exact interpolated quantiles per key, one column ``q_<i>`` per entry of ``qs``.

    Equal values are counted first, so a value held by a third of the rows is one
    row. A sketch with a guaranteed rank error then brackets each answer, and only
    the distinct values inside the brackets are ordered: about n / accuracy rows
    per key, never the whole group.
    """
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    margin = 4.0 / accuracy
    points = [p for q in qs for p in (max(0.0, q - margin), min(1.0, q + margin))]
    sketch = F.percentile_approx(
        F.col(value), F.array(*[F.lit(p) for p in points]), F.lit(accuracy)
    )
    brackets = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(
        sketch.alias("_s"),
        F.count(F.lit(1)).alias("_n"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
    )
    for i, q in enumerate(qs):
        # A rank near either end of a small group is bracketed by the extremes.
        low = F.col("_s")[2 * i] if q > margin else F.col("_min")
        high = F.col("_s")[2 * i + 1] if q < 1.0 - margin else F.col("_max")
        small = F.col("_n") <= accuracy
        brackets = brackets.withColumn(
            f"_lo{i}", F.when(small, F.col("_min")).otherwise(low)
        ).withColumn(f"_hi{i}", F.when(small, F.col("_max")).otherwise(high))
    joined = counted.join(brackets.drop("_s", "_min", "_max"), keys)
    v, w = F.col(value), F.col("_w")
    inside = F.lit(False)
    for i in range(len(qs)):
        inside = inside | v.between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
    # Rows below the brackets collapse into one counted row per key and gap, so the
    # running count stays exact while only bracket values are ordered.
    gap = F.lit(0)
    for i in range(len(qs)):
        gap = gap + (v > F.col(f"_hi{i}")).cast("int")
    passthrough = F.when(inside, v)
    packed = joined.groupBy(
        *keys, gap.alias("_gap"), passthrough.alias("_v")
    ).agg(F.sum(w).alias("_w"), F.min(v).alias("_first"), F.first("_n").alias("_n"))
    running = W.partitionBy(*keys).orderBy("_first").rowsBetween(W.unboundedPreceding, 0)
    ranked = packed.withColumn("_cum", F.sum("_w").over(running)).where("_v IS NOT NULL")
    outs = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        lower, upper = F.floor(pos), F.ceil(pos)
        holds = lambda r: (F.col("_cum") > r) & (F.col("_cum") - F.col("_w") <= r)
        lo = F.max(F.when(holds(lower), F.col("_v")))
        hi = F.max(F.when(holds(upper), F.col("_v")))
        frac = F.max(pos - lower)
        outs.append((lo + (hi - lo) * frac).alias(f"q_{i}"))
    return ranked.groupBy(*keys).agg(*outs)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5]).withColumnRenamed("q_0", out)
