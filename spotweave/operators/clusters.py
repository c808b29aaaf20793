"""Start clusters of the reference rows and their group-by aggregates.

Sums per start cluster are computed once; everything at a coarser cut is a roll-up
of those L rows, never a second pass over the matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

EPS = 1e-8  # guards divisions by a group size
ZERO_CENTROID = 1e-6  # value of every feature of a raw centroid that is all zero


def drop_unlabelled(obs: DataFrame, label: str) -> DataFrame:
    """Rows with a label; a missing column is an error, not an empty result."""
    if label not in obs.columns:
        raise KeyError(f"no column {label!r}; available: {sorted(obs.columns)}")
    return obs.where(F.col(label).isNotNull())


def label_codes(obs: DataFrame, label: str) -> DataFrame:
    """``(label, c)``: codes 0.. in sorted label order.

    The window sees the distinct labels only, the same L rows the tree needs.
    """
    distinct = drop_unlabelled(obs, label).select(F.col(label).cast("string").alias("label")).distinct()
    return distinct.withColumn("c", (F.row_number().over(W.orderBy("label")) - 1).cast("int"))


def start_clusters_from_labels(obs: DataFrame, label: str) -> DataFrame:
    """``(obs_id, c, name)`` with the label column as the starting partition."""
    codes = label_codes(obs, label)
    rows = drop_unlabelled(obs, label).select("obs_id", F.col(label).cast("string").alias("label"))
    return rows.join(codes, "label").select("obs_id", "c", F.col("label").alias("name"))


def cluster_sizes(start: DataFrame) -> DataFrame:
    """``(c, n)``; counts every row of a cluster, also those without any count."""
    return start.groupBy("c").agg(F.count(F.lit(1)).alias("n"))


def cluster_sums(counts: DataFrame, start: DataFrame, values: dict[str, str] | None = None) -> DataFrame:
    """``(c, feature, sx, ...)``: sums of the value columns per start cluster."""
    values = values or {"x": "sx"}
    aggs = [F.sum(v).alias(out) for v, out in values.items()]
    return counts.join(start.select("obs_id", "c"), "obs_id").groupBy("c", "feature").agg(*aggs)


def cluster_centroids(
    sums: DataFrame, sizes: DataFrame, features: DataFrame, eps: float = EPS
) -> DataFrame:
    """``(c, feature, sx, slx, m, ml)`` raw and log-normalised means per cluster.

    A cluster without any count gets ``ZERO_CENTROID`` in every raw feature, so that
    its profile is defined; its log-normalised mean stays 0.
    """
    totals = sums.groupBy("c").agg(F.sum("sx").alias("_t"))
    empty = (
        sizes.join(totals, "c", "left")
        .where(F.coalesce("_t", F.lit(0.0)) == 0)
        .select("c", "n")
        # One array of the feature names, exploded per empty cluster.
        .withColumn(
            "feature",
            F.explode(features.agg(F.array_sort(F.collect_set("feature"))).scalar()),
        )
        .select(
            "c",
            "feature",
            F.lit(0.0).alias("sx"),
            F.lit(0.0).alias("slx"),
            F.lit(ZERO_CENTROID).alias("m"),
            F.lit(0.0).alias("ml"),
        )
    )
    filled = (
        sums.join(totals.where("_t <> 0"), "c", "left_semi")
        .join(sizes, "c")
        .select(
            "c",
            "feature",
            "sx",
            "slx",
            (F.col("sx") / (F.col("n") + eps)).alias("m"),
            (F.col("slx") / (F.col("n") + eps)).alias("ml"),
        )
    )
    return filled.unionByName(empty)


def state_profiles(sums: DataFrame, sizes: DataFrame, cut: DataFrame, eps: float = EPS) -> DataFrame:
    """``(k, state, feature, m, ml)`` for every cut at once: size-weighted means of the
    raw and the log-normalised sums.

    Final aggregation of the cluster partials; the matrix itself is not read.
    """
    weights = sizes.join(cut, "c").groupBy("k", "state").agg(F.sum("n").alias("n"))
    pooled = (
        sums.join(cut, "c")
        .groupBy("k", "state", "feature")
        .agg(F.sum("sx").alias("sx"), F.sum("slx").alias("slx"))
    )
    return pooled.join(weights, ["k", "state"]).select(
        "k",
        "state",
        "feature",
        (F.col("sx") / (F.col("n") + eps)).alias("m"),
        (F.col("slx") / (F.col("n") + eps)).alias("ml"),
    )


def modulo_cut(sizes: DataFrame) -> DataFrame:
    """``(k, c, state)`` with state = c mod k for k = 1..L: cuts given by a rule, for
    tables whose tree is not of interest."""
    top = sizes.agg(F.max("c").alias("c"))
    return (
        top.select("c", F.explode(F.sequence(F.lit(1), F.col("c") + 1)).alias("k"))
        .select("k", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("c"))
        .select("k", "c", F.pmod("c", "k").cast("int").alias("state"))
    )


def state_members(cut: DataFrame) -> DataFrame:
    """``(k, state, members)``: the start clusters merged into each state."""
    return cut.groupBy("k", "state").agg(F.array_sort(F.collect_list("c")).alias("members"))


def merge_map(start: DataFrame, cut: DataFrame) -> DataFrame:
    """``(k, state, c, n)``: which clusters make up a state, with their sizes."""
    return cluster_sizes(start).join(cut, "c").select("k", "state", "c", "n")


def state_fractions(assigned: DataFrame, domain: DataFrame) -> DataFrame:
    """``(k, state, n, fraction)`` over all states of each k, empty ones included."""
    counted = assigned.groupBy("k", "state").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("k").agg(F.sum("n").alias("total"))
    return (
        domain.select("k", "state")
        .join(counted, ["k", "state"], "left")
        .join(totals, "k", "left")
        .select(
            "k",
            "state",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.col("total")), F.lit(0.0)).alias(
                "fraction"
            ),
        )
    )


def state_domain(cut: DataFrame) -> DataFrame:
    """``(k, state)`` for state 0..k-1 of every cut."""
    return cut.select("k").distinct().select(
        "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("state")
    )


def profile_zscores(profiles: DataFrame, states: DataFrame) -> DataFrame:
    """``(k, state, feature, m, z, variance)``: profiles as z-scores over the states.

    A state without a value for a feature counts as 0 in mean and deviation.
    Population statistics; a constant feature gets z = 0.
    """
    per_k = states.groupBy("k").agg(F.count(F.lit(1)).alias("_k"))
    stats = (
        profiles.groupBy("k", "feature")
        .agg(F.sum("m").alias("_s"), F.collect_list("m").alias("_ms"))
        .join(per_k, "k")
        .withColumn("_mean", F.col("_s") / F.col("_k"))
        # Two-pass variance over at most k values: a difference of squares would
        # turn a constant feature into noise.
        .withColumn(
            "variance",
            (
                F.aggregate("_ms", F.lit(0.0), lambda a, m: a + (m - F.col("_mean")) * (m - F.col("_mean")))
                + (F.col("_k") - F.size("_ms")) * F.col("_mean") * F.col("_mean")
            )
            / F.col("_k"),
        )
    )
    full = (
        stats.select("k", "feature", "_mean", "variance")
        .join(states, "k")
        .join(profiles, ["k", "state", "feature"], "left")
        .withColumn("m", F.coalesce("m", F.lit(0.0)))
    )
    sd = F.sqrt("variance")
    return full.select(
        "k",
        "state",
        "feature",
        "m",
        F.when(sd > 0, F.try_divide(F.col("m") - F.col("_mean"), sd)).otherwise(F.lit(0.0)).alias("z"),
        "variance",
    )
