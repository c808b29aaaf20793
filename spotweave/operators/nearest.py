"""Nearest-centroid assignment for every cut in one plan.

A state profile is a sum of cluster sums, so its dot product with a spot is the sum
of the spot's dot products with those clusters. Spots meet the L cluster rows once;
each K only adds up at most L numbers per spot. The spots are shuffled once, by id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from spotweave.functions.scalars import clip01
from spotweave.session import spread

EPS = 1e-8
TOP_STATES = 4  # candidates the margin confidence looks at
DIGITS = 9  # scores are ranked after rounding; ties go to the lowest state


def cluster_dots(counts: DataFrame, obs: DataFrame, sums: DataFrame, n_clusters: int) -> DataFrame:
    """``(obs_id, dots ARRAY<STRUCT<c, d, e>>, nn, ln)``: dot products of each row with the
    cluster sums, raw (d) and log-normalised (e), and its squared norms.

    Products are combined on the map side before the shuffle, so at most L numbers
    per row and task move. Rows of ``obs`` without counts stay; every row lists every
    cluster, those it shares nothing with as zeros.
    """
    products = (
        counts.select("obs_id", "feature", "x", "lx")
        .join(sums, "feature")
        .groupBy("obs_id", "c")
        .agg(F.sum(F.col("x") * F.col("sx")).alias("d"), F.sum(F.col("lx") * F.col("slx")).alias("e"))
    )
    norms = counts.groupBy("obs_id").agg(
        F.sum(F.col("x") * F.col("x")).alias("d"), F.sum(F.col("lx") * F.col("lx")).alias("e")
    )
    rows = products.unionByName(norms.withColumn("c", F.lit(-1))).unionByName(
        obs.select("obs_id"), allowMissingColumns=True
    )
    zeros = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(0.0).alias("d"), F.lit(0.0).alias("e")) for c in range(n_clusters)])
    is_norm = F.col("c") == -1
    return (
        # Every row is about to meet every cut: more work than its bytes tell.
        spread(rows, "obs_id")
        .groupBy("obs_id")
        .agg(
            # Bounded by the number of clusters.
            F.collect_list(F.when(F.col("c") >= 0, F.struct("c", "d", "e"))).alias("dots"),
            F.sum(F.when(is_norm, F.col("d"))).alias("nn"),
            F.sum(F.when(is_norm, F.col("e"))).alias("ln"),
        )
        .select(
            "obs_id",
            F.concat("dots", zeros).alias("dots"),
            F.coalesce("nn", F.lit(0.0)).alias("nn"),
            F.coalesce("ln", F.lit(0.0)).alias("ln"),
        )
    )


def cut_weights(
    spark: SparkSession,
    labels: dict[int, np.ndarray],
    sizes: np.ndarray,
    gram: np.ndarray,
    gram_log: np.ndarray,
    eps: float = EPS,
) -> DataFrame:
    """``(k, c, state, w, mm, lmm)``: per cut, each cluster's state, 1 / (state size + eps)
    and the squared norms of the state's raw and log-normalised profile.

    L rows per K, made on the driver from L x L dot products."""
    rows = []
    for k, lab in labels.items():
        member = np.zeros((int(lab.max()) + 1, len(lab)))
        member[lab, np.arange(len(lab))] = 1.0
        weight = 1.0 / (member @ sizes + eps)
        raw, log = (
            np.maximum(np.einsum("sc,cd,sd->s", member, g, member), 0.0) * weight * weight
            for g in (gram, gram_log)
        )
        rows += [
            (int(k), c, int(s), float(weight[s]), float(raw[s]), float(log[s])) for c, s in enumerate(lab)
        ]
    return spark.createDataFrame(rows, "k int, c int, state int, w double, mm double, lmm double")


def state_scores(dots: DataFrame, weights: DataFrame) -> DataFrame:
    """``(k, obs_id, state, dot, ldot, nn, ln, mm, lmm, sim)`` for every spot, cut and state.

    ``dot`` and ``ldot`` are products with the state means; ``sim`` is the raw cosine
    whose norms carry ``EPS``. The grouping keeps the partitioning by ``obs_id``: no
    further shuffle.
    """
    # `weights` has L rows per K and was built on the driver from known sizes.
    rolled = (
        dots.select("obs_id", "nn", "ln", F.inline("dots"))
        .join(F.broadcast(weights), "c")
        .groupBy("k", "obs_id", "state")
        .agg(
            F.sum(F.col("d") * F.col("w")).alias("dot"),
            F.sum(F.col("e") * F.col("w")).alias("ldot"),
            *[F.first(c).alias(c) for c in ("nn", "ln", "mm", "lmm")],
        )
    )
    return rolled.withColumn(
        "sim", F.col("dot") / ((F.sqrt("nn") + EPS) * (F.sqrt("mm") + EPS))
    )


def margin_confidence(scores: DataFrame, keys: list[str], distance: str = "dist", n: int = TOP_STATES) -> DataFrame:
    """``1 - d1 / (mean(d2..dn) + eps)`` in [0, 1] from the n smallest distances; a
    single candidate has no rival and gets 1."""
    order = W.partitionBy(*keys).orderBy(distance)
    top = scores.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n)
    best = F.max(F.when(F.col("_rn") == 1, F.col(distance)))
    rest = F.avg(F.when(F.col("_rn") > 1, F.col(distance)))
    return top.groupBy(*keys).agg(
        F.when(rest.isNull(), F.lit(1.0)).otherwise(clip01(1.0 - best / (rest + EPS))).alias("confidence")
    )


def nearest_assignment(scores: DataFrame) -> DataFrame:
    """``(k, obs_id, state, sim, confidence, ...)``: best state, its margin, and the
    products and norms of the winning profile."""
    carried = ["state", "sim", "dot", "ldot", "nn", "ln", "mm", "lmm"]
    order = W.partitionBy("obs_id", "k").orderBy(F.round("sim", DIGITS).desc(), "state")
    top = (
        scores.select("k", "obs_id", *carried)
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= TOP_STATES)
    )
    first = F.col("_rn") == 1
    best = F.max(F.when(first, 1.0 - F.col("sim")))
    rest = F.avg(F.when(~first, 1.0 - F.col("sim")))
    return top.groupBy("obs_id", "k").agg(
        F.max(F.when(first, F.struct(*carried))).alias("_b"),
        F.when(rest.isNull(), F.lit(1.0)).otherwise(clip01(1.0 - best / (rest + EPS))).alias("confidence"),
    ).select("k", "obs_id", "_b.*", "confidence")


def one_hot(assigned: DataFrame) -> DataFrame:
    """Sparse one-hot mapping: one row with p = 1 per spot and cut."""
    return assigned.select("k", "obs_id", "state", F.lit(1.0).alias("p"))


def hard_labels(mapping: DataFrame) -> DataFrame:
    """``(k, obs_id, state)``: state of the largest p, the lowest one on a tie.

    A spot whose mass is 0 everywhere has state 0, as an arg-max over zeros has.
    """
    best = mapping.groupBy("k", "obs_id").agg(
        F.max_by("state", F.struct(F.col("p"), -F.col("state"))).alias("state"), F.max("p").alias("_p")
    )
    return best.select("k", "obs_id", F.when(F.col("_p") > 0, F.col("state")).otherwise(F.lit(0)).cast("int").alias("state"))
