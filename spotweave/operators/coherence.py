"""Coherence of the start clusters merged into a state, against random draws.

The only inputs are L x L cosines and the cuts. Each (cut, state) is an independent
test, so the tests are spread over tasks that hold the cosines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.operators import tree

NORM_EPS = 1e-12
Z_EPS = 1e-12
SHUFFLES = 200
ALPHA = 0.05
# The two reasons a state is not tested.
FEW = "fewer than 2 non-empty merged start clusters"
NO_OTHERS = "no start clusters in other states to draw a null from"


def centroid_cosines(gram: np.ndarray) -> np.ndarray:
    """Pairwise cosines from dot products; norms carry ``NORM_EPS``."""
    norm = np.sqrt(np.diag(gram)) + NORM_EPS
    return gram / norm[:, None] / norm[None, :]


def pairwise_cosines(centroids: DataFrame, n_clusters: int, value: str = "ml") -> DataFrame:
    """``(a, b, cos)`` for every pair a < b of cluster profiles (L * (L - 1) / 2 rows)."""

    def cosine(others: np.ndarray, one: np.ndarray) -> np.ndarray:
        norm = lambda v: np.sqrt((v * v).sum(-1)) + NORM_EPS
        return others @ one / norm(others) / norm(one)

    return tree.block_pairs(centroids.select("c", "feature", F.col(value).alias("v")), n_clusters, cosine, "cos")


def pair_statistics(pairs: DataFrame, cut: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(k, state, n, mean_cos, median_cos)`` over the pairs inside each state; a state
    with one cluster has (1, 1)."""
    inside = (
        pairs.join(cut.select("k", F.col("c").alias("a"), F.col("state").alias("s")), "a")
        .join(cut.select("k", F.col("c").alias("b"), F.col("state").alias("t")), ["k", "b"])
        .where(F.col("s") == F.col("t"))
        .groupBy("k", F.col("s").alias("state"))
        .agg(F.avg("cos").alias("mean_cos"), F.median("cos").alias("median_cos"))
    )
    members = sizes.join(cut, "c").groupBy("k", "state").agg(F.count(F.lit(1)).alias("n"))
    return members.join(inside, ["k", "state"], "left").select(
        "k",
        "state",
        "n",
        F.coalesce("mean_cos", F.lit(1.0)).alias("mean_cos"),
        F.coalesce("median_cos", F.lit(1.0)).alias("median_cos"),
    )


def _pairs(cosines: np.ndarray, members: np.ndarray) -> np.ndarray:
    block = cosines[np.ix_(members, members)]
    return block[np.triu_indices(len(members), k=1)]


def merge_coherence(
    spark: SparkSession,
    cosines: np.ndarray,
    non_empty: np.ndarray,
    labels: dict[int, np.ndarray],
    n_perm: int = SHUFFLES,
    seed: int = 0,
) -> DataFrame:
    """One row per (k, state): coherence of its merged clusters and its null.

    Draws take as many clusters from the other states, with replacement only when
    there are too few; the generator of a state is seeded with ``seed + state``.
    """
    shared = spark.sparkContext.broadcast((cosines, non_empty, labels))
    tasks = [(int(k), int(s)) for k, lab in labels.items() for s in sorted(set(lab.tolist()))]
    frame = spark.createDataFrame(tasks, "k int, state int")
    wanted = max(1, min(len(tasks), spark.sparkContext.defaultParallelism * 4))
    frame = frame.repartition(wanted, "k", "state")

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cos, alive, cuts = shared.value
        for pdf in batches:
            out = []
            for k, state in zip(pdf["k"], pdf["state"]):
                lab = cuts[int(k)]
                target = np.flatnonzero((lab == state) & alive)
                others = np.flatnonzero((lab != state) & alive)
                row = {"k": k, "state": state, "n_start_clusters_merged": len(target)}
                if len(target) < 2:
                    out.append({**row, "skipped_reason": FEW})
                    continue
                if not len(others):
                    out.append({**row, "skipped_reason": NO_OTHERS})
                    continue
                found = _pairs(cos, target)
                rng = np.random.default_rng(seed + int(state))
                size = len(target)
                drawn = np.zeros((n_perm, len(cos)))  # how often each draw holds each cluster
                for own in drawn:
                    np.add.at(own, rng.choice(others, size=size, replace=size > len(others)), 1.0)
                # All ordered pairs of a draw less those of a member with itself, all draws at once.
                null = ((drawn @ cos * drawn).sum(1) - drawn @ cos.diagonal()) / (size * (size - 1))
                out.append(
                    {
                        **row,
                        "mean_cossim": found.mean(),
                        "median_cossim": np.median(found),
                        "null_mean": null.mean(),
                        "p_value_mean": (null >= found.mean()).mean(),
                        "z_score_mean": (found.mean() - null.mean()) / (null.std() + Z_EPS),
                        "skipped_reason": None,
                    }
                )
            columns = [
                "k", "state", "n_start_clusters_merged", "mean_cossim", "median_cossim",
                "null_mean", "p_value_mean", "z_score_mean", "skipped_reason",
            ]
            yield pd.DataFrame(out, columns=columns)

    return frame.mapInPandas(
        test,
        "k int, state int, n_start_clusters_merged bigint, mean_cossim double, median_cossim double, "
        "null_mean double, p_value_mean double, z_score_mean double, skipped_reason string",
    )


def coherence_summary(tests: DataFrame) -> DataFrame:
    """Per k: tested states, mean cosine, mean z, share with p below ``ALPHA``."""
    tested = F.col("skipped_reason").isNull()
    return tests.groupBy("k").agg(
        F.count(F.when(tested, 1)).alias("n_tested_states"),
        F.avg(F.when(tested, F.col("mean_cossim"))).alias("mean_cossim"),
        F.avg(F.when(tested, F.col("z_score_mean"))).alias("mean_z_score"),
        F.avg(F.when(tested, (F.col("p_value_mean") < ALPHA).cast("double"))).alias("frac_significant"),
    )
