"""The given tables as one matrix pair, with the pieces most queries share."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spotweave.operators import allcuts, clusters, features, knn, nearest, normalize, tree
from spotweave.session import broadcast_if_small, cut_lineage
from spotweave.sources import tables


def r6(value) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


class TablePair:
    """Customers against suppliers (see sources/tables.py), built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir

    @cached_property
    def sc(self) -> DataFrame:
        return tables.customer_counts(self.spark, self.sf)

    @cached_property
    def st(self) -> DataFrame:
        return tables.supplier_counts(self.spark, self.sf)

    @cached_property
    def sc_obs(self) -> DataFrame:
        return tables.customer_rows(self.spark, self.sf)

    @cached_property
    def st_obs(self) -> DataFrame:
        return tables.supplier_rows(self.spark, self.sf)

    @cached_property
    def shared(self) -> DataFrame:
        # A dimension of a few thousand names at most, used by many steps.
        return features.shared_features(self.sc, self.st).persist()

    @cached_property
    def sc_shared(self) -> DataFrame:
        return normalize.lognorm_shared(self.sc, self.shared)

    @cached_property
    def st_shared(self) -> DataFrame:
        return normalize.lognorm_shared(self.st, self.shared)

    @cached_property
    def start(self) -> DataFrame:
        return clusters.start_clusters_from_labels(self.sc_obs, "label")

    @cached_property
    def sizes(self) -> DataFrame:
        return clusters.cluster_sizes(self.start).persist()

    @cached_property
    def sums(self) -> DataFrame:
        # L x G partial aggregates: every cut rolls them up again.
        return clusters.cluster_sums(self.sc_shared, self.start, {"x": "sx", "lx": "slx"}).persist()

    @cached_property
    def centroids(self) -> DataFrame:
        return clusters.cluster_centroids(self.sums, self.sizes, self.shared)

    @cached_property
    def size_vector(self) -> np.ndarray:
        rows = self.sizes.collect()
        out = np.zeros(max(r["c"] for r in rows) + 1)
        for r in rows:
            out[r["c"]] = r["n"]
        return out

    @cached_property
    def n_clusters(self) -> int:
        return len(self.size_vector)

    @cached_property
    def rule_labels(self) -> dict[int, np.ndarray]:
        """The same as ``rule_cut``, on the driver."""
        c = np.arange(self.n_clusters)
        return {k: c % k for k in range(1, self.n_clusters + 1)}

    @cached_property
    def rule_cut(self) -> DataFrame:
        return clusters.modulo_cut(self.sizes)

    @cached_property
    def dots(self) -> DataFrame:
        sums = broadcast_if_small(self.sums)
        return nearest.cluster_dots(self.st_shared, self.st_obs, sums, self.n_clusters)

    def scores(self, labels: dict[int, np.ndarray]) -> DataFrame:
        grams = tree.cluster_grams(self.sums, self.n_clusters, ["sx", "slx"])
        weights = nearest.cut_weights(self.spark, labels, self.size_vector, *grams)
        return nearest.state_scores(self.dots, weights)

    def kernel(self, labels: dict[int, np.ndarray]) -> allcuts.Kernel | None:
        return allcuts.build_kernel(self.sums, self.shared, labels, self.size_vector)

    @cached_property
    def rule_kernel(self) -> allcuts.Kernel | None:
        return self.kernel(self.rule_labels)

    @cached_property
    def spot_rows(self) -> DataFrame:
        return allcuts.spot_rows(self.st_shared, self.st_obs)

    def assigned(self, labels: dict[int, np.ndarray], kernel: allcuts.Kernel | None) -> DataFrame:
        """Nearest centroid at every cut: in one pass if the kernel fits into a task."""
        if kernel is None:
            return nearest.nearest_assignment(self.scores(labels))
        return allcuts.assign(self.spot_rows, kernel)

    @cached_property
    def rule_assignment(self) -> DataFrame:
        """Nearest centroid at every rule cut: one narrow row per spot and cut, written because
        the metrics read it several times."""
        return cut_lineage(self.assigned(self.rule_labels, self.rule_kernel))

    @cached_property
    def tree_labels(self) -> tree.TreeCuts:
        """Cuts of the tree over the nation profiles (average linkage)."""
        merges = tree.link(tree.profile_distances(self.centroids, self.n_clusters))
        return tree.cuts(merges, tree.k_range(self.n_clusters), self.n_clusters)

    def profiles(self, cut: DataFrame) -> DataFrame:
        return clusters.state_profiles(self.sums, self.sizes, cut)

    def feature_names(self) -> list[str]:
        return [r["feature"] for r in self.shared.orderBy("feature").collect()]

    def vectors(self) -> tuple[DataFrame, DataFrame]:
        names = self.feature_names()
        return (
            knn.dense_vectors(self.st_shared, self.st_obs, names),
            knn.dense_vectors(self.sc_shared, self.sc_obs, names),
        )
