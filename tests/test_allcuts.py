"""The one-pass kernel against the joins that take over beyond its size."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from spotweave.functions.indexing import ordered_index
from spotweave.operators import allcuts, nearest, reconstruct, spatial, tree
from spotweave.plans.base import TablePair


@pytest.fixture(scope="module")
def pair(spark):
    return TablePair(spark, SF)


def rows_of(df, keys, values):
    return {tuple(r[k] for k in keys): [r[v] for v in values] for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], abs=1e-9), key


@pytest.mark.parametrize("kind", ["rule", "tree"])
def test_assignment_equals_the_joins(pair, kind):
    labels = pair.rule_labels if kind == "rule" else pair.tree_labels
    kernel = pair.kernel(labels)
    if kind == "tree":
        assert len(kernel.weight) == 2 * pair.n_clusters - 1
    values = ["state", "sim", "dot", "ldot", "nn", "ln", "mm", "lmm", "confidence"]
    got = allcuts.assign(pair.spot_rows, kernel)
    want = nearest.nearest_assignment(pair.scores(labels))
    close(rows_of(got, ["k", "obs_id"], values), rows_of(want, ["k", "obs_id"], values))


def test_feature_sums_of_votes_equal_the_joins(pair):
    # A soft mapping: the nearest state with 0.7, state 0 with the rest.
    best = pair.rule_assignment.select("k", "obs_id", "state")
    soft = best.withColumn("p", F.lit(0.7)).unionByName(best.withColumn("state", F.lit(0)).withColumn("p", F.lit(0.3)))
    soft = soft.groupBy("k", "obs_id", "state").agg(F.sum("p").alias("p"))
    rows = allcuts.with_votes(pair.spot_rows, soft)
    keys = ["combo", "k", "feature"]
    got = reconstruct.summed_cosines(allcuts.mapped_features(rows, pair.rule_kernel), pair.st_shared, "soft")
    want = reconstruct.feature_cosines(pair.st_shared, soft, pair.profiles(pair.rule_cut), pair.shared, "soft")
    close(rows_of(got, keys, ["value"]), rows_of(want, keys, ["value"]))
    got = reconstruct.mapped_spot_cosines(allcuts.mapped_spots(rows, pair.rule_kernel), "soft")
    want = reconstruct.soft_spot_cosines(pair.scores(pair.rule_labels), soft, pair.profiles(pair.rule_cut))
    close(rows_of(got, ["combo", "k", "obs_id"], ["value"]), rows_of(want, ["combo", "k", "obs_id"], ["value"]))


def test_shuffles_equal_the_joins(pair, monkeypatch):
    counts = spatial.label_counts(pair.rule_assignment)
    index = ordered_index(pair.st_obs.select("obs_id"), ["obs_id"])
    want = reconstruct.null_medians(*spatial.shuffled_reconstruction(pair.st_shared, pair.scores(pair.rule_labels), pair.profiles(pair.rule_cut), counts, index, 3))
    rows = allcuts.spot_rows(pair.st_shared, index, "i")
    kernel = pair.rule_kernel
    # Several passes over the spots, one per draw.
    monkeypatch.setattr(allcuts, "KERNEL_NUMBERS", 4 * len(kernel.features) * len(counts))
    spot, sums = allcuts.shuffled(rows, kernel, counts, 3)
    gene = reconstruct.summed_cosines(sums, pair.st_shared, "hard").where("combo = 'hard-raw'")
    values = ["median_spot_null", "median_gene_null"]
    close(rows_of(reconstruct.null_medians(spot, gene), ["k"], values), rows_of(want, ["k"], values))


def test_no_kernel_beyond_its_size(pair, monkeypatch):
    monkeypatch.setattr(allcuts, "KERNEL_NUMBERS", 10)
    assert pair.kernel(pair.rule_labels) is None
    assert pair.assigned({1: np.zeros(pair.n_clusters, int)}, None).count() == pair.st_obs.count()


def test_spots_without_cells_and_ties(spark):
    sums = spark.createDataFrame([(0, "a", 2.0, 1.0), (1, "a", 2.0, 1.0), (2, "b", 3.0, 1.0)], "c int, feature string, sx double, slx double")
    features = spark.createDataFrame([("a",), ("b",)], "feature string")
    labels = {k: np.arange(3) % k for k in (1, 2, 3)}
    kernel = allcuts.build_kernel(sums, features, labels, np.ones(3))
    counts = spark.createDataFrame([("s", "a", 1.0, 1.0), ("s", "other", 9.0, 9.0)], "obs_id string, feature string, x double, lx double")
    obs = spark.createDataFrame([("s",), ("empty",)], "obs_id string")
    got = {(r["k"], r["obs_id"]): r for r in allcuts.assign(allcuts.spot_rows(counts, obs), kernel).collect()}
    assert len(got) == 6 and all(got[k, "empty"]["state"] == 0 and got[k, "empty"]["nn"] == 0 for k in labels)
    # Clusters 0 and 1 are equal: the lower state wins.
    assert got[3, "s"]["state"] == 0 and got[3, "s"]["sim"] == pytest.approx(1.0) and got[1, "s"]["confidence"] == 1.0
    assert np.array_equal(tree.interval_labels(np.array([0, 2, 1]), np.array([2, 0, 1]), 2), [0, 1, 0])
