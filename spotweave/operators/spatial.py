"""Spatial organisation of the mapped spots: purity, enrichment and their nulls.

Edges are read once for all cuts and all shuffles. A shuffled label is a function of
the row number (see nulls.py), so the null needs neither a join nor a table of
shuffled labels: tasks count their edges and only the counts are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from spotweave.functions.indexing import ordered_index
from spotweave.functions.scalars import guarded_cosine
from spotweave.operators.knn import knn_join
from spotweave.operators.nulls import LabelShuffle, permute
from spotweave.session import cut_lineage, spread

NEIGHBOURS = 6  # of the spatial graph
SHUFFLES = 100
Z_EPS = 1e-12


def spatial_graph(spots: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``(src, dst)``: the k nearest other spots of every spot, by coordinates."""
    vec = spots.select("obs_id", F.array(F.col("px").cast("double"), F.col("py").cast("double")).alias("vec"))
    return knn_join(vec, vec, k, metric="euclidean", self_join=True).select(
        F.col("obs_id").alias("src"), F.col("nbr").alias("dst")
    )


TOTAL, OBSERVED = -1, -1


def labelled_edges(edges: DataFrame, assigned: DataFrame, ks: list[int], index: DataFrame | None = None) -> DataFrame:
    """``(a, b, i?, j?)``: per directed edge the labels of both ends at the cuts ``ks`` (-1 where a
    spot has none), and the ends' numbers of ``index(obs_id, i)``. An edge is one row."""
    states = F.map_from_entries(F.collect_list(F.struct("k", "state")))
    packed = assigned.groupBy("obs_id").agg(states.alias("m"))
    wanted = F.array(*(F.lit(k) for k in ks))
    packed = packed.select("obs_id", F.transform(wanted, lambda k: F.coalesce(F.col("m")[k], F.lit(TOTAL))).alias("s"))
    numbers = []
    if index is not None:
        packed, numbers = packed.join(index, "obs_id"), ["i"]
    ends = lambda key, names: packed.select(F.col("obs_id").alias(key), *(F.col(c).alias(n) for c, n in zip(["s", *numbers], names)))
    return edges.join(ends("src", ["a", "i"]), "src").join(ends("dst", ["b", "j"]), "dst").drop("src", "dst")


def edge_counts(
    edges: DataFrame, assigned: DataFrame, counts: dict[int, list[int]], index: DataFrame | None = None, n_perm: int = 0, seed: int = 0
) -> DataFrame:
    """``(k, draw, state, n)``: edges inside each state, as mapped (draw -1) and under ``n_perm``
    label shuffles over the numbers ``index(obs_id, i)``. State -1 of draw -1 counts all edges of the cut.

    Every edge is read once for all cuts and shuffles, and tasks send counts only.
    """
    ks = sorted(counts)
    sent = edges.sparkSession.sparkContext.broadcast({k: np.cumsum(counts[k]) for k in ks})
    n = int(sum(counts[ks[0]])) if ks else 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros((n_perm + 1, len(counts[k]) + 1), np.int64) for k in ks}
        for batch in batches:
            a, b = (pc.list_flatten(batch.column(c)).to_numpy().reshape(-1, len(ks)) for c in "ab")
            known = (a != TOTAL) & (b != TOTAL)
            for at, k in enumerate(ks):
                inside = a[known[:, at] & (a[:, at] == b[:, at]), at]
                totals[k][0, :-1] += np.bincount(inside, minlength=len(counts[k]))
                totals[k][0, -1] += known[:, at].sum()
            for draw in range(n_perm):
                x, y = (permute(batch.column(c).to_numpy(), n, seed, draw) for c in "ij")
                for k in ks:
                    la, lb = (np.searchsorted(sent.value[k], v, side="right") for v in (x, y))
                    totals[k][draw + 1, :-1] += np.bincount(la[la == lb], minlength=len(counts[k]))
        for k in ks:
            draw, state = np.indices(totals[k].shape)
            state[:, -1] = TOTAL
            own = (np.full(draw.size, k), draw.ravel() - 1, state.ravel())
            yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in own), pa.array(totals[k].ravel())], names=["k", "draw", "state", "n"])

    labelled = labelled_edges(edges, assigned, ks, index if n_perm else None)
    if n_perm:  # far more work than its bytes tell
        labelled = spread(labelled, "i", "j")
    added = labelled.mapInArrow(count, "k int, draw int, state int, n bigint").groupBy("k", "draw", "state").agg(F.sum("n").alias("n"))
    return added.where((F.col("state") != TOTAL) | (F.col("draw") == OBSERVED))


def purity_of(counted: DataFrame) -> DataFrame:
    """``(k, n_edges, purity)`` from ``edge_counts``: share of directed edges between equal labels."""
    inside = F.sum(F.when(F.col("state") != TOTAL, F.col("n")))
    own = counted.where(F.col("draw") == OBSERVED).groupBy("k").agg(F.sum(F.when(F.col("state") == TOTAL, F.col("n"))).alias("n_edges"), inside.alias("_in"))
    return own.where("n_edges > 0").select("k", "n_edges", (F.col("_in").cast("double") / F.col("n_edges")).alias("purity"))


def local_purity(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(k, n_edges, purity)``: share of directed edges between equal labels."""
    return purity_of(edge_counts(edges, assigned, label_counts(assigned)))


def within_state_edges(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(k, state, n)``: edges inside each state that has spots, zero included."""
    counts = label_counts(assigned)
    return _inside(edge_counts(edges, assigned, counts), counts)


def _inside(counted: DataFrame, counts: dict[int, list[int]]) -> DataFrame:
    present = [(k, s) for k, own in counts.items() for s, n in enumerate(own) if n]
    # States of the cuts, as many rows as ``counts`` has numbers.
    known = F.broadcast(counted.sparkSession.createDataFrame(present, "k int, state int"))
    own = counted.where((F.col("draw") == OBSERVED) & (F.col("state") != TOTAL))
    return known.join(own.select("k", "state", "n"), ["k", "state"], "left").select("k", "state", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def expected_purity(assigned: DataFrame) -> DataFrame:
    """``(k, expected)``: mean purity under label shuffling, in closed form."""
    per_state = assigned.groupBy("k", "state").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return per_state.groupBy("k").agg(
        F.try_divide(
            F.sum(F.col("n") * (F.col("n") - 1)), F.sum("n") * (F.sum("n") - 1)
        ).alias("expected")
    )


def label_counts(assigned: DataFrame) -> dict[int, list[int]]:
    """Spots per state and cut: at most k numbers per cut reach the driver."""
    out: dict[int, dict[int, int]] = {}
    for row in assigned.groupBy("k", "state").agg(F.count(F.lit(1)).alias("n")).collect():
        out.setdefault(row["k"], {})[row["state"]] = row["n"]
    return {k: [v.get(s, 0) for s in range(max(v) + 1)] for k, v in out.items()}


def permutation_test(observed: DataFrame, null: DataFrame) -> DataFrame:
    """``(k, observed, p_value, z_score, null_mean, null_std)`` from ``observed(k, value)``
    and ``null(k, draw, value)``; NULL where the observed value or the null is missing."""
    good = null.where(F.col("value").isNotNull() & ~F.isnan("value"))
    usable = observed.where(F.col("value").isNotNull() & ~F.isnan("value")).select(
        "k", F.col("value").alias("observed")
    )
    stats = (
        usable.join(good, "k")
        .groupBy("k", "observed")
        .agg(
            F.avg((F.col("value") >= F.col("observed")).cast("double")).alias("p_value"),
            F.avg("value").alias("null_mean"),
            F.stddev_pop("value").alias("null_std"),
        )
        .withColumn(
            "z_score", (F.col("observed") - F.col("null_mean")) / (F.col("null_std") + Z_EPS)
        )
    )
    return observed.select("k", F.col("value").alias("observed")).join(stats.drop("observed"), "k", "left").select(
        "k", "observed", "p_value", "z_score", "null_mean", "null_std"
    )


def purity_null(shuffled: DataFrame, n_edges: DataFrame) -> DataFrame:
    """``(k, draw, value)``: purity of each shuffle."""
    return (
        shuffled.groupBy("k", "draw")
        .agg(F.sum("n").alias("n"))
        .join(n_edges.select("k", "n_edges"), "k")
        .select("k", "draw", F.try_divide(F.col("n").cast("double"), F.col("n_edges")).alias("value"))
    )


def enrichment(observed: DataFrame, shuffled: DataFrame) -> DataFrame:
    """``(k, n_states, mean_self_zscore)`` over the states present; NULL below two states
    and where no state's null varies."""
    null = shuffled.groupBy("k", "state").agg(
        F.avg("n").alias("mean"), F.stddev_pop("n").alias("std")
    )
    z = F.when(F.col("std") > 0, F.try_divide(F.col("n") - F.col("mean"), F.col("std")))
    return (
        observed.join(null, ["k", "state"], "left")
        .groupBy("k")
        .agg(F.count(F.lit(1)).alias("n_states"), F.avg(z).alias("_m"))
        .select("k", "n_states", F.when(F.col("n_states") >= 2, F.col("_m")).alias("mean_self_zscore"))
    )


def spatial_organisation(
    spots: DataFrame,
    assigned: DataFrame,
    edges: DataFrame | None = None,
    k: int = NEIGHBOURS,
    n_perm: int = SHUFFLES,
    seed: int = 0,
) -> DataFrame:
    """One row per cut: purity test and self-enrichment of the mapped states."""
    n_spots = spots.count()
    if n_spots <= k:
        raise ValueError(f"spatial organisation needs more than {k} spots, got {n_spots}")
    if spots.where(F.col("px").isNull() | F.col("py").isNull()).limit(1).count():
        raise ValueError("every spot needs coordinates")
    edges = edges if edges is not None else spatial_graph(spots, k)
    counts = label_counts(assigned)
    index = ordered_index(spots.select("obs_id"), ["obs_id"])
    # A few numbers per cut and draw, read by the test and by the enrichment.
    counted = cut_lineage(edge_counts(edges, assigned, counts, index, n_perm, seed))
    purity = purity_of(counted)
    null = counted.where(F.col("draw") != OBSERVED)
    test = permutation_test(purity.select("k", F.col("purity").alias("value")), purity_null(null, purity))
    enriched = enrichment(_inside(counted, counts), null)
    return (
        test.join(enriched, "k")
        .withColumn("n_spots", F.lit(n_spots).cast("bigint"))
        .withColumn("n_neighbours", F.lit(k))
        .withColumn("n_perm", F.lit(n_perm))
    )


def shuffled_reconstruction(
    counts: DataFrame,
    scores: DataFrame,
    profiles: DataFrame,
    assigned_counts: dict[int, list[int]],
    index: DataFrame,
    n_perm: int = 20,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Per-spot and per-feature cosines with shuffled labels, for every cut and draw, by joins:
    the way beyond the size that ``allcuts.shuffled`` takes.

    Returns ``(k, draw, obs_id, value)`` and ``(k, draw, feature, value)``.
    """
    spark = counts.sparkSession
    ks = sorted(assigned_counts)
    shuffles = spark.sparkContext.broadcast(
        {k: LabelShuffle.from_counts(assigned_counts[k], seed) for k in ks}
    )

    def draw_labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            i = pdf["i"].to_numpy()
            for k in ks:
                for draw in range(n_perm):
                    yield pd.DataFrame(
                        {
                            "k": np.full(len(i), k, dtype=np.int32),
                            "draw": np.full(len(i), draw, dtype=np.int32),
                            "obs_id": pdf["obs_id"],
                            "state": shuffles.value[k].labels(i, draw).astype(np.int32),
                        }
                    )

    schema = T.StructType(
        [
            T.StructField("k", T.IntegerType()),
            T.StructField("draw", T.IntegerType()),
            T.StructField("obs_id", index.schema["obs_id"].dataType),
            T.StructField("state", T.IntegerType()),
        ]
    )
    labels = spread(index.select("obs_id", "i"), "obs_id").mapInPandas(draw_labels, schema)
    norms = profiles.groupBy("k", "state").agg(F.sum(F.col("m") * F.col("m")).alias("mm"))
    per_spot = (
        labels.join(scores.select("k", "obs_id", "state", "dot", "nn"), ["k", "obs_id", "state"])
        .join(norms, ["k", "state"], "left")
        .select("k", "draw", "obs_id", guarded_cosine("dot", "nn", F.coalesce("mm", F.lit(0.0))).alias("value"))
    )
    # |pred|^2 of a feature depends on how many spots hold a state, and a shuffle
    # keeps that: one value per cut serves all draws.
    sizes = spark.createDataFrame(
        [(k, s, n) for k in ks for s, n in enumerate(assigned_counts[k])], "k int, state int, spots bigint"
    )
    pred = (
        profiles.join(sizes, ["k", "state"])
        .groupBy("k", "feature")
        .agg(F.sum(F.col("spots") * F.col("m") * F.col("m")).alias("pp"))
    )
    num = (
        counts.select("obs_id", "feature", "x")
        .join(labels, "obs_id")
        .groupBy("k", "draw", "state", "feature")
        .agg(F.sum("x").alias("sx"))
        .join(profiles, ["k", "state", "feature"])
        .groupBy("k", "draw", "feature")
        .agg(F.sum(F.col("sx") * F.col("m")).alias("num"))
    )
    seen = counts.groupBy("feature").agg(F.sum(F.col("x") * F.col("x")).alias("xx"))
    draws = pred.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    zero = F.lit(0.0)
    per_feature = (
        draws.join(num, ["k", "draw", "feature"], "left")
        .join(seen, "feature", "left")
        .select(
            "k",
            "draw",
            "feature",
            guarded_cosine(F.coalesce("num", zero), F.coalesce("xx", zero), "pp").alias("value"),
        )
    )
    return per_spot, per_feature
