"""Agglomeration tree over the start-cluster profiles and its cuts.

The features stay in Spark: tasks reduce their share of the features to partial
L x L sums, and only those L x L numbers reach the driver. Linking L points is
sequential by nature and tiny next to the matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spotweave.operators.normalize import relative_frequency
from spotweave.session import cut_lineage

METHODS = ("average", "ward")
# Groups whose mutual distances the driver may hold: 128 MB.
DRIVER_LEAVES = 4096
# Clusters of one side of a task that computes distances.
PAIR_BLOCK = 256


def _pair_sums(profiles: DataFrame, values: list[str], n_clusters: int, kind: str) -> list[np.ndarray]:
    """L x L matrices of a per-feature pair sum, one per value column: dot products or
    squared differences."""
    upper = np.triu_indices(n_clusters)
    names = [f"s{i}" for i in range(len(values))]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(values), n_clusters, n_clusters))
        for pdf in batches:
            if not len(pdf):
                continue
            # One row per feature with its cluster list: a batch never splits a feature.
            row = np.repeat(np.arange(len(pdf)), pdf["c"].map(len))
            col = np.concatenate(pdf["c"].to_list()).astype(int)
            for at, name in enumerate(names):
                block = np.zeros((len(pdf), n_clusters))
                block[row, col] = np.concatenate(pdf[name].to_list())
                if kind == "dot":
                    total[at] += block.T @ block
                else:
                    for i in range(n_clusters):
                        total[at, i] += ((block[:, i : i + 1] - block) ** 2).sum(0)
        out = {"a": upper[0].astype(np.int32), "b": upper[1].astype(np.int32)}
        yield pd.DataFrame({**out, **{n: total[at][upper] for at, n in enumerate(names)}})

    fields = [F.col(v).cast("double").alias(n) for v, n in zip(values, names)]
    packed = (
        profiles.groupBy("feature")
        .agg(F.collect_list(F.struct("c", *fields)).alias("e"))
        .select(F.col("e.c").alias("c"), *[F.col(f"e.{n}").alias(n) for n in names])
    )
    schema = "a int, b int, " + ", ".join(f"{n} double" for n in names)
    rows = (
        packed.mapInPandas(partial, schema)
        .groupBy("a", "b")
        .agg(*[F.sum(n).alias(n) for n in names])
        .toPandas()
    )
    out = np.zeros((len(values), n_clusters, n_clusters))
    for at, n in enumerate(names):
        out[at, rows["a"], rows["b"]] = rows[n]
        out[at, rows["b"], rows["a"]] = rows[n]
    return list(out)


def cluster_grams(sums: DataFrame, n_clusters: int, values: list[str]) -> list[np.ndarray]:
    """L x L dot products of the cluster rows, per value column."""
    return _pair_sums(sums, values, n_clusters, "dot")


def profile_distances(centroids: DataFrame, n_clusters: int, value: str = "m") -> np.ndarray:
    """L x L Euclidean distances between relative-frequency profiles."""
    freq = relative_frequency(centroids, "c", value)
    return np.sqrt(_pair_sums(freq, ["f"], n_clusters, "difference")[0])


def block_pairs(rows: DataFrame, n_clusters: int, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], out: str, block: int = PAIR_BLOCK) -> DataFrame:
    """``(a, b, out)``, a < b: ``measure(profiles, profile)`` of the ``rows(c, feature, v)`` of every two clusters.

    Clusters are dealt into blocks; a task meets two blocks and holds nothing else. A block is copied
    once per other block, what all pairs need; no pair is a row before it is measured.
    """
    count = -(-n_clusters // block)
    own = F.floor(F.col("c") / block).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda o: F.struct(F.least(own, o).alias("p"), F.greatest(own, o).alias("q")))
    dealt = rows.select("c", "feature", F.col("v").cast("double").alias("v"), F.inline(others))

    def meet(key: tuple, part: pa.Table) -> pa.Table:
        names = part.column("feature").combine_chunks().dictionary_encode()
        there, row = np.unique(part.column("c").to_numpy(), return_inverse=True)
        dense = np.zeros((len(there), len(names.dictionary)))
        dense[row, names.indices.to_numpy()] = part.column("v").to_numpy()
        p, q = (v.as_py() for v in key)
        found = [(np.empty(0), np.empty(0), np.empty(0))]
        for i, a in enumerate(there.tolist()):
            far = (there > a) & (there // block == q)
            if a // block == p and far.any():
                found.append((np.full(far.sum(), a), there[far], measure(dense[far], dense[i])))
        a, b, v = (np.concatenate(x) for x in zip(*found))
        return pa.table({"a": pa.array(a.astype(np.int32)), "b": pa.array(b.astype(np.int32)), out: pa.array(v)})

    return dealt.groupBy("p", "q").applyInArrow(meet, f"a int, b int, {out} double")


def distance_pairs(centroids: DataFrame, n_clusters: int, value: str = "m") -> DataFrame:
    """``(a, b, d)``, a < b: Euclidean distances between relative-frequency profiles, in Spark."""
    freq = relative_frequency(centroids, "c", value).withColumnRenamed("f", "v")
    return block_pairs(freq, n_clusters, lambda others, one: np.sqrt(((others - one) ** 2).sum(1)), "d")


def link(distances: np.ndarray, method: str = "average") -> np.ndarray:
    """Merges ``(i, j, height, size)`` in the order of their heights, L - 1 rows.

    ``average`` is UPGMA; ``ward`` is the ward.D rule on plain distances, whose
    heights are reported as square roots. Every leaf weighs 1. A chain of nearest
    neighbours, each a row's minimum, ends in a pair that is nearest to each other and
    merges; both rules are reducible, so the chain stays valid and L rows of L numbers
    are read a few times in all. Of equally near neighbours the chain takes the one it
    came from, then the smallest id.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    n = len(distances)
    if n < 2:
        raise ValueError(f"a tree needs at least 2 start clusters, got {n}")
    if not np.isfinite(distances).all():
        raise ValueError("distances contain non-finite values")
    return _by_height(_chain(distances, method), n, method)


def _chain(distances: np.ndarray, method: str, sizes=None, heights=None, names=None) -> list[tuple[float, int, int]]:
    """Merges ``(height, name, name)`` of groups with the given sizes, heights and names."""
    n = len(distances)
    d = distances.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    size = np.ones(n) if sizes is None else np.array(sizes, float)
    height_of = np.zeros(n) if heights is None else np.array(heights, float)
    names = range(n) if names is None else names
    open_ = np.ones(n, bool)
    found: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(found) < n - 1:
        if not chain:
            chain.append(int(open_.argmax()))
        top = chain[-1]
        nearest = int(d[top].argmin())
        if len(chain) > 1 and d[top, chain[-2]] <= d[top, nearest]:
            nearest = chain[-2]
        if len(chain) == 1 or nearest != chain[-2]:
            chain.append(nearest)
            continue
        del chain[-2:]
        u, v = sorted((top, nearest))
        # Heights never fall in either rule; rounding must not make them.
        height = max(d[u, v], height_of[u], height_of[v])
        if method == "average":
            fresh = (size[u] * d[u] + size[v] * d[v]) / (size[u] + size[v])
        else:
            fresh = ((size[u] + size) * d[u] + (size[v] + size) * d[v] - size * d[u, v]) / (size[u] + size[v] + size)
        open_[v] = False
        fresh[~open_] = fresh[u] = np.inf
        d[u, :] = d[:, u] = fresh
        d[v, :] = d[:, v] = np.inf
        size[u] += size[v]
        height_of[u] = height
        found.append((height, names[u], names[v]))
    return found


def _by_height(found: list[tuple[float, int, int]], n: int, method: str) -> np.ndarray:
    """Merges ``(height, leaf, leaf)``, each after those below it, as rows that name nodes."""
    merges = np.zeros((n - 1, 4))
    root = list(range(n))  # of leaves
    node, size = list(range(n)), [1] * n

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # A stable sort keeps a merge behind those of its own parts, also at equal heights.
    for step, (height, a, b) in enumerate(sorted(found, key=lambda m: m[0])):
        a, b = sorted((find(a), find(b)))
        merges[step] = (*sorted((node[a], node[b])), height if method == "average" else np.sqrt(height), size[a] + size[b])
        root[b], node[a], size[a] = a, n + step, size[a] + size[b]
    return merges


def link_table(pairs: DataFrame, n_clusters: int, method: str = "average", most: int = DRIVER_LEAVES) -> np.ndarray:
    """The merges of ``link`` from the distances ``pairs(a, b, d)``, a < b, of any number of leaves.

    Up to ``most`` leaves their distances come to the driver. Beyond that, rounds in Spark
    merge all pairs that are nearest to each other; both rules are functions of the sums of distances between and
    within the parts, which add up. Only merges reach the driver then, until ``most`` groups are left.
    """
    spark, n = pairs.sparkSession, n_clusters
    found: list[tuple[float, int, int]] = []
    now = pairs.select("a", "b", F.col("d").cast("double").alias("s"))
    # Leaves of a group and the sum of distances within it; a group is named by its smallest leaf.
    size, within, height_of = {i: 1 for i in range(n)}, dict.fromkeys(range(n), 0.0), {}

    def value(s: float | Column, na, nb, wa, wb):
        mean = s / (na * nb)
        return mean if method == "average" else (mean - wa / (na * na) - wb / (nb * nb)) * (2.0 * na * nb / (na + nb))

    while len(size) > most:
        groups = spark.createDataFrame([(i, float(k), within[i]) for i, k in size.items()], "i int, n double, w double")
        side = lambda k: F.broadcast(groups.toDF(k, f"n{k}", f"w{k}"))  # noqa: E731  (a row per group)
        now = cut_lineage(now)
        known = now.join(side("a"), "a").join(side("b"), "b").withColumn("v", value(F.col("s"), *(F.col(c) for c in ("na", "nb", "wa", "wb"))))
        ends = known.select(F.explode(F.array(F.struct(F.col("a").alias("i"), F.struct("v", "a", "b").alias("e")), F.struct(F.col("b").alias("i"), F.struct("v", "a", "b").alias("e")))).alias("x"), "s")
        best = ends.groupBy("x.i").agg(F.min(F.struct("x.e", "s")).alias("best"))
        mutual = best.groupBy("best").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        into = {}
        for row in mutual.select("best.e.v", "best.e.a", "best.e.b", "best.s").orderBy("v", "a", "b").toLocalIterator():
            a, b = row["a"], row["b"]
            height = max(row["v"], height_of.get(a, 0.0), height_of.get(b, 0.0))
            found.append((height, a, b))
            size[a], within[a], height_of[a] = size[a] + size.pop(b), within[a] + within.pop(b) + row["s"], height
            into[b] = a
        renamed = F.broadcast(spark.createDataFrame(list(into.items()), "b int, to int"))
        for k in "ab":
            now = now.join(renamed.withColumnRenamed("b", k), k, "left").withColumn(k, F.coalesce("to", k)).drop("to")
        now = now.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"))
    names = sorted(size)
    number = {name: i for i, name in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    table = now.select("a", "b", "s").toPandas()  # ``most`` squared numbers at most
    i, j = (table[k].map(number).to_numpy(int) for k in "ab")
    sizes, inner = np.array([size[k] for k in names], float), np.array([within[k] for k in names])
    d[i, j] = d[j, i] = value(table["s"].to_numpy(float), sizes[i], sizes[j], inner[i], inner[j])
    if len(names) == n:
        return link(d, method)
    return _by_height(found + _chain(d, method, [size[i] for i in names], [height_of.get(i, 0.0) for i in names], names), n, method)


def leaf_order(merges: np.ndarray, n_clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in an order in which every group of every cut is one interval, and the merge that
    joins each leaf to the one before it (the first leaf: L - 1, no merge).

    Of two merged intervals that with the smaller leaf comes first, so an interval's first
    leaf is its smallest one."""
    first, last = list(range(n_clusters)), list(range(n_clusters))
    behind, joined = [-1] * n_clusters, np.full(n_clusters, n_clusters - 1)
    for step, (i, j) in enumerate(merges[:, :2].astype(int).tolist()):
        if first[j] < first[i]:
            i, j = j, i
        behind[last[i]] = first[j]
        joined[first[j]] = step
        first.append(first[i])
        last.append(last[j])
    order = [0]
    while behind[order[-1]] >= 0:
        order.append(behind[order[-1]])
    return np.array(order), joined[order]


def interval_labels(order: np.ndarray, joined: np.ndarray, k: int) -> np.ndarray:
    """State of every start cluster at cut ``k``: intervals of the leaf order begin where the last
    k - 1 merges join. States are numbered by their smallest member; exactly k come out, also
    when heights tie."""
    n = len(order)
    starts = joined >= n - min(k, n)
    state = np.empty(n, np.int64)
    smallest = order[starts]
    rank = np.empty(len(smallest), np.int64)
    rank[np.argsort(smallest)] = np.arange(len(smallest))
    state[order] = rank[np.cumsum(starts) - 1]
    return state


def cut_labels(merges: np.ndarray, k: int, n_clusters: int) -> np.ndarray:
    """State of every start cluster after all but the last k - 1 merges."""
    return interval_labels(*leaf_order(merges, n_clusters), k)


def k_range(n_clusters: int, k_min: int | None = None, k_max: int | None = None, k_step: int = 1) -> list[int]:
    """Swept K values, descending. 0 counts as unset for both bounds."""
    if k_step <= 0:
        raise ValueError(f"k_step must be positive, got {k_step}")
    high = min(n_clusters, k_max) if k_max else n_clusters
    low = max(1, k_min) if k_min else 1
    ks = list(range(high, low - 1, -k_step))
    if not ks:
        raise ValueError(f"empty K range: from {high} down to {low}")
    return ks


class TreeCuts(dict):
    """States of the start clusters by K, with the leaf order they are intervals of."""

    def __init__(self, merges: np.ndarray, ks: list[int], n_clusters: int):
        self.order, self.joined = leaf_order(merges, n_clusters)
        super().__init__({k: interval_labels(self.order, self.joined, k) for k in ks})


def cuts(merges: np.ndarray, ks: list[int], n_clusters: int) -> TreeCuts:
    return TreeCuts(merges, ks, n_clusters)


def cut_frame(spark: SparkSession, labels: dict[int, np.ndarray]) -> DataFrame:
    """``(k, c, state)``: of a tree, tasks cut it at their Ks, so that L numbers leave the driver;
    other labels are sent as they are, L rows per K."""
    if not isinstance(labels, TreeCuts):
        rows = [(int(k), int(c), int(s)) for k, lab in labels.items() for c, s in enumerate(lab)]
        return spark.createDataFrame(rows, "k int, c int, state int")
    order, joined = labels.order, labels.joined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("k").to_pylist():
                state = interval_labels(order, joined, k)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(state), pa.int32()), pa.array(np.arange(len(state), dtype=np.int32)), pa.array(state.astype(np.int32))], names=["k", "c", "state"])

    return spark.createDataFrame([(int(k),) for k in labels], "k int").mapInArrow(run, "k int, c int, state int")
