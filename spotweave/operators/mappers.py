"""Pluggable spot-to-state mappers. A mapper answers for all cuts in one plan."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.functions.indexing import ordered_index
from spotweave.operators import allcuts, knn, nearest, quality, tree, wann
from spotweave.operators.reindex import reindex_fill
from spotweave.session import broadcast_if_small, cut_lineage


@dataclass
class PairContext:
    """What a mapper may use of a prepared pair.

    ``sc`` and ``st`` hold the shared features with ``x`` and ``lx``; ``sums`` are the
    start clusters' partial sums and ``sizes`` their row counts.
    """

    spark: SparkSession
    sc: DataFrame
    sc_obs: DataFrame
    st: DataFrame
    st_obs: DataFrame
    shared: DataFrame
    start: DataFrame
    sums: DataFrame
    sizes: np.ndarray
    labels: dict[int, np.ndarray]
    st_all: DataFrame | None = None  # spatial counts on all features

    def __post_init__(self) -> None:
        self._scores: DataFrame | None = None

    @cached_property
    def kernel(self) -> allcuts.Kernel | None:
        """All states of all cuts for one pass over the spots, if a task can hold them."""
        return allcuts.build_kernel(self.sums, self.shared, self.labels, self.sizes)

    @cached_property
    def spot_rows(self) -> DataFrame:
        """A row per spot with its number and its cells, written: mapper, cosines and null read it."""
        index = ordered_index(self.st_obs.select("obs_id"), ["obs_id"])
        return cut_lineage(allcuts.spot_rows(self.st, index, "i"))

    def scores(self) -> DataFrame:
        """Products of every spot with every state profile of every cut."""
        if self._scores is None:
            n = len(self.sizes)
            grams = tree.cluster_grams(self.sums, n, ["sx", "slx"])
            weights = nearest.cut_weights(self.spark, self.labels, self.sizes, *grams)
            dots = nearest.cluster_dots(self.st, self.st_obs, broadcast_if_small(self.sums), n)
            # The only pass of the mapping over the spatial matrix; L numbers per spot
            # are kept for the mapper, the cosines and their null.
            self._scores = nearest.state_scores(cut_lineage(dots), weights)
        return self._scores

    def feature_names(self) -> list[str]:
        return [r["feature"] for r in self.shared.select("feature").orderBy("feature").collect()]


class Mapper(ABC):
    """Subclasses set ``name`` and implement ``map``; ``prepare`` runs once per pair."""

    name: str

    def prepare(self, pair: PairContext) -> None:
        self.pair = pair

    @abstractmethod
    def map(self) -> tuple[DataFrame, DataFrame | None]:
        """``(mapping(k, obs_id, state, p), confidence(k, obs_id, confidence) or None)``."""

    def close(self) -> None:
        """Releases what ``prepare`` holds; called once, also after an error."""


class NearestCentroid(Mapper):
    name = "nearest_centroid"

    def map(self) -> tuple[DataFrame, DataFrame | None]:
        pair = self.pair
        if pair.kernel is not None:
            # Written once: the mapping and the confidence are two readings of it.
            best = cut_lineage(allcuts.assign(pair.spot_rows, pair.kernel))
        else:
            best = nearest.nearest_assignment(pair.scores())
        return nearest.one_hot(best), best.select("k", "obs_id", "confidence")


class AdaptiveNeighbours(Mapper):
    name = "wann"

    def prepare(self, pair: PairContext) -> None:
        super().prepare(pair)
        names = pair.feature_names()
        cells = knn.dense_vectors(pair.sc, pair.start.select("obs_id"), names)
        spots = knn.dense_vectors(pair.st, pair.st_obs, names)
        self.grid = wann.reliability_grid(int(pair.sizes.sum()))
        # Neighbour lists serve every cut.
        self.cell_lists = knn.knn_join(cells, cells, self.grid[-1], self_join=True).persist()
        self.spot_lists = knn.knn_join(spots, cells, self.grid[-1]).persist()

    def map(self) -> tuple[DataFrame, DataFrame | None]:
        labels = self.pair.labels
        found = wann.reliability(self.cell_lists, self.pair.start, labels, self.grid)
        mapping = wann.adaptive_vote(self.spot_lists, found, labels, self.grid)
        return mapping, quality.entropy_confidence(mapping)

    def close(self) -> None:
        for name in ("cell_lists", "spot_lists"):
            if hasattr(self, name):
                getattr(self, name).unpersist()


# (pair, k, cells(obs_id, state)) -> mapping(obs_id, state, p) of that cut
Aligner = Callable[[PairContext, int, DataFrame], DataFrame]


class ExternalAligner(Mapper):
    """One call of a registered function per cut, brought onto all spots and states.

    Values are kept as they come; there is no confidence. One state needs no call.
    """

    def __init__(self, name: str, align: Aligner):
        self.name, self.align = name, align

    def map(self) -> tuple[DataFrame, DataFrame | None]:
        pair, out = self.pair, None
        for k in sorted(pair.labels):
            if k < 2:
                part = pair.st_obs.select("obs_id", F.lit(0).alias("state"), F.lit(1.0).alias("p"))
            else:
                lab = tree.cut_frame(pair.spark, {k: pair.labels[k]}).select("c", "state")
                cells = pair.start.join(lab, "c").select("obs_id", "state")
                part = reindex_fill(self.align(pair, k, cells), pair.st_obs, k)
            part = part.withColumn("k", F.lit(k)).select("k", "obs_id", "state", "p")
            out = part if out is None else out.unionByName(part)
        return out, None


_BUILT_IN: dict[str, Callable[[], Mapper]] = {
    NearestCentroid.name: NearestCentroid,
    AdaptiveNeighbours.name: AdaptiveNeighbours,
}
_REGISTERED: dict[str, Callable[[], Mapper]] = {}


def register_aligner(name: str, align: Aligner) -> None:
    """Makes an external aligner available under a name, e.g. ``tangram``."""
    if name in _BUILT_IN:
        raise ValueError(f"{name!r} is built in")
    _REGISTERED[name] = lambda: ExternalAligner(name, align)


def mapper_names() -> list[str]:
    return [*_BUILT_IN, *_REGISTERED]


def build_mapper(name: str) -> Mapper:
    for table in (_BUILT_IN, _REGISTERED):
        if name in table:
            return table[name]()
    raise ValueError(f"unknown mapper {name!r}; known: {mapper_names()}")
