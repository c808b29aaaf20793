"""All cuts in one pass over the spots.

The states of all cuts are few different sets of start clusters: 2L - 1 for the cuts of a
tree. A spot's products with those sets are one product of its row with the L cluster sums
and one with the sets' members. A task holds the cluster sums and works on batches of spots,
so that no row per cell and K, or per spot, K and state, is ever made; what leaves a
task is an assignment per spot and K, or sums per feature and K.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from spotweave.operators.nulls import LabelShuffle

EPS = 1e-8
TOP_STATES = 4  # candidates the margin confidence looks at
DIGITS = 9  # scores are ranked after rounding; ties go to the lowest state
# Numbers a task may hold for the cluster sums, the members of the states and their profiles.
KERNEL_NUMBERS = 32 << 20
BLOCK_NUMBERS = 2 << 20
ASSIGNED = "state int, sim double, dot double, ldot double, nn double, ln double, mm double, lmm double, confidence double"


@dataclass
class Kernel:
    """What every task needs: cluster sums (features x L), members of the different states (L x
    states), their weights and squared norms, and per K the states' numbers."""

    features: list[str]
    raw: np.ndarray
    log: np.ndarray
    member: np.ndarray
    weight: np.ndarray
    mm: np.ndarray
    lmm: np.ndarray
    columns: dict[int, np.ndarray]

    def profiles(self) -> tuple[np.ndarray, np.ndarray]:
        """Profiles of the states (states x features), raw and log-normalised."""
        return ((s @ self.member * self.weight).T for s in (self.raw, self.log))


def numbers_needed(n_features: int, labels: dict[int, np.ndarray]) -> int:
    """Size of a kernel for these cuts."""
    states = len({s for lab in labels.values() for s in _sets(lab)})
    n = len(next(iter(labels.values())))
    return 2 * n_features * n + n * states + 2 * n_features * states


def _sets(lab: np.ndarray) -> list[bytes]:
    return [np.packbits(lab == s).tobytes() for s in range(int(lab.max()) + 1)]


def build_kernel(sums: DataFrame, features: DataFrame, labels: dict[int, np.ndarray], sizes: np.ndarray, eps: float = EPS) -> Kernel | None:
    """Kernel from the ``sums(c, feature, sx, slx)`` of the clusters, or None if it would exceed
    ``KERNEL_NUMBERS``; then the joins of ``nearest`` do the work."""
    n = len(sizes)
    n_features = features.count()
    if numbers_needed(n_features, labels) > KERNEL_NUMBERS:
        return None
    # Bounded by the check above.
    names = sorted(features.select("feature").distinct().toArrow().column(0).to_pylist())
    table = sums.select("c", "feature", F.col("sx").cast("double"), F.col("slx").cast("double")).toArrow()
    raw, log = np.zeros((len(names), n)), np.zeros((len(names), n))
    row = pc.index_in(table.column("feature"), value_set=pa.array(names, table.schema.field("feature").type)).combine_chunks()
    there = pc.is_valid(row).to_numpy(zero_copy_only=False)
    row = pc.fill_null(row, 0).to_numpy()[there]
    column = table.column("c").to_numpy()[there]
    raw[row, column] = table.column("sx").to_numpy()[there]
    log[row, column] = table.column("slx").to_numpy()[there]

    number: dict[bytes, int] = {}
    columns = {k: np.array([number.setdefault(s, len(number)) for s in _sets(lab)]) for k, lab in labels.items()}
    member = np.stack([np.unpackbits(np.frombuffer(s, np.uint8), count=n) for s in number], 1).astype(float)
    weight = 1.0 / (sizes @ member + eps)
    mm, lmm = (((s @ member) ** 2).sum(0) * weight * weight for s in (raw, log))
    return Kernel(names, raw, log, member, weight, mm, lmm, columns)


def spot_rows(counts: DataFrame, obs: DataFrame, *carried: str) -> DataFrame:
    """``(obs_id, f, x, lx, ...)``: the cells of a spot as arrays, bounded by the features; spots
    without cells stay. ``counts`` that are already dealt by spot are not moved again."""
    cells = counts.groupBy("obs_id").agg(F.collect_list(F.struct("feature", "x", "lx")).alias("e"))
    rows = obs.select("obs_id", *carried).join(cells, "obs_id", "left")
    return rows.select("obs_id", *carried, F.col("e.feature").alias("f"), F.col("e.x").alias("x"), F.col("e.lx").alias("lx"))


@dataclass
class Block:
    """Some spots: dense rows of their cells and their products with the different states."""

    part: pa.RecordBatch
    x: np.ndarray
    lx: np.ndarray
    dot: np.ndarray
    ldot: np.ndarray
    nn: np.ndarray
    ln: np.ndarray


def blocks(batches: Iterator[pa.RecordBatch], kernel: Kernel) -> Iterator[Block]:
    width = len(kernel.features)
    names = pa.array(kernel.features, pa.string())
    step = max(1, BLOCK_NUMBERS // max(1, width, len(kernel.weight)))
    for batch in batches:
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            lists = part.column("f")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            row = np.repeat(np.arange(part.num_rows), sizes)
            found = pc.index_in(pc.list_flatten(lists), value_set=names)
            there = pc.is_valid(found).to_numpy(zero_copy_only=False)
            at = pc.fill_null(found, 0).to_numpy()[there]
            dense = []
            for name in ("x", "lx"):
                out = np.zeros((part.num_rows, width))
                out[row[there], at] = pc.list_flatten(part.column(name)).to_numpy(zero_copy_only=False)[there]
                dense.append(out)
            x, lx = dense
            dot, ldot = (v @ s @ kernel.member * kernel.weight for v, s in ((x, kernel.raw), (lx, kernel.log)))
            yield Block(part, x, lx, dot, ldot, (x * x).sum(1), (lx * lx).sum(1))


def similarities(block: Block, kernel: Kernel) -> np.ndarray:
    """Raw cosines of the spots with the different states; the norms carry ``EPS``."""
    return block.dot / ((np.sqrt(block.nn)[:, None] + EPS) * (np.sqrt(kernel.mm) + EPS))


def best_states(sim: np.ndarray, ranked: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best state of each spot and its margin confidence, from similarities and their rounded values."""
    own = ranked[:, columns]
    state = own.argmax(1)
    if len(columns) == 1:
        return state, np.ones(len(state))
    rows = np.arange(len(state))
    best = 1.0 - sim[rows, columns[state]]
    own[rows, state] = -np.inf
    rest = min(TOP_STATES, len(columns)) - 1
    place = np.argpartition(own, len(columns) - rest, 1)[:, len(columns) - rest :] if rest < len(columns) - 1 else None
    if place is None:
        rivals = (1.0 - sim[:, columns]).sum(1) - best
    else:
        rivals = (1.0 - sim[rows[:, None], columns[place]]).sum(1)
    return state, np.clip(1.0 - best / (rivals / rest + EPS), 0.0, 1.0)


def assign(rows: DataFrame, kernel: Kernel) -> DataFrame:
    """``(k, obs_id, state, sim, dot, ldot, nn, ln, mm, lmm, confidence)`` of ``spot_rows``: the nearest
    state at every cut, as ``nearest.nearest_assignment`` gives it."""
    sent = rows.sparkSession.sparkContext.broadcast(kernel)
    kind = rows.schema["obs_id"].dataType.simpleString()
    names = ["k", "obs_id", "state", "sim", "dot", "ldot", "nn", "ln", "mm", "lmm", "confidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = sent.value
        for block in blocks(batches, kernel):
            sim = similarities(block, kernel)
            ranked = np.round(sim, DIGITS)
            at = np.arange(len(sim))
            ids = block.part.column("obs_id")
            for k, columns in kernel.columns.items():
                state, confidence = best_states(sim, ranked, columns)
                node = columns[state]
                values = (sim[at, node], block.dot[at, node], block.ldot[at, node], block.nn, block.ln, kernel.mm[node], kernel.lmm[node], confidence)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), ids, pa.array(state.astype(np.int32)), *(pa.array(v) for v in values)], names=names)

    return rows.mapInArrow(run, f"k int, obs_id {kind}, {ASSIGNED}")


FEATURE_SUMS = "k int, draw int, at int, num double, lnum double, pp double, lpp double"


class FeatureSums:
    """Per K and feature: products of the spots' values with the profiles of their states, and the
    profiles' squares, added up over spots."""

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        self.m, self.ml = kernel.profiles()
        self.total: dict[tuple[int, int], np.ndarray] = {}

    def add(self, block: Block, k: int, state: np.ndarray, draw: int = 0) -> None:
        columns = self.kernel.columns[k]
        out = self.total.setdefault((k, draw), np.zeros((4, len(self.kernel.features))))
        order = np.argsort(state, kind="stable")
        there, first, held = np.unique(state[order], return_index=True, return_counts=True)
        # Sums of the spots of each state, then one row of products per state.
        for at, (values, profile) in enumerate(((block.x, self.m), (block.lx, self.ml))):
            own = profile[columns[there]]
            out[at] += (np.add.reduceat(values[order], first, axis=0) * own).sum(0)
            out[at + 2] += (held[:, None] * own * own).sum(0)

    def batches(self) -> Iterator[pa.RecordBatch]:
        width = len(self.kernel.features)
        for (k, draw), out in self.total.items():
            head = [pa.array(np.full(width, v, np.int32)) for v in (k, draw)]
            yield pa.RecordBatch.from_arrays([*head, pa.array(np.arange(width, dtype=np.int32)), *(pa.array(v) for v in out)], names=["k", "draw", "at", "num", "lnum", "pp", "lpp"])


def _named(parts: DataFrame, kernel: Kernel) -> DataFrame:
    """Sums of the tasks added up, with the features' names."""
    names = parts.sparkSession.createDataFrame(list(enumerate(kernel.features)), "at int, feature string")
    added = parts.groupBy("k", "draw", "at").agg(*(F.sum(c).alias(c) for c in ("num", "lnum", "pp", "lpp")))
    # As many rows as the kernel has features.
    return added.join(F.broadcast(names), "at").drop("at")


def feature_sums(rows: DataFrame, kernel: Kernel) -> DataFrame:
    """``(k, draw, feature, num, lnum, pp, lpp)`` of the nearest states; ``draw`` is 0."""
    sent = rows.sparkSession.sparkContext.broadcast(kernel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = sent.value
        sums = FeatureSums(kernel)
        for block in blocks(batches, kernel):
            sim = similarities(block, kernel)
            ranked = np.round(sim, DIGITS)
            for k, columns in kernel.columns.items():
                sums.add(block, k, ranked[:, columns].argmax(1))
        yield from sums.batches()

    return _named(rows.mapInArrow(run, FEATURE_SUMS), kernel)


def with_votes(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """``spot_rows`` with their ``votes`` of ``mapping(k, obs_id, state, p)``, as many as a spot has
    states of any K."""
    votes = mapping.where(F.col("p") != 0).groupBy("obs_id").agg(F.collect_list(F.struct("k", "state", "p")).alias("votes"))
    return rows.join(votes, "obs_id", "left")


def vote_matrices(block: Block, kernel: Kernel) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(k, spots that vote, spots x states)`` of a block that has votes."""
    lists = block.part.column("votes")
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    flat = pc.list_flatten(lists)
    if not len(flat):
        return
    k, state, p = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("k", "state", "p"))
    order = np.argsort(k, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(k[order])) + 1):
        cut = int(k[own[0]])
        if cut in kernel.columns:
            votes = np.zeros((len(lists), len(kernel.columns[cut])))
            np.add.at(votes, (row[own], state[own]), p[own])
            yield cut, np.unique(row[own]), votes


def mapped_spots(rows: DataFrame, kernel: Kernel) -> DataFrame:
    """``(k, obs_id, num, lnum, nn, ln, pp, lpp)`` of rows ``with_votes``: products of the spot with its
    prediction, and both squared norms; raw and log-normalised."""
    sent = rows.sparkSession.sparkContext.broadcast(kernel)
    kind = rows.schema["obs_id"].dataType.simpleString()
    names = ["k", "obs_id", "num", "lnum", "nn", "ln", "pp", "lpp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = sent.value
        grams = [(s.T @ s) for s in (kernel.raw, kernel.log)]
        for block in blocks(batches, kernel):
            ids = block.part.column("obs_id")
            for k, there, votes in vote_matrices(block, kernel):
                at = kernel.columns[k]
                spread = votes[there] * kernel.weight[at] @ kernel.member[:, at].T  # weights of the clusters
                num, lnum = ((votes[there] * d[there][:, at]).sum(1) for d in (block.dot, block.ldot))
                pp, lpp = ((spread @ g * spread).sum(1) for g in grams)
                values = (num, lnum, block.nn[there], block.ln[there], pp, lpp)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), k, np.int32)), ids.take(pa.array(there)), *(pa.array(v) for v in values)], names=names)

    return rows.mapInArrow(run, f"k int, obs_id {kind}, num double, lnum double, nn double, ln double, pp double, lpp double")


def mapped_features(rows: DataFrame, kernel: Kernel) -> DataFrame:
    """``(k, draw, feature, num, lnum, pp, lpp)`` of rows ``with_votes``: the same, added up over spots
    per feature; ``draw`` is 0."""
    sent = rows.sparkSession.sparkContext.broadcast(kernel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = sent.value
        # Two numbers per state and feature, and per pair of states of a K.
        sums: dict[int, list[np.ndarray]] = {}
        for block in blocks(batches, kernel):
            for k, _, votes in vote_matrices(block, kernel):
                own = sums.setdefault(k, [0.0, 0.0, 0.0])
                for i, part in enumerate((votes.T @ block.x, votes.T @ block.lx, votes.T @ votes)):
                    own[i] = own[i] + part
        out = FeatureSums(kernel)
        for k, columns in kernel.columns.items():
            if k not in sums:  # a K without any vote still has its features
                out.total[k, 0] = np.zeros((4, len(kernel.features)))
                continue
            x, lx, pairs = sums[k]
            m, ml = (profile[columns] for profile in (out.m, out.ml))
            out.total[k, 0] = np.stack([(x * m).sum(0), (lx * ml).sum(0), (pairs @ m * m).sum(0), (pairs @ ml * ml).sum(0)])
        yield from out.batches()

    return _named(rows.mapInArrow(run, FEATURE_SUMS), kernel)


def cosine(dot: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Plain cosine from sums; 0 when a norm is 0, clipped to [-1, 1]."""
    den = np.sqrt(left) * np.sqrt(right)
    return np.clip(np.divide(dot, den, out=np.zeros_like(den), where=den != 0), -1.0, 1.0)


def shuffled(rows: DataFrame, kernel: Kernel, counts: dict[int, list[int]], n_perm: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Reconstruction with shuffled labels, of ``spot_rows`` that carry the spot's number ``i``:
    ``(k, draw, value)``, a raw cosine per spot, and the feature sums of every draw."""
    shuffles = {k: LabelShuffle.from_counts(own, seed) for k, own in counts.items()}
    sent = rows.sparkSession.sparkContext.broadcast((kernel, shuffles))

    def labels(batches: Iterator[pa.RecordBatch], draws: range) -> Iterator[tuple[Block, int, int, np.ndarray]]:
        kernel, shuffles = sent.value
        for block in blocks(batches, kernel):
            i = block.part.column("i").to_numpy()
            for draw in draws:
                place = None
                for k, shuffle in shuffles.items():
                    # The permutation is the same for every K; only the label counts differ.
                    place = shuffle.places(i, draw) if place is None else place
                    yield block, k, draw, shuffle.at(place)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = sent.value[0]
        for block, k, draw, state in labels(batches, range(n_perm)):
            node = kernel.columns[k][state]
            value = cosine(block.dot[np.arange(len(node)), node], block.nn, kernel.mm[node])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), v, np.int32)) for v in (k, draw)] + [pa.array(value)], names=["k", "draw", "value"])

    def genes(draws: range):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = FeatureSums(sent.value[0])
            for block, k, draw, state in labels(batches, draws):
                sums.add(block, k, state, draw)
            yield from sums.batches()

        return rows.mapInArrow(run, FEATURE_SUMS)

    # A pass over the spots for as many draws as a task can add up together.
    step = max(1, KERNEL_NUMBERS // (4 * max(1, len(kernel.features) * len(counts))))
    parts = [genes(range(low, min(n_perm, low + step))) for low in range(0, n_perm, step)]
    summed = parts[0]
    for part in parts[1:]:
        summed = summed.unionByName(part)
    return rows.mapInArrow(spots, "k int, draw int, value double"), _named(summed, kernel)
