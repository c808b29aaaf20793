"""Local moving of graph nodes between communities, by messages between parts of the graph.

Nodes are dealt to parts by their number, each with its edges, once. A part remembers the
labels of its nodes and of their neighbours and the volumes of these communities; the part of a
community's number remembers its volume and which parts need it. A round moves only what it
changes: new labels go along the edges, weights that came or went to the parts of the
communities' numbers, and changed volumes back. These are two shuffles, as large as the moves
are many. Every ``KEPT_ROUNDS`` rounds the labels alone are written, and everything else is made anew
from them. Sums of changes are exact for whole numbers, as counted edges are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from spotweave.operators.knn import _pack, _unpack
from spotweave.session import checkpoint_folder, cut_lineage

PART_EDGES = 1 << 20  # directed edges of a part, at most on average
LEAST_EDGES = 1 << 14  # a part of fewer edges costs more to run than its work
ROUNDS = 5  # of one job, while each of them moves some nodes
KEPT_ROUNDS = 30  # between two cuts of the lineage
AHEAD = 4096  # rounds looked ahead for a turn of a node that would gain
SAVED = StorageLevel.MEMORY_AND_DISK
_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def hash_int(seed: np.ndarray, value: int) -> np.ndarray:
    """Spark's ``xxhash64(x, value)`` from ``seed``, the hashes of x; ``value`` is an int."""
    with np.errstate(over="ignore"):
        h = (seed.astype(np.int64).view(np.uint64) + _P5 + np.uint64(4)) ^ (np.uint64(value) * _P1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def _dealt(df: DataFrame, kind: str, parts: int) -> RDD:
    """``(part, (kind, block))``: rows of ``df`` as Arrow streams, dealt by ``v`` modulo ``parts``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("v").to_numpy() % parts
            order = np.argsort(part, kind="stable")
            there, first = np.unique(part[order], return_index=True)
            for p, rows in zip(there, np.split(order, first[1:])):
                for block in _pack(iter([batch.take(pa.array(rows))])):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), block.column("block")], names=["part", "block"])

    blocks = df.mapInArrow(split, "part int, block binary").rdd
    return blocks.map(lambda row: (row["part"], (kind, row["block"]))).partitionBy(parts)


def _column(blocks: list[bytes], name: str, kind: type) -> np.ndarray:
    parts = [_unpack(block).column(name).to_numpy() for block in blocks]
    return np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)


def _gathered(records: Iterator[tuple]) -> tuple[int | None, dict[str, list]]:
    """The part of a partition and its records by kind."""
    part, out = None, {}
    for part, (kind, value) in records:
        out.setdefault(kind, []).append(value)
    return part, out


def _links(parts: int):
    """Blocks of a part as arrays: its nodes, its edges by row and by place among the far ends,
    and whom to tell of which nodes."""

    def build(records: Iterator[tuple]) -> Iterator[tuple]:
        part, found = _gathered(records)
        if part is None:
            return
        nodes, edges = found.get("nodes", []), found.get("edges", [])
        own = _column(nodes, "v", np.int64)
        order = np.argsort(own)
        own = own[order]
        far, inverse = np.unique(_column(edges, "u", np.int64), return_inverse=True)
        row = np.searchsorted(own, _column(edges, "v", np.int64))
        # Messages come in the order of the parts, and within a message in that of the nodes.
        by_part = np.argsort(far % parts, kind="stable")
        place = np.empty(len(far), np.int64)
        place[by_part] = np.arange(len(far))
        told = np.unique((far % parts)[inverse] * max(1, len(own)) + row)
        to, who = np.divmod(told, max(1, len(own)))
        there, first = np.unique(to, return_index=True)
        links = {
            "own": own,
            "deg": _column(nodes, "deg", np.float64)[order],
            "hash": _column(nodes, "h", np.int64)[order],
            "row": row,
            "col": place[inverse],
            "w": _column(edges, "w", np.float64),
            "n_far": len(far),
            "first": np.searchsorted(np.sort(far % parts), np.arange(parts)),  # place of each part's message
            "tell": list(zip(there.tolist(), np.split(who, first[1:]))) if len(to) else [],
        }
        yield part, ("links", links)

    return build


def _share(step: int) -> int:
    """One of so many nodes has its turn in a round."""
    return 2 + step // 12


def next_turn(codes: np.ndarray, step: int) -> int:
    """The first round from ``step`` on, of the next ``AHEAD``, in which one of the nodes has its turn."""
    last = step + AHEAD
    if not len(codes):
        return last
    return next((s for s in range(step, last) if (hash_int(codes, s) % _share(s) == 0).any()), last)


def _messages(part: int, links: dict, label: np.ndarray, code: np.ndarray, moved: np.ndarray, old: np.ndarray, parts: int) -> list[tuple]:
    """What a part sends after the nodes ``moved`` got their labels: these to the parts of their
    neighbours, and to the parts of the communities' numbers what came and what left (``old``)
    and which parts need their volumes from now on."""
    out, needs = [], [(part, np.unique(label[moved]))]
    goes = np.zeros(len(label), dtype=bool)
    goes[moved] = True
    for q, who in links["tell"]:
        at = np.flatnonzero(goes[who])
        if len(at):
            who = who[at]
            out.append((q, ("told", (part, at, label[who], code[who]))))
            needs.append((q, np.unique(label[who])))
    deg = links["deg"][moved]
    there, at = np.unique(np.concatenate([label[moved], old]), return_inverse=True)
    weight = np.bincount(at, np.concatenate([deg, -deg[: len(old)]]), len(there))
    who = np.concatenate([np.full(len(names), q) for q, names in needs])
    what = np.concatenate([names for _, names in needs])
    for home in np.unique(there % parts).tolist():
        held, asked = there % parts == home, what % parts == home
        out.append((home, ("weight", (there[held], weight[held], what[asked] * parts + who[asked]))))
    return out


def _out(records: Iterator[tuple]) -> Iterator[tuple]:
    for _, (_, state) in records:
        yield from state["out"]


def _start(parts: int):
    """A part's state from the labels of its nodes, at first a community for each; all of it is news."""

    def run(records: Iterator[tuple]) -> Iterator[tuple]:
        part, found = _gathered(records)
        if part is None:
            return
        links = found["links"][0]
        label, code = found["labels"][0] if "labels" in found else (links["own"], links["hash"])
        none = np.empty(0, np.int64)
        yield part, ("state", {
            "label": label, "code": code, "near": np.full(links["n_far"], -1, np.int64), "near_code": np.zeros(links["n_far"], np.int64),
            "known": none, "volume": none.astype(np.float64), "report": (0, 0, 0),
            "out": _messages(part, links, label, code, np.arange(len(label)), none, parts),
        })

    return run


def _homes(parts: int):
    """Volumes of the communities of a part's numbers, and the parts that need them: each is sent
    those that changed and those it needs newly."""

    def run(records: Iterator[tuple]) -> Iterator[tuple]:
        part, found = _gathered(records)
        if part is None:
            return
        none = np.empty(0, np.int64)
        held, volume, needed = found["home"][0]["held"] if "home" in found else (none, none.astype(np.float64), none)
        out, news = [], found.get("weight", [])
        if news:
            changed, asked = (np.unique(np.concatenate([n[i] for n in news])) for i in (0, 2))
            all_, at = np.unique(np.concatenate([held, *(n[0] for n in news)]), return_inverse=True)
            volume = np.bincount(at, np.concatenate([volume, *(n[1] for n in news)]), len(all_))
            new = np.setdiff1d(asked, needed, assume_unique=True)
            needed, held = np.union1d(needed, new), all_
            # A community's pairs with parts lie together.
            first, stop = np.searchsorted(needed, changed * parts), np.searchsorted(needed, (changed + 1) * parts)
            n = stop - first
            place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            names, who = np.divmod(np.union1d(needed[place], new), parts)
            for q in np.unique(who).tolist():
                mine = names[who == q]
                out.append((q, ("volume", (mine, volume[np.searchsorted(held, mine)]))))
        yield part, ("home", {"held": (held, volume, needed), "out": out})

    return run


def best_moves(links: dict, label: np.ndarray, near: np.ndarray, code: np.ndarray, known: np.ndarray, known_volume: np.ndarray, step: int, resolution: float, total: float, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, label, hash)`` of the nodes that move in this round, and which would gain by a move.
    ``near`` and ``code`` are labels and hashes of the neighbours, ``known`` ascends."""
    deg, n = links["deg"], len(links["own"])
    volume = known_volume[np.searchsorted(known, label)]
    stay = -resolution * deg * (volume - deg) / (2.0 * total)  # alone, without an edge to its community
    if not len(links["row"]):
        none = np.empty(0, np.int64)
        return none, none, none, np.zeros(n, dtype=bool)
    if (near < 0).any():
        raise RuntimeError("labels of some neighbours did not arrive")
    far_volume = known_volume[np.searchsorted(known, near)]
    row, col = links["row"], links["col"]
    order = np.lexsort((near[col], row))
    row, col = row[order], col[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(near[col]) != 0)]))
    w = np.add.reduceat(links["w"][order], first)
    row, col = row[first], col[first]
    own = near[col] == label[row]
    # Gain of belonging to the community, with the node itself taken out of it.
    gain = w - resolution * deg[row] * (far_volume[col] - np.where(own, deg[row], 0.0)) / (2.0 * total)
    stay[row[own]] = gain[own]
    most = np.full(n, -np.inf)
    np.maximum.at(most, row, gain)
    better = most > stay + tolerance
    # The greatest rounded gain; ties go to the smallest hash.
    order = np.lexsort((code[col], -np.round(gain, 9), row))
    row, col = row[order], col[order]
    head = np.concatenate([[True], np.diff(row) != 0])
    row, col = row[head], col[head]
    goes = (better & (hash_int(links["hash"], step) % _share(step) == 0))[row]
    return row[goes], near[col[goes]], code[col[goes]], better


def _move(step: int, resolution: float, total: float, tolerance: float, parts: int):
    def run(records: Iterator[tuple]) -> Iterator[tuple]:
        part, found = _gathered(records)
        if part is None or "links" not in found:
            return
        links, state = found["links"][0], found["state"][0]
        near, near_code = state["near"].copy(), state["near_code"].copy()
        for p, at, told, told_code in found.get("told", []):
            near[links["first"][p] + at], near_code[links["first"][p] + at] = told, told_code
        volumes = [*found.get("volume", []), (state["known"], state["volume"])]  # of a name's volumes the first holds
        known, first = np.unique(np.concatenate([v[0] for v in volumes]), return_index=True)
        volume = np.concatenate([v[1] for v in volumes])[first]
        label, code = state["label"], state["code"]
        row, to, to_code, better = best_moves(links, label, near, near_code, known, volume, step, resolution, total, tolerance)
        old, label, code = label[row], label.copy(), code.copy()
        label[row], code[row] = to, to_code
        report = (int(better.sum()), len(row), next_turn(links["hash"][better], step + 1))
        out = _messages(part, links, label, code, row, old, parts) if len(row) else []
        yield part, ("state", {"label": label, "code": code, "near": near, "near_code": near_code, "known": known, "volume": volume, "report": report, "out": out})

    return run


def _reports(records: Iterator[tuple]) -> Iterator[tuple]:
    for _, (_, state) in records:
        yield state["report"]


def _labels(records: Iterator[tuple]) -> Iterator[tuple]:
    for part, (_, state) in records:
        yield part, ("labels", (state["label"], state["code"]))


def _labelled(records: Iterator[tuple]) -> Iterator[tuple]:
    _, found = _gathered(records)
    if found:
        out = pa.RecordBatch.from_arrays([pa.array(found["links"][0]["own"]), pa.array(found["state"][0]["label"])], names=["v", "label"])
        for block in _pack(iter([out])):
            yield (block.column("block")[0].as_py(),)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column("block"):
            yield from _unpack(block.as_py()).to_batches()


def local_moves(edges: DataFrame, nodes: DataFrame, resolution: float, total: float, tolerance: float) -> DataFrame:
    """``(v, label)`` after moving nodes to the neighbouring community with the best
    modularity gain, until no node would gain more than ``tolerance`` by a move.

    ``edges(u, v, w)`` holds both directions without loops, ``nodes(v, deg, h)`` the
    weighted degrees and a hash of each node; u and v are numbers from 0. A round moves a share
    of the nodes picked by hash, at first a half and later fewer, so that neighbours which keep
    swapping come apart.
    """
    spark = edges.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_folder(spark))
    n_edges = edges.count()
    parts = max(1, math.ceil(n_edges / PART_EDGES), min(context.defaultParallelism, math.ceil(n_edges / LEAST_EDGES)))
    dealt = context.union([_dealt(nodes.select("v", "deg", "h"), "nodes", parts), _dealt(edges.select("u", "v", "w"), "edges", parts)])
    links = dealt.mapPartitions(_links(parts), preservesPartitioning=True).persist(SAVED)
    state, home, held = links.mapPartitions(_start(parts), preservesPartitioning=True).persist(SAVED), None, []
    step = run = 0
    gaining = nodes.count()
    while True:
        for _ in range(ROUNDS if gaining >= _share(step) else 1):
            held += [state, *([home] if home else [])]
            # What lies with its part stays there: only messages are shuffled.
            sent = state.mapPartitions(_out).partitionBy(parts)
            home = (context.union([home, sent]) if home else sent).mapPartitions(_homes(parts), preservesPartitioning=True).persist(SAVED)
            volumes = home.mapPartitions(_out).partitionBy(parts)
            step_ = _move(step, resolution, total, tolerance, parts)
            state = context.union([links, state, sent, volumes]).mapPartitions(step_, preservesPartitioning=True).persist(SAVED)
            step += 1
            run += 1
        # Three numbers a part, of the last of these rounds. Once no node gains, rounds change nothing.
        reports = state.mapPartitions(_reports).collect()
        for old in held:
            old.unpersist()
        held = []
        gaining, moved = (sum(r[i] for r in reports) for i in (0, 1))
        if not gaining:
            break
        if not moved:  # nor will any node move before one that gains has its turn
            step = min(r[2] for r in reports)
        if run >= KEPT_ROUNDS:
            labels = state.mapPartitions(_labels, preservesPartitioning=True)
            labels.checkpoint()
            labels.count()
            held, run = [state, home], 0
            state, home = context.union([links, labels]).mapPartitions(_start(parts), preservesPartitioning=True).persist(SAVED), None
    blocks = spark.createDataFrame(context.union([links, state]).mapPartitions(_labelled), "block binary", verifySchema=False)
    out = cut_lineage(blocks.mapInArrow(_rows, "v bigint, label bigint"))
    for old in (links, state, home):
        old.unpersist()
    return out
