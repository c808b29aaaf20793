"""Graphs over matrix rows: neighbour graph, modularity, community search.

Edges are DataFrames; iterations over them are DataFrame joins whose lineage is cut by a
write to shared storage, but for the moves between communities (see ``moves``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from spotweave.functions.indexing import ordered_index
from spotweave.operators import components
from spotweave.operators.knn import knn_join
from spotweave.operators.moves import local_moves
from spotweave.session import cut_lineage

MAX_COMPONENTS = 30
GRAPH_NEIGHBOURS = 15  # counts the row itself, as the usual neighbour search does
RESOLUTION = 3.0
# Modularity gain (in edge weight) below which a move is not made.
TOLERANCE = 1e-9


def principal_components(vectors: DataFrame, limit: int = MAX_COMPONENTS) -> DataFrame:
    """``(obs_id, vec)`` in min(limit, rows - 1, columns - 1) components."""
    return components.principal_components(vectors, limit)


def neighbour_edges(vectors: DataFrame, n_neighbours: int = GRAPH_NEIGHBOURS, metric: str = "euclidean") -> DataFrame:
    """``(src, dst)``: directed edges to the nearest other rows."""
    return knn_join(vectors, vectors, n_neighbours - 1, metric=metric, self_join=True).select(
        F.col("obs_id").alias("src"), F.col("nbr").alias("dst")
    )


def simple_graph(edges: DataFrame) -> DataFrame:
    """``(a, b)``: undirected, no loops, every edge once."""
    return (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .distinct()
    )


def contact_counts(graph: DataFrame, start: DataFrame) -> DataFrame:
    """``(c1, c2, e)``: edges between start clusters, c1 <= c2.

    The only pass over the edges: every cut's modularity is a roll-up of these rows.
    """
    lab = start.select("obs_id", "c")
    return (
        graph.join(lab.select(F.col("obs_id").alias("a"), F.col("c").alias("ca")), "a")
        .join(lab.select(F.col("obs_id").alias("b"), F.col("c").alias("cb")), "b")
        .groupBy(F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2"))
        .agg(F.count(F.lit(1)).alias("e"))
    )


def _modularity(pairs: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``(k, modularity)`` from ``(k, s, t, e)`` edge counts; NULL without an edge."""
    pairs = cut_lineage(pairs)  # read twice; behind it lies the search of the neighbours
    m = pairs.groupBy("k").agg(F.sum("e").cast("double").alias("m"))
    ends = pairs.select(
        "k",
        F.explode(
            F.array(
                F.struct(F.col("s").alias("state"), F.col("e").alias("deg"), F.when(F.col("s") == F.col("t"), F.col("e")).otherwise(F.lit(0)).alias("inner")),
                F.struct(F.col("t").alias("state"), F.col("e").alias("deg"), F.lit(0).cast("bigint").alias("inner")),
            )
        ).alias("x"),
    ).select("k", "x.state", "x.deg", "x.inner")
    per = ends.groupBy("k", "state").agg(
        F.sum("deg").cast("double").alias("deg"), F.sum("inner").cast("double").alias("inner")
    )
    share = F.try_divide(F.col("deg"), 2.0 * F.col("m"))
    return (
        per.join(m, "k")
        .groupBy("k")
        .agg(F.sum(F.try_divide(F.col("inner"), F.col("m")) - F.lit(resolution) * share * share).alias("modularity"))
    )


def modularity_of_cuts(contacts: DataFrame, cut: DataFrame) -> DataFrame:
    """``(k, modularity)`` of every cut from the contacts of the start clusters."""
    pairs = (
        contacts.join(cut.select("k", F.col("c").alias("c1"), F.col("state").alias("s")), "c1")
        .join(cut.select("k", F.col("c").alias("c2"), F.col("state").alias("t")), ["k", "c2"])
        .groupBy("k", F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"))
        .agg(F.sum("e").alias("e"))
    )
    return _modularity(pairs)


def modularity_of_labels(graph: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(k, modularity)`` of labels that differ from cut to cut per row.

    Rows carry their labels as one array, so the edges are joined twice in total.
    """
    packed = assigned.groupBy("obs_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "state"))).alias("ls")
    )
    pairs = (
        graph.join(packed.select(F.col("obs_id").alias("a"), F.col("ls").alias("la")), "a")
        .join(packed.select(F.col("obs_id").alias("b"), F.col("ls").alias("lb")), "b")
        .select(F.explode(F.arrays_zip("la", "lb")).alias("e"))
        .select(F.col("e.la.k").alias("k"), F.col("e.la.state").alias("u"), F.col("e.lb.state").alias("v"))
        .groupBy("k", F.least("u", "v").alias("s"), F.greatest("u", "v").alias("t"))
        .agg(F.count(F.lit(1)).alias("e"))
    )
    return _modularity(pairs)


def _connected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Splits communities that fell apart: the smallest id reachable inside each."""
    inside = (
        edges.join(labels.select(F.col("v").alias("u"), F.col("label").alias("lu")), "u")
        .join(labels.select("v", F.col("label").alias("lv")), "v")
        .where(F.col("lu") == F.col("lv"))
        .select("u", "v")
    )
    inside = cut_lineage(inside)
    root = cut_lineage(labels.select("v", F.col("v").alias("root")))
    while True:
        spread = (
            inside.join(root.select(F.col("v").alias("u"), F.col("root").alias("r")), "u")
            .groupBy("v")
            .agg(F.min("r").alias("r"))
        )
        step = root.join(spread, "v", "left").select("v", F.least("root", F.coalesce("r", "root")).alias("root"), F.col("root").alias("old"))
        # Pointer jump: take the root of the root, halving the remaining distance.
        jump = step.join(step.select(F.col("v").alias("root"), F.col("root").alias("far")), "root", "left")
        saved = cut_lineage(jump.select("v", F.least("root", F.coalesce("far", "root")).alias("root"), "old"))
        moved = saved.where(F.col("root") < F.col("old")).limit(1).count()
        root = saved.select("v", "root")
        if not moved:
            return root.select("v", F.col("root").alias("label"))


def communities(
    edges: DataFrame,
    resolution: float = RESOLUTION,
    vertices: DataFrame | None = None,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``(obs_id, c, name)``: communities of a graph by modularity, numbered by size.

    Local moving and aggregation in the manner of the Leiden method: each level
    moves nodes, splits communities that are not connected, and merges the rest into
    the nodes of the next level, until nothing moves and nothing merges. Deterministic; labels are not those of another
    implementation. ``vertices(obs_id)`` adds rows without an edge.
    """
    graph = cut_lineage(simple_graph(edges))
    both = graph.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        graph.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    current = cut_lineage(both.withColumn("w", F.lit(1.0)))
    nodes = current.groupBy("v").agg(F.sum("w").alias("deg"))
    if vertices is not None:
        nodes = vertices.select(F.col("obs_id").alias("v")).distinct().join(nodes, "v", "left").na.fill(0.0, ["deg"])
    # Numbers in the order of the ids stand for them from here on.
    named = cut_lineage(ordered_index(nodes.where(F.col("v").isNotNull()), ["v"]))
    total = (current.agg(F.sum("w")).first()[0] or 0.0) / 2.0
    member = named.select(F.col("i").alias("obs_id"), F.col("i").alias("c"))
    if total > 0:
        nodes = named.select(F.col("i").alias("v"), "deg", F.xxhash64("v").alias("h"))
        current = cut_lineage(
            current.join(named.select(F.col("v").alias("u"), F.col("i").alias("iu")), "u")
            .join(named.select("v", F.col("i").alias("iv")), "v")
            .select(F.col("iu").alias("u"), F.col("iv").alias("v"), "w")
        )
        while True:
            moved = local_moves(current, nodes, resolution, total, tolerance)
            joined = cut_lineage(_connected(current, moved))
            member = cut_lineage(
                member.join(joined.select(F.col("v").alias("c"), "label"), "c").select(
                    "obs_id", F.col("label").alias("c")
                )
            )
            before = nodes.count()
            # A community is named by one of its nodes, and has its hash.
            nodes = cut_lineage(
                nodes.join(joined, "v")
                .groupBy("label")
                .agg(F.sum("deg").alias("deg"), F.max(F.when(F.col("v") == F.col("label"), F.col("h"))).alias("h"))
                .withColumnRenamed("label", "v")
            )
            current = cut_lineage(
                current.join(joined.select(F.col("v").alias("u"), F.col("label").alias("lu")), "u")
                .join(joined.withColumnRenamed("label", "lv"), "v")
                .where(F.col("lu") != F.col("lv"))
                .groupBy(F.col("lu").alias("u"), F.col("lv").alias("v"))
                .agg(F.sum("w").alias("w"))
            )
            if nodes.count() == before or current.isEmpty():
                break
    sizes = member.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    # One row per community reaches this window.
    codes = sizes.withColumn("code", (F.row_number().over(W.orderBy(F.desc("n"), "c")) - 1).cast("int"))
    member = member.join(named.select(F.col("i").alias("obs_id"), F.col("v").alias("name")), "obs_id")
    return member.join(codes, "c").select(
        F.col("name").alias("obs_id"), F.col("code").alias("c"), F.concat(F.lit("cluster_"), F.col("code")).alias("name")
    )


def place_centroids(
    layout: DataFrame, vectors: DataFrame, states: DataFrame, n_neighbours: int = 15
) -> DataFrame:
    """``(k, state, u, v)``: mean layout of the cells nearest to each state centroid.

    ``states(k, obs_id, state)``; the centroid is the mean vector of a state's cells.
    """
    cells = vectors.join(states, "obs_id")
    per_dim = (
        cells.select("k", "state", F.posexplode("vec").alias("d", "x"))
        .groupBy("k", "state", "d")
        .agg(F.avg("x").alias("x"))
        .groupBy("k", "state")
        .agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("e"))
        .select(F.struct("k", "state").alias("obs_id"), F.col("e.x").alias("vec"))
    )
    near = knn_join(
        per_dim.select(F.to_json("obs_id").alias("obs_id"), "vec"), vectors, n_neighbours, metric="euclidean"
    )
    return (
        near.join(layout.select(F.col("obs_id").alias("nbr"), "u", "v"), "nbr")
        .groupBy("obs_id")
        .agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
        .select(F.from_json("obs_id", "k int, state int").alias("s"), "u", "v")
        .select("s.k", "s.state", "u", "v")
    )
