"""Queries on neighbour joins, adaptive votes, graphs and spatial metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.functions.indexing import ordered_index
from spotweave.functions.scalars import guarded_cosine
from spotweave.operators import allcuts, clusters, graph, knn, nearest, prep, quality, reconstruct, spatial, tree, wann
from spotweave.operators.reindex import reindex_fill
from spotweave.plans.base import TablePair, r6
from spotweave.plans.registry import query
from spotweave.plans.sql import define, r6 as s6, with_ctes
from spotweave.session import cut_lineage
from spotweave.sources import tables

_SIM = "list_dot_product(a.v, b.v) / (a.n * b.n)"
define(
    "emb_ref_nn",
    ["ref"],
    f"""SELECT a.obs_id, b.obs_id AS nbr, {_SIM} AS score,
        row_number() OVER (PARTITION BY a.obs_id ORDER BY round({_SIM}, 9) DESC, b.obs_id) AS rank
    FROM ref a CROSS JOIN ref b WHERE a.obs_id <> b.obs_id QUALIFY rank <= 51""",
)
define(
    "emb_qry_nn",
    ["ref", "qry"],
    f"""SELECT a.obs_id, b.obs_id AS nbr, {_SIM} AS score,
        row_number() OVER (PARTITION BY a.obs_id ORDER BY round({_SIM}, 9) DESC, b.obs_id) AS rank
    FROM qry a CROSS JOIN ref b QUALIFY rank <= 51""",
)
# Cuts of the ten labels by rule, k = 1..10.
define("emb_cut", [], "SELECT CAST(k AS INTEGER) AS k, CAST(c AS INTEGER) AS c, CAST(c % k AS INTEGER) AS state FROM unnest(range(1, 11)) t(k), (SELECT DISTINCT label AS c FROM embeddings)")
define(
    "emb_tally",
    ["emb_ref_nn", "ref", "emb_cut"],
    """SELECT k, e.obs_id, s.state, g.kp, SUM(1 + 1e-4 * (51 - (e.rank - 1))) AS t
    FROM emb_ref_nn e JOIN ref b ON b.obs_id = e.nbr JOIN emb_cut s ON s.c = b.c
    JOIN (SELECT unnest(range(11, 52, 2)) AS kp) g ON e.rank <= g.kp GROUP BY ALL""",
)
define(
    "emb_size",
    ["emb_tally", "ref", "emb_cut"],
    """SELECT k, obs_id, CAST(COALESCE(min(CASE WHEN pred = own THEN kp END), 51) AS INTEGER) AS size FROM (
        SELECT t.k, t.obs_id, kp, any_value(o.state) AS own, arg_min(t.state, (-round(t, 9), t.state)) AS pred
        FROM emb_tally t JOIN ref r ON r.obs_id = t.obs_id JOIN emb_cut o ON o.k = t.k AND o.c = r.c
        GROUP BY t.k, t.obs_id, kp) GROUP BY k, obs_id""",
)
define(
    "emb_vote",
    ["emb_qry_nn", "emb_size", "ref", "emb_cut"],
    """SELECT k, obs_id, state, w / SUM(w) OVER (PARTITION BY k, obs_id) AS p FROM (
        SELECT e.k, q.obs_id, s.state, SUM(1.0 / e.size) AS w
        FROM emb_qry_nn q JOIN emb_size e ON e.obs_id = q.nbr
        JOIN ref r ON r.obs_id = q.nbr JOIN emb_cut s ON s.k = e.k AND s.c = r.c
        JOIN emb_qry_nn q1 ON q1.obs_id = q.obs_id AND q1.rank = 1
        JOIN emb_size e1 ON e1.obs_id = q1.nbr AND e1.k = e.k
        WHERE q.rank <= e1.size GROUP BY e.k, q.obs_id, s.state)""",
)
define(
    "emb_onehot",
    ["emb_vote"],
    """SELECT k, obs_id, max(p) AS max_prob,
        CASE WHEN k > 1 THEN (1 - SUM(p * p)) / (1 - 1.0 / k) ELSE 0 END AS gini_impurity,
        CASE WHEN k > 1 THEN -SUM(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(k) ELSE 0 END AS entropy
    FROM emb_vote GROUP BY k, obs_id""",
)
define(
    "emb_conf",
    ["emb_vote"],
    """SELECT k, obs_id, CASE WHEN k = 1 THEN 1.0 ELSE greatest(0.0, least(1.0,
        1 + SUM(p * ln(p + 1e-12)) / ln(k))) END AS confidence FROM emb_vote GROUP BY k, obs_id""",
)


class Vectors:
    """Embeddings both as the labelled reference and as the queries, all of them.

    As a query a vector may find itself; in the reference's own lists it may not.
    """

    def __init__(self, spark: SparkSession, sf: str):
        rows = tables.embedding_vectors(spark, sf)
        self.all = self.ref = self.qry = rows
        self.start = self.ref.select("obs_id", "c")

    def labels(self) -> dict[int, np.ndarray]:
        n = self.all.agg(F.max("c")).first()[0] + 1
        return {k: np.arange(n) % k for k in range(1, n + 1)}

    def ref_neighbours(self) -> DataFrame:
        return knn.knn_join(self.ref, self.ref, wann.K_MAX, self_join=True)

    def query_neighbours(self) -> DataFrame:
        return knn.knn_join(self.qry, self.ref, wann.K_MAX)

    def sizes(self, labels: dict[int, np.ndarray]) -> tuple[DataFrame, list[int]]:
        grid = wann.reliability_grid(self.ref.count())
        return wann.reliability(self.ref_neighbours(), self.start, labels, grid), grid

    def vote(self) -> DataFrame:
        labels = self.labels()
        found, grid = self.sizes(labels)
        return wann.adaptive_vote(self.query_neighbours(), found, labels, grid)


@query("knn_ref", with_ctes(f"SELECT obs_id, nbr, CAST(rank AS INTEGER) AS rank, {s6('score')} AS score FROM emb_ref_nn", "emb_ref_nn"))
def knn_ref(spark: SparkSession, sf: str) -> DataFrame:
    return Vectors(spark, sf).ref_neighbours().select("obs_id", "nbr", "rank", r6("score").alias("score"))


@query("knn_query", with_ctes(f"SELECT obs_id, nbr, CAST(rank AS INTEGER) AS rank, {s6('score')} AS score FROM emb_qry_nn", "emb_qry_nn"))
def knn_query(spark: SparkSession, sf: str) -> DataFrame:
    return Vectors(spark, sf).query_neighbours().select("obs_id", "nbr", "rank", r6("score").alias("score"))


@query("reliability", with_ctes(f"SELECT k, obs_id, size, {s6('1.0 / size')} AS eta FROM emb_size", "emb_size"))
def reliability(spark: SparkSession, sf: str) -> DataFrame:
    v = Vectors(spark, sf)
    labels = v.labels()
    found, _ = v.sizes(labels)
    return wann.explode_sizes(found, list(labels)).select("k", "obs_id", "size", r6("eta").alias("eta"))


@query("wann_vote", with_ctes(f"SELECT k, obs_id, state, {s6('p')} AS p FROM emb_vote", "emb_vote"))
def wann_vote(spark: SparkSession, sf: str) -> DataFrame:
    return Vectors(spark, sf).vote().select("k", "obs_id", "state", r6("p").alias("p"))


@query(
    "wann_hard_labels",
    with_ctes(
        "SELECT k, obs_id, arg_min(state, (-round(p, 9), state)) AS state FROM emb_vote GROUP BY k, obs_id", "emb_vote"
    ),
)
def wann_hard_labels(spark: SparkSession, sf: str) -> DataFrame:
    vote = Vectors(spark, sf).vote().withColumn("p", F.round("p", 9))
    return nearest.hard_labels(vote)


@query("entropy_confidence", with_ctes(f"SELECT k, obs_id, {s6('confidence')} AS confidence FROM emb_conf", "emb_conf"))
def entropy_confidence(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.entropy_confidence(Vectors(spark, sf).vote())
    return out.select("k", "obs_id", r6("confidence").alias("confidence"))


@query(
    "onehot_per_row",
    with_ctes(
        f"SELECT k, obs_id, {s6('max_prob')} AS max_prob, {s6('gini_impurity')} AS gini_impurity, {s6('entropy')} AS entropy FROM emb_onehot",
        "emb_onehot",
    ),
)
def onehot_per_row(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.onehot_per_row(Vectors(spark, sf).vote())
    return out.select("k", "obs_id", *[r6(c).alias(c) for c in ("max_prob", "gini_impurity", "entropy")])


@query(
    "onehot_summary",
    with_ctes(
        "SELECT k, count(*) AS n_rows, k AS n_cols, "
        + ", ".join(
            f"{s6(f'avg({m})')} AS {m}_mean, {s6(f'median({m})')} AS {m}_median, {s6(f'stddev_pop({m})')} AS {m}_std"
            for m in ("max_prob", "gini_impurity", "entropy")
        )
        + ", "
        + ", ".join(
            f"{s6(f'avg(CAST(round(max_prob, 9) > {b} AS DOUBLE))')} AS frac_above_{n}"
            for b, n in (("0.5", "50"), ("0.9", "90"), ("0.99", "99"))
        )
        + " FROM emb_onehot GROUP BY k",
        "emb_onehot",
    ),
)
def onehot_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.onehot_per_row(Vectors(spark, sf).vote()).withColumn("max_prob", F.round("max_prob", 9))
    out = quality.onehot_summary(cut_lineage(rows))  # read by the means and by the medians
    plain = ("k", "n_rows", "n_cols")
    return out.select(*plain, *[r6(c).alias(c) for c in out.columns if c not in plain])


@query(
    "max_prob_histogram",
    with_ctes(
        f"""SELECT k, {s6('floor(round(v / width, 9)) * width')} AS low, {s6('width')} AS width, count(*) AS n
        FROM (SELECT k, round(max_prob, 9) AS v FROM emb_onehot) JOIN (
            SELECT k, CASE WHEN r < 1e-9 THEN 0.01 ELSE round(power(10.0, floor(log10(r / 40)))
                * (SELECT min(m) FROM (VALUES (1.0), (2.0), (5.0), (10.0)) t(m) WHERE m >= round(r / 40 / power(10.0, floor(log10(r / 40))), 9)), 12) END AS width
            FROM (SELECT k, max(round(max_prob, 9)) - min(round(max_prob, 9)) AS r FROM emb_onehot GROUP BY k)) USING (k)
        GROUP BY ALL""",
        "emb_onehot",
    ),
)
def max_prob_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.onehot_per_row(Vectors(spark, sf).vote()).withColumn("max_prob", F.round("max_prob", 9))
    out = quality.auto_histogram(cut_lineage(rows), ["k"], "max_prob")  # read by the widths and by the counts
    return out.select("k", r6("low").alias("low"), r6("width").alias("width"), "n")


@query(
    "confidence_summary",
    with_ctes(
        f"""SELECT k, count(*) AS n, {s6('avg(c)')} AS mean, {s6('median(c)')} AS median, {s6('min(c)')} AS min,
            {s6('max(c)')} AS max, {s6('stddev_pop(c)')} AS std,
            {s6('avg(CAST(c >= 0.5 AS DOUBLE))')} AS frac_at_least_50,
            {s6('avg(CAST(c >= 0.9 AS DOUBLE))')} AS frac_at_least_90
        FROM (SELECT k, round(confidence, 9) AS c FROM emb_conf) GROUP BY k""",
        "emb_conf",
    ),
)
def confidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    conf = quality.entropy_confidence(Vectors(spark, sf).vote()).withColumn("confidence", F.round("confidence", 9))
    out = quality.confidence_summary(cut_lineage(conf))  # read by the means and by the median
    return out.select("k", "n", *[r6(c).alias(c) for c in out.columns if c not in ("k", "n")])


@query(
    "reindex_fill",
    with_ctes(
        f"""SELECT q.obs_id, CAST(s.state AS INTEGER) AS state, {s6('COALESCE(v.p, 0)')} AS p
        FROM qry q CROSS JOIN (SELECT unnest(range(0, 10)) AS state) s
        LEFT JOIN emb_vote v ON v.k = 10 AND v.obs_id = q.obs_id AND v.state = s.state""",
        "qry",
        "emb_vote",
    ),
)
def reindex_fill_query(spark: SparkSession, sf: str) -> DataFrame:
    v = Vectors(spark, sf)
    top = max(v.labels())
    full = reindex_fill(v.vote().where(F.col("k") == top), v.qry, top)
    return full.select("obs_id", "state", r6("p").alias("p"))


# --- spatial graph of the suppliers -------------------------------------------------

define("edge_labels", ["spatial_edges", "nearest"], """SELECT a.k, a.state AS ls, b.state AS ld
    FROM spatial_edges e JOIN nearest a ON a.obs_id = e.src JOIN nearest b ON b.obs_id = e.dst AND b.k = a.k""")  # fmt: skip


@query("spatial_knn", with_ctes("SELECT src, dst FROM spatial_edges", "spatial_edges"))
def spatial_knn(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.spatial_graph(tables.supplier_rows(spark, sf))


@query(
    "local_purity",
    with_ctes(
        f"SELECT k, count(*) AS n_edges, {s6('avg(CAST(ls = ld AS DOUBLE))')} AS purity FROM edge_labels GROUP BY k",
        "edge_labels",
    ),
)
def local_purity(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    out = spatial.local_purity(spatial.spatial_graph(p.st_obs), p.rule_assignment)
    return out.select("k", "n_edges", r6("purity").alias("purity"))


@query(
    "within_state_edges",
    with_ctes(
        """SELECT a.k, a.state, COALESCE(e.n, 0) AS n FROM (SELECT DISTINCT k, state FROM nearest) a
        LEFT JOIN (SELECT k, ls AS state, count(*) AS n FROM edge_labels WHERE ls = ld GROUP BY k, ls) e USING (k, state)""",
        "edge_labels",
    ),
)
def within_state_edges(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    return spatial.within_state_edges(spatial.spatial_graph(p.st_obs), p.rule_assignment)


@query(
    "purity_expected",
    with_ctes(
        f"""SELECT k, {s6('SUM(n * (n - 1)) / (SUM(n) * (SUM(n) - 1))')} AS expected
        FROM (SELECT k, state, CAST(count(*) AS DOUBLE) AS n FROM nearest GROUP BY k, state) GROUP BY k""",
        "nearest",
    ),
)
def purity_expected(spark: SparkSession, sf: str) -> DataFrame:
    out = spatial.expected_purity(TablePair(spark, sf).rule_assignment)
    return out.select("k", r6("expected").alias("expected"))


define(
    "shuffled_edges",
    ["spatial_edges", "shuffled_labels"],
    """SELECT a.k, a.draw, a.state AS ls, count(*) AS edges, count(*) FILTER (WHERE a.state = b.state) AS n
        FROM spatial_edges e JOIN shuffled_labels a ON a.obs_id = e.src
        JOIN shuffled_labels b ON b.obs_id = e.dst AND b.k = a.k AND b.draw = a.draw
        GROUP BY a.k, a.draw, a.state""",
)


@query(
    "spatial_organisation",
    with_ctes(
        f"""SELECT o.k, {s6('o.value')} AS observed, p_value, {s6('(o.value - null_mean) / (null_std + 1e-12)')} AS z_score,
            {s6('null_mean')} AS null_mean, {s6('null_std')} AS null_std, n_states, {s6('mean_self_zscore')} AS mean_self_zscore,
            (SELECT count(*) FROM st_obs) AS n_spots, 6 AS n_neighbours, 100 AS n_perm
        FROM (SELECT k, SUM(CAST(ls = ld AS BIGINT))::DOUBLE / count(*) AS value FROM edge_labels GROUP BY k) o
        JOIN (SELECT q.k, avg(CAST(q.value >= o.value AS DOUBLE)) AS p_value, avg(q.value) AS null_mean, stddev_pop(q.value) AS null_std
              FROM (SELECT k, draw, SUM(n)::DOUBLE / SUM(edges) AS value FROM shuffled_edges GROUP BY k, draw) q
              JOIN (SELECT k, SUM(CAST(ls = ld AS BIGINT))::DOUBLE / count(*) AS value FROM edge_labels GROUP BY k) o USING (k)
              GROUP BY q.k) t USING (k)
        JOIN (SELECT k, count(*) AS n_states, CASE WHEN count(*) >= 2 THEN avg(CASE WHEN std > 0 THEN (n - mean) / std END) END AS mean_self_zscore
              FROM (SELECT a.k, a.state, COALESCE(e.n, 0) AS n FROM (SELECT DISTINCT k, state FROM nearest) a
                    LEFT JOIN (SELECT k, ls AS state, count(*) AS n FROM edge_labels WHERE ls = ld GROUP BY k, ls) e USING (k, state))
              JOIN (SELECT k, ls AS state, SUM(n) / 100.0 AS mean, sqrt(greatest(0, SUM(n * n) / 100.0 - (SUM(n) / 100.0) * (SUM(n) / 100.0))) AS std
                    FROM shuffled_edges GROUP BY k, ls) USING (k, state)
              GROUP BY k) USING (k)""",
        "edge_labels",
        "shuffled_edges",
    ),
)
def spatial_organisation(spark: SparkSession, sf: str) -> DataFrame:
    """Purity and enrichment against 100 label shuffles, for every cut."""
    p = TablePair(spark, sf)
    out = spatial.spatial_organisation(p.st_obs, p.rule_assignment.select("k", "obs_id", "state"))
    rounded = ("observed", "z_score", "null_mean", "null_std", "mean_self_zscore")
    return out.select(*[r6(c).alias(c) if c in rounded else c for c in out.columns])


@query(
    "reconstruction_null",
    with_ctes(
        f"""SELECT k, {s6('median_spot_null')} AS median_spot_null, {s6('median_gene_null')} AS median_gene_null FROM
        (SELECT k, avg(m) AS median_spot_null FROM (
            SELECT k, draw, median(CASE WHEN nn * m2 = 0 THEN 0 ELSE greatest(-1.0, least(1.0, dot / (sqrt(nn) * sqrt(m2)))) END) AS m
            FROM shuffled_labels JOIN scores USING (k, obs_id, state) WHERE draw < 20 GROUP BY k, draw) GROUP BY k) JOIN
        (SELECT k, avg(m) AS median_gene_null FROM (
            SELECT k, draw, median(value) AS m FROM (
                SELECT a.k, a.draw, f.feature, CASE WHEN SUM(COALESCE(x * x, 0)) * SUM(COALESCE(m * m, 0)) = 0 THEN 0
                    ELSE greatest(-1.0, least(1.0, SUM(x * m) / (sqrt(SUM(x * x)) * sqrt(SUM(m * m))))) END AS value
                FROM shuffled_labels a CROSS JOIN shared f
                LEFT JOIN sts t ON t.obs_id = a.obs_id AND t.feature = f.feature
                LEFT JOIN profiles p ON p.k = a.k AND p.state = a.state AND p.feature = f.feature
                WHERE draw < 20 GROUP BY a.k, a.draw, f.feature) GROUP BY k, draw) GROUP BY k) USING (k)""",
        "shuffled_labels",
        "scores",
        "shared",
    ),
)
def reconstruction_null(spark: SparkSession, sf: str) -> DataFrame:
    """Median cosines of the reconstruction with shuffled labels, mean over 20 shuffles."""
    p = TablePair(spark, sf)
    counts = spatial.label_counts(p.rule_assignment)
    index = ordered_index(p.st_obs.select("obs_id"), ["obs_id"])
    if p.rule_kernel is not None:
        rows = cut_lineage(allcuts.spot_rows(p.st_shared, index, "i"))
        spot, sums = allcuts.shuffled(rows, p.rule_kernel, counts, reconstruct.DRAWS)
        gene = reconstruct.summed_cosines(sums, p.st_shared, "hard").where(F.col("combo") == "hard-raw")
    else:
        spot, gene = spatial.shuffled_reconstruction(p.st_shared, p.scores(p.rule_labels), p.profiles(p.rule_cut), counts, index)
    out = reconstruct.null_medians(spot, gene)
    return out.select("k", r6("median_spot_null").alias("median_spot_null"), r6("median_gene_null").alias("median_gene_null"))


# --- expression graph -----------------------------------------------------------------

define(
    "emb_edges",
    ["vec"],
    """SELECT a.obs_id AS src, b.obs_id AS dst FROM vec a CROSS JOIN vec b WHERE a.obs_id <> b.obs_id
    QUALIFY row_number() OVER (PARTITION BY a.obs_id ORDER BY round(list_distance(a.v, b.v), 9), b.obs_id) <= 14""",
)
define(
    "emb_graph",
    ["emb_edges"],
    "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM emb_edges",
)


@query("expr_knn_graph", with_ctes("SELECT a, b FROM emb_graph", "emb_graph"))
def expr_knn_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.simple_graph(graph.neighbour_edges(tables.embedding_vectors(spark, sf)))


define(
    "emb_modularity",
    ["emb_graph", "vec", "emb_cut"],
    """SELECT k, SUM(inner_e / m - (deg / (2 * m)) * (deg / (2 * m))) AS modularity FROM (
        SELECT k, state, CAST(SUM(inner_e) AS DOUBLE) AS inner_e, CAST(SUM(deg) AS DOUBLE) AS deg,
            (SELECT CAST(count(*) AS DOUBLE) FROM emb_graph) AS m FROM (
            SELECT s.k, s.state, CASE WHEN s.state = t.state THEN 1 ELSE 0 END AS inner_e, 1 AS deg
            FROM emb_graph g JOIN vec x ON x.obs_id = g.a JOIN vec y ON y.obs_id = g.b
            JOIN emb_cut s ON s.c = x.c JOIN emb_cut t ON t.c = y.c AND t.k = s.k
            UNION ALL
            SELECT t.k, t.state, 0, 1
            FROM emb_graph g JOIN vec y ON y.obs_id = g.b JOIN emb_cut t ON t.c = y.c)
        GROUP BY k, state) GROUP BY k""",
)


@query("modularity", with_ctes(f"SELECT k, {s6('modularity')} AS modularity FROM emb_modularity", "emb_modularity"))
def modularity(spark: SparkSession, sf: str) -> DataFrame:
    """Modularity of every rule cut of the labels, from the contacts of the labels."""
    rows = tables.embedding_vectors(spark, sf)
    g = graph.simple_graph(graph.neighbour_edges(rows))
    start = rows.select("obs_id", "c")
    cut = clusters.modulo_cut(start)
    return graph.modularity_of_cuts(graph.contact_counts(g, start), cut).select("k", r6("modularity").alias("modularity"))


@query("modularity_labels", with_ctes(f"SELECT k, {s6('modularity')} AS modularity FROM emb_modularity", "emb_modularity"))
def modularity_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The same for labels given per row and cut, as the spots have them."""
    rows = tables.embedding_vectors(spark, sf)
    g = graph.simple_graph(graph.neighbour_edges(rows))
    start = rows.select("obs_id", "c")
    assigned = start.join(clusters.modulo_cut(start), "c").select("k", "obs_id", "state")
    return graph.modularity_of_labels(g, assigned).select("k", r6("modularity").alias("modularity"))


@query("communities")
def communities(spark: SparkSession, sf: str) -> DataFrame:
    """Over-clustering of the embeddings' neighbour graph."""
    rows = tables.embedding_vectors(spark, sf)
    edges = graph.neighbour_edges(graph.principal_components(rows.select("obs_id", "vec")))
    return graph.communities(edges, vertices=rows)


@query("pca_neighbours")
def pca_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbour graph of the suppliers in principal components of all features."""
    p = TablePair(spark, sf)
    from spotweave.operators.normalize import lognorm

    names = [r["feature"] for r in p.st.select("feature").distinct().orderBy("feature").collect()]
    vec = knn.dense_vectors(lognorm(p.st), p.st_obs, names, "lx")
    return graph.neighbour_edges(graph.principal_components(vec))


@query(
    "state_centroid_neighbours",
    with_ctes(
        f"""SELECT k, state, {s6('avg(u)')} AS u, {s6('avg(w)')} AS v FROM (
            SELECT s.k, s.state, x.obs_id, x.v[1] AS u, x.v[2] AS w
            FROM (SELECT k, state, list(m ORDER BY d) AS v FROM (
                    SELECT k, state, d, avg(e) AS m FROM (
                        SELECT c.k, c.state, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS e FROM vec JOIN emb_cut c USING (c))
                    GROUP BY k, state, d) GROUP BY k, state) s
            CROSS JOIN vec x
            QUALIFY row_number() OVER (PARTITION BY s.k, s.state ORDER BY round(list_distance(s.v, x.v), 9), x.obs_id) <= 15)
        GROUP BY k, state""",
        "vec",
        "emb_cut",
    ),
)
def state_centroid_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.embedding_vectors(spark, sf)
    start = rows.select("obs_id", "c")
    states = start.join(clusters.modulo_cut(start), "c").select("k", "obs_id", "state")
    layout = rows.select("obs_id", F.col("vec")[0].alias("u"), F.col("vec")[1].alias("v"))
    out = graph.place_centroids(layout, rows.select("obs_id", "vec"), states)
    return out.select("k", "state", r6("u").alias("u"), r6("v").alias("v"))


@query(
    "fill_from_nearest",
    with_ctes(
        """SELECT s.obs_id, CASE WHEN s.box = -1 THEN n.box ELSE s.box END AS box FROM boxed s LEFT JOIN (
            SELECT a.obs_id, b.box FROM boxed a JOIN boxed b ON a.box = -1 AND b.box <> -1
            QUALIFY row_number() OVER (PARTITION BY a.obs_id ORDER BY
                round(sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)), 9), b.obs_id) = 1) n USING (obs_id)""".replace(
            "boxed",
            "(SELECT *, CASE WHEN px BETWEEN 0 AND 12 AND py BETWEEN 0 AND 4000 THEN 0 WHEN px BETWEEN 8 AND 20 AND py BETWEEN 3000 AND 9000 THEN 1 ELSE -1 END AS box FROM st_obs)",
        ),
        "st_obs",
    ),
)
def fill_from_nearest(spark: SparkSession, sf: str) -> DataFrame:
    spots = tables.supplier_rows(spark, sf)
    boxed = prep.assign_boxes(spots, [(0.0, 0.0, 12.0, 4000.0), (8.0, 3000.0, 20.0, 9000.0)])
    return prep.fill_from_nearest(boxed).select("obs_id", "box")


# --- soft mapping of the suppliers ---------------------------------------------------

define(
    "cust_vec",
    ["sc_obs", "shared", "scs", "start"],
    """SELECT o.obs_id, t.c, list(COALESCE(x, 0) ORDER BY f.feature) AS v,
        sqrt(SUM(COALESCE(x, 0) * COALESCE(x, 0))) + 1e-8 AS n
    FROM sc_obs o JOIN start t USING (obs_id) CROSS JOIN shared f
    LEFT JOIN scs s ON s.obs_id = o.obs_id AND s.feature = f.feature GROUP BY o.obs_id, t.c""",
)
define(
    "supp_vec",
    ["st_obs", "shared", "sts"],
    """SELECT o.obs_id, list(COALESCE(x, 0) ORDER BY f.feature) AS v,
        sqrt(SUM(COALESCE(x, 0) * COALESCE(x, 0))) + 1e-8 AS n
    FROM st_obs o CROSS JOIN shared f LEFT JOIN sts s ON s.obs_id = o.obs_id AND s.feature = f.feature
    GROUP BY o.obs_id""",
)
define(
    "cust_nn",
    ["cust_vec"],
    f"""SELECT a.obs_id, b.obs_id AS nbr, b.c, row_number() OVER (PARTITION BY a.obs_id
        ORDER BY round({_SIM}, 9) DESC, b.obs_id) AS rank
    FROM cust_vec a CROSS JOIN cust_vec b WHERE a.obs_id <> b.obs_id QUALIFY rank <= 51""",
)
define(
    "supp_nn",
    ["supp_vec", "cust_vec"],
    f"""SELECT a.obs_id, b.obs_id AS nbr, b.c, row_number() OVER (PARTITION BY a.obs_id
        ORDER BY round({_SIM}, 9) DESC, b.obs_id) AS rank
    FROM supp_vec a CROSS JOIN cust_vec b QUALIFY rank <= 51""",
)
define(
    "cust_size",
    ["cust_nn", "cust_vec", "cut"],
    """SELECT k, obs_id, CAST(COALESCE(min(CASE WHEN pred = own THEN kp END), 51) AS INTEGER) AS size FROM (
        SELECT t.k, t.obs_id, kp, any_value(o.state) AS own, arg_min(t.state, (-round(t, 9), t.state)) AS pred
        FROM (SELECT s.k, e.obs_id, s.state, g.kp, SUM(1 + 1e-4 * (51 - (e.rank - 1))) AS t
              FROM cust_nn e JOIN cut s ON s.c = e.c
              JOIN (SELECT unnest(range(11, 52, 2)) AS kp) g ON e.rank <= g.kp GROUP BY ALL) t
        JOIN cust_vec r ON r.obs_id = t.obs_id JOIN cut o ON o.k = t.k AND o.c = r.c
        GROUP BY t.k, t.obs_id, kp) GROUP BY k, obs_id""",
)
define(
    "supp_vote",
    ["supp_nn", "cust_size", "cut"],
    """SELECT k, obs_id, state, w / SUM(w) OVER (PARTITION BY k, obs_id) AS p FROM (
        SELECT e.k, q.obs_id, s.state, SUM(1.0 / e.size) AS w
        FROM supp_nn q JOIN cust_size e ON e.obs_id = q.nbr JOIN cut s ON s.k = e.k AND s.c = q.c
        JOIN supp_nn q1 ON q1.obs_id = q.obs_id AND q1.rank = 1
        JOIN cust_size e1 ON e1.obs_id = q1.nbr AND e1.k = e.k
        WHERE q.rank <= e1.size GROUP BY e.k, q.obs_id, s.state)""",
)


def supplier_vote(p: TablePair) -> DataFrame:
    """Adaptive-neighbour mapping of the suppliers at every rule cut."""
    # Read several times by both searches; the tables behind them are far larger.
    spots, cells = (cut_lineage(v) for v in p.vectors())
    cells = cells.join(p.start.select("obs_id"), "obs_id", "left_semi")
    start = cut_lineage(p.start.select("obs_id", "c"))
    grid = wann.reliability_grid(cells.count())
    # Lists are made once for equal rows: a row for each id and neighbour would be shuffled four times.
    members, near, n = knn.knn_groups(cells, cells, grid[-1], self_join=True)
    found = wann.reliability(near, start, p.rule_labels, grid, (members, n))
    members, near, n = knn.knn_groups(spots, cells, grid[-1])
    return wann.adaptive_vote(near, found, p.rule_labels, grid, (members, n))


@query("wann_suppliers", with_ctes(f"SELECT k, obs_id, state, {s6('p')} AS p FROM supp_vote", "supp_vote"))
def wann_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return supplier_vote(TablePair(spark, sf)).select("k", "obs_id", "state", r6("p").alias("p"))


define(
    "soft_pred",
    ["supp_vote", "profiles"],
    "SELECT k, obs_id, feature, SUM(p * m) AS pred, SUM(p * ml) AS lpred FROM supp_vote JOIN profiles USING (k, state) GROUP BY k, obs_id, feature",
)
define(
    "soft_cells",
    ["soft_pred", "sts", "shared", "st_obs", "ks"],
    """SELECT k.k, o.obs_id, f.feature, COALESCE(x, 0) AS x, COALESCE(lx, 0) AS lx,
        COALESCE(pred, 0) AS pred, COALESCE(lpred, 0) AS lpred
    FROM ks k CROSS JOIN st_obs o CROSS JOIN shared f
    LEFT JOIN sts s ON s.obs_id = o.obs_id AND s.feature = f.feature
    LEFT JOIN soft_pred p ON p.k = k.k AND p.obs_id = o.obs_id AND p.feature = f.feature""",
)
_COS = "CASE WHEN SUM({x} * {x}) * SUM({p} * {p}) = 0 THEN 0 ELSE greatest(-1.0, least(1.0, SUM({x} * {p}) / (sqrt(SUM({x} * {x})) * sqrt(SUM({p} * {p}))))) END"


def _soft_sql(axis: str) -> str:
    raw, norm = _COS.format(x="x", p="pred"), _COS.format(x="lx", p="lpred")
    return f"""SELECT 'soft-raw' AS combo, k, {axis}, {s6(raw)} AS value FROM soft_cells GROUP BY k, {axis}
    UNION ALL SELECT 'soft-norm', k, {axis}, {s6(norm)} FROM soft_cells GROUP BY k, {axis}"""


@query("cossim_soft_per_spot", with_ctes(_soft_sql("obs_id"), "soft_cells"))
def cossim_soft_per_spot(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    if p.rule_kernel is not None:
        rows = allcuts.with_votes(p.spot_rows, supplier_vote(p))
        out = reconstruct.mapped_spot_cosines(allcuts.mapped_spots(rows, p.rule_kernel), "soft")
    else:
        out = reconstruct.soft_spot_cosines(p.scores(p.rule_labels), supplier_vote(p), p.profiles(p.rule_cut))
    return out.select("combo", "k", "obs_id", r6("value").alias("value"))


@query("cossim_soft_per_gene", with_ctes(_soft_sql("feature"), "soft_cells"))
def cossim_soft_per_gene(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    if p.rule_kernel is not None:
        rows = allcuts.with_votes(p.spot_rows, supplier_vote(p))
        out = reconstruct.summed_cosines(allcuts.mapped_features(rows, p.rule_kernel), p.st_shared, "soft")
    else:
        vote = cut_lineage(supplier_vote(p))  # read by the sums and by the pairs of votes
        out = reconstruct.feature_cosines(p.st_shared, vote, p.profiles(p.rule_cut), p.shared, "soft")
    return out.select("combo", "k", "feature", r6("value").alias("value"))


@query(
    "tree_reconstruction",
    with_ctes(
        f"""SELECT k, obs_id, state, {s6('CASE WHEN nn * m2 = 0 THEN 0 ELSE greatest(-1.0, least(1.0, dot / (sqrt(nn) * sqrt(m2)))) END')} AS value
        FROM tree_scores QUALIFY row_number() OVER (PARTITION BY k, obs_id ORDER BY round(sim, 9) DESC, state) = 1""",
        "tree_scores",
    ),
)
def tree_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    """Hard cosines of the cuts of the real tree, per spot."""
    p = TablePair(spark, sf)
    assigned = p.assigned(p.tree_labels, p.kernel(p.tree_labels))
    return assigned.select("k", "obs_id", "state", r6(guarded_cosine("dot", "nn", "mm")).alias("value"))
