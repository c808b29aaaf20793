"""Queries on normalisation, clusters, cuts and the nearest-centroid mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from spotweave.operators import allcuts, clusters, coherence, features, nearest, normalize, prep, quality, reconstruct, tree
from spotweave.plans.base import TablePair, r6
from spotweave.plans.registry import query
from spotweave.plans.sql import r6 as s6, with_ctes
from spotweave.session import cut_lineage
from spotweave.sources import tables


@query("shared_features", with_ctes("SELECT feature FROM shared", "shared"))
def shared_features(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    return features.shared_features(p.sc, p.st)


@query(
    "feature_sets",
    with_ctes(
        """SELECT 'difference' AS op, feature FROM (SELECT feature FROM sc EXCEPT SELECT feature FROM st)
        UNION ALL
        SELECT 'union', feature FROM (SELECT feature FROM sc UNION SELECT feature FROM st)""",
        "sc",
        "st",
    ),
)
def feature_sets(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    diff = features.only_left_features(p.sc, p.st).select(F.lit("difference").alias("op"), "feature")
    both = features.union_features(features.feature_set(p.sc), features.feature_set(p.st))
    return diff.unionByName(both.select(F.lit("union").alias("op"), "feature"))


_LOGNORM = """CASE WHEN SUM(x) OVER (PARTITION BY obs_id) > 0
    THEN ln(1 + 10000.0 * x / SUM(x) OVER (PARTITION BY obs_id)) ELSE 0 END"""


@query(
    "lognorm_all",
    with_ctes(f"SELECT obs_id, feature, {s6(_LOGNORM)} AS lx FROM sc", "sc"),
)
def lognorm_all(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.lognorm(TablePair(spark, sf).sc).select("obs_id", "feature", r6("lx").alias("lx"))


@query(
    "lognorm_shared",
    with_ctes(f"SELECT obs_id, feature, {s6('lx')} AS lx FROM sts", "sts"),
)
def lognorm_shared(spark: SparkSession, sf: str) -> DataFrame:
    return TablePair(spark, sf).st_shared.select("obs_id", "feature", r6("lx").alias("lx"))


@query(
    "l2_unit",
    with_ctes(
        f"""SELECT obs_id, feature, {s6('x / (sqrt(SUM(x * x) OVER (PARTITION BY obs_id)) + 1e-8)')} AS u
        FROM st""",
        "st",
    ),
)
def l2_unit(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.unit_rows(TablePair(spark, sf).st).select("obs_id", "feature", r6("u").alias("u"))


@query(
    "relative_frequency",
    with_ctes(
        f"""SELECT c, feature, {s6('m / (SUM(m) OVER (PARTITION BY c) + 1e-8)')} AS f FROM centroids""",
        "centroids",
    ),
)
def relative_frequency(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    return normalize.relative_frequency(p.centroids, "c", "m").select("c", "feature", r6("f").alias("f"))


@query(
    "label_codes",
    with_ctes("SELECT label, c, count(*) AS n FROM start GROUP BY label, c", "start"),
)
def label_codes(spark: SparkSession, sf: str) -> DataFrame:
    return TablePair(spark, sf).start.groupBy(F.col("name").alias("label"), "c").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cluster_aggregates",
    with_ctes(
        f"""SELECT c, feature, n, {s6('sx')} AS sx, {s6('slx')} AS slx, {s6('m')} AS m, {s6('ml')} AS ml
        FROM centroids JOIN sizes USING (c)""",
        "centroids",
    ),
)
def cluster_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    return p.centroids.join(p.sizes, "c").select(
        "c", "feature", "n", *[r6(v).alias(v) for v in ("sx", "slx", "m", "ml")]
    )


@query(
    "state_profiles_all_k",
    with_ctes(f"SELECT k, state, feature, {s6('m')} AS m, {s6('ml')} AS ml FROM profiles", "profiles"),
)
def state_profiles_all_k(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    return p.profiles(p.rule_cut).select("k", "state", "feature", r6("m").alias("m"), r6("ml").alias("ml"))


@query(
    "merge_map",
    with_ctes("SELECT k, state, c, n FROM cut JOIN sizes USING (c)", "cut"),
)
def merge_map(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    return clusters.merge_map(p.start, p.rule_cut)


@query(
    "state_members",
    with_ctes("SELECT k, state, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS members FROM cut GROUP BY k, state", "cut"),
)
def state_members(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.state_members(TablePair(spark, sf).rule_cut).select(
        "k", "state", F.array_join(F.col("members").cast("array<string>"), ",").alias("members")
    )


@query(
    "state_fractions",
    with_ctes(
        f"""SELECT z.k, z.state, count(a.obs_id) AS n,
            {s6('count(a.obs_id) / CAST((SELECT count(*) FROM st_obs) AS DOUBLE)')} AS fraction
        FROM state_sizes z LEFT JOIN nearest a ON a.k = z.k AND a.state = z.state GROUP BY z.k, z.state""",
        "nearest",
    ),
)
def state_fractions(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    out = clusters.state_fractions(p.rule_assignment, clusters.state_domain(p.rule_cut))
    return out.select("k", "state", "n", r6("fraction").alias("fraction"))


@query(
    "profile_zscore",
    with_ctes(
        f"""SELECT k, state, feature, {s6('m')} AS m,
            {s6('CASE WHEN sd > 1e-12 THEN (m - mean) / sd ELSE 0 END')} AS z, {s6('sd * sd')} AS variance
        FROM (SELECT z.k, z.state, f.feature, COALESCE(m, 0) AS m,
                avg(COALESCE(m, 0)) OVER (PARTITION BY z.k, f.feature) AS mean,
                stddev_pop(COALESCE(m, 0)) OVER (PARTITION BY z.k, f.feature) AS sd
              FROM state_sizes z CROSS JOIN shared f
              LEFT JOIN profiles p ON p.k = z.k AND p.state = z.state AND p.feature = f.feature)""",
        "profiles",
        "shared",
    ),
)
def profile_zscore(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    z = clusters.profile_zscores(p.profiles(p.rule_cut), clusters.state_domain(p.rule_cut))
    return z.select("k", "state", "feature", r6("m").alias("m"), r6("z").alias("z"), r6("variance").alias("variance"))


@query(
    "profile_distances",
    with_ctes(
        f"""SELECT CAST(a.c AS INTEGER) AS a, CAST(b.c AS INTEGER) AS b,
            {s6('sqrt(SUM((COALESCE(fa.f, 0) - COALESCE(fb.f, 0)) * (COALESCE(fa.f, 0) - COALESCE(fb.f, 0))))')} AS d
        FROM sizes a JOIN sizes b ON a.c < b.c CROSS JOIN shared s
        LEFT JOIN (SELECT c, feature, m / (SUM(m) OVER (PARTITION BY c) + 1e-8) AS f FROM centroids) fa
            ON fa.c = a.c AND fa.feature = s.feature
        LEFT JOIN (SELECT c, feature, m / (SUM(m) OVER (PARTITION BY c) + 1e-8) AS f FROM centroids) fb
            ON fb.c = b.c AND fb.feature = s.feature
        GROUP BY a.c, b.c""",
        "centroids",
    ),
)
def profile_distances(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    return tree.distance_pairs(p.centroids, p.n_clusters).select("a", "b", r6("d").alias("d"))


@query("agglomeration_cuts", with_ctes("SELECT method, k, c, state FROM tree_cut", "tree_cut"))
def agglomeration_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Cut of the tree over the nation profiles at every K, both linkage methods."""
    p = TablePair(spark, sf)
    pairs = cut_lineage(tree.distance_pairs(p.centroids, p.n_clusters))
    out = None
    for method in tree.METHODS:
        merges = tree.link_table(pairs, p.n_clusters, method)
        labels = tree.cuts(merges, tree.k_range(p.n_clusters), p.n_clusters)
        part = tree.cut_frame(spark, labels).withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "nearest_centroid",
    with_ctes(
        f"SELECT k, obs_id, state, {s6('sim')} AS sim, {s6('confidence')} AS confidence FROM nearest", "nearest"
    ),
)
def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return TablePair(spark, sf).rule_assignment.select(
        "k", "obs_id", "state", r6("sim").alias("sim"), r6("confidence").alias("confidence")
    )


@query(
    "margin_confidence",
    with_ctes(
        f"""SELECT obs_id, {s6('''greatest(0.0, least(1.0, 1 - max(CASE WHEN rn = 1 THEN d END)
                / (avg(CASE WHEN rn > 1 THEN d END) + 1e-8)))''')} AS confidence
        FROM (SELECT obs_id, 1 - sim AS d, row_number() OVER (PARTITION BY obs_id ORDER BY 1 - sim) AS rn
              FROM scores WHERE k = (SELECT max(k) FROM ks))
        WHERE rn <= 4 GROUP BY obs_id""",
        "scores",
    ),
)
def margin_confidence(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    top = max(p.rule_labels)
    scores = p.scores({top: p.rule_labels[top]}).withColumn("dist", 1.0 - F.col("sim"))
    return nearest.margin_confidence(scores, ["obs_id"]).select("obs_id", r6("confidence").alias("confidence"))


@query(
    "confidence_below",
    with_ctes(
        "SELECT k, count(*) FILTER (WHERE confidence < 0.1) AS n_below, count(*) AS n FROM nearest GROUP BY k",
        "nearest",
    ),
)
def confidence_below(spark: SparkSession, sf: str) -> DataFrame:
    marked = quality.below_threshold(TablePair(spark, sf).rule_assignment, 0.1)
    return marked.groupBy("k").agg(F.count_if("below").alias("n_below"), F.count(F.lit(1)).alias("n"))


@query(
    "nearest_confidence_summary",
    with_ctes(
        f"""SELECT k, count(*) AS n, {s6('avg(confidence)')} AS mean, {s6('median(confidence)')} AS median,
            {s6('min(confidence)')} AS min, {s6('max(confidence)')} AS max, {s6('stddev_pop(confidence)')} AS std,
            {s6('avg(CAST(confidence >= 0.5 AS DOUBLE))')} AS frac_at_least_50,
            {s6('avg(CAST(confidence >= 0.9 AS DOUBLE))')} AS frac_at_least_90
        FROM nearest GROUP BY k""",
        "nearest",
    ),
)
def nearest_confidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = quality.confidence_summary(TablePair(spark, sf).rule_assignment)
    return s.select("k", "n", *[r6(c).alias(c) for c in s.columns if c not in ("k", "n")])


@query(
    "conf_histogram",
    with_ctes(
        """SELECT k, CAST(least(floor(confidence * 40), 39) AS INTEGER) AS bin, count(*) AS n
        FROM (SELECT k, round(confidence, 9) AS confidence FROM nearest) GROUP BY 1, 2""",
        "nearest",
    ),
)
def conf_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = TablePair(spark, sf).rule_assignment.select("k", F.round("confidence", 9).alias("confidence"))
    return quality.unit_histogram(rows, ["k"], "confidence")


@query(
    "boxplot_stats",
    with_ctes(
        f"""SELECT k, count(*) AS n, {s6('quantile_cont(sim, 0.25)')} AS q1, {s6('median(sim)')} AS median,
            {s6('quantile_cont(sim, 0.75)')} AS q3, {s6('min(sim)')} AS low, {s6('max(sim)')} AS high
        FROM nearest GROUP BY k""",
        "nearest",
    ),
)
def boxplot_stats(spark: SparkSession, sf: str) -> DataFrame:
    box = quality.box_statistics(TablePair(spark, sf).rule_assignment, ["k"], "sim")
    return box.select("k", "n", *[r6(c).alias(c) for c in ("q1", "median", "q3", "low", "high")])


@query(
    "predict_expression",
    with_ctes(
        f"SELECT k, obs_id, feature, {s6('m')} AS pred FROM nearest JOIN profiles USING (k, state)",
        "nearest",
    ),
)
def predict_expression(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    mapping = nearest.one_hot(p.rule_assignment)
    pred = reconstruct.predict_expression(mapping, p.profiles(p.rule_cut))
    return pred.select("k", "obs_id", "feature", r6("pred").alias("pred"))


_SPOT = """SELECT 'hard-raw' AS combo, k, obs_id, CASE WHEN nn * m2 = 0 THEN 0 ELSE greatest(-1.0, least(1.0,
        dot / (sqrt(nn) * sqrt(m2)))) END AS value FROM ranked JOIN nearest USING (k, obs_id, state)
    UNION ALL
    SELECT 'hard-norm', k, obs_id, CASE WHEN ln * ml2 = 0 THEN 0 ELSE greatest(-1.0, least(1.0,
        ldot / (sqrt(ln) * sqrt(ml2)))) END FROM ranked JOIN nearest USING (k, obs_id, state)"""
_GENE = """SELECT combo, k, feature, CASE WHEN SUM(x * x) * SUM(m * m) = 0 THEN 0 ELSE greatest(-1.0, least(1.0,
        SUM(x * m) / (sqrt(SUM(x * x)) * sqrt(SUM(m * m))))) END AS value
    FROM (SELECT 'hard-raw' AS combo, a.k, a.obs_id, f.feature, COALESCE(t.x, 0) AS x, COALESCE(p.m, 0) AS m
          FROM nearest a CROSS JOIN shared f LEFT JOIN sts t ON t.obs_id = a.obs_id AND t.feature = f.feature
          LEFT JOIN profiles p ON p.k = a.k AND p.state = a.state AND p.feature = f.feature
          UNION ALL
          SELECT 'hard-norm', a.k, a.obs_id, f.feature, COALESCE(t.lx, 0), COALESCE(p.ml, 0)
          FROM nearest a CROSS JOIN shared f LEFT JOIN sts t ON t.obs_id = a.obs_id AND t.feature = f.feature
          LEFT JOIN profiles p ON p.k = a.k AND p.state = a.state AND p.feature = f.feature)
    GROUP BY combo, k, feature"""


def _gene_cosines(p: TablePair) -> DataFrame:
    if p.rule_kernel is not None:
        return reconstruct.summed_cosines(allcuts.feature_sums(p.spot_rows, p.rule_kernel), p.st_shared, "hard")
    mapping = nearest.one_hot(p.rule_assignment)
    return reconstruct.feature_cosines(p.st_shared, mapping, p.profiles(p.rule_cut), p.shared, "hard")


@query(
    "cossim_per_spot",
    with_ctes(f"SELECT combo, k, obs_id, {s6('value')} AS value FROM ({_SPOT})", "nearest"),
)
def cossim_per_spot(spark: SparkSession, sf: str) -> DataFrame:
    spot = reconstruct.hard_spot_cosines(TablePair(spark, sf).rule_assignment)
    return spot.select("combo", "k", "obs_id", r6("value").alias("value"))


@query(
    "cossim_per_gene",
    with_ctes(f"SELECT combo, k, feature, {s6('value')} AS value FROM ({_GENE})", "nearest", "shared"),
)
def cossim_per_gene(spark: SparkSession, sf: str) -> DataFrame:
    return _gene_cosines(TablePair(spark, sf)).select("combo", "k", "feature", r6("value").alias("value"))


@query(
    "cossim_medians",
    with_ctes(
        f"""SELECT combo, k, {s6('median_gene')} AS median_gene, {s6('median_spot')} AS median_spot FROM
        (SELECT combo, k, median(value) AS median_gene FROM ({_GENE}) GROUP BY combo, k) JOIN
        (SELECT combo, k, median(value) AS median_spot FROM ({_SPOT}) GROUP BY combo, k) USING (combo, k)""",
        "nearest",
        "shared",
    ),
)
def cossim_medians(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    spot = reconstruct.hard_spot_cosines(p.rule_assignment)
    out = reconstruct.cosine_medians(spot, _gene_cosines(p), ["combo", "k"])
    return out.select("combo", "k", r6("median_gene").alias("median_gene"), r6("median_spot").alias("median_spot"))


@query(
    "pairwise_cosine",
    with_ctes(
        f"""SELECT CAST(a.c AS INTEGER) AS a, CAST(b.c AS INTEGER) AS b, {s6('SUM(a.u * b.u)')} AS cos
        FROM (SELECT c, feature, ml / (sqrt(SUM(ml * ml) OVER (PARTITION BY c)) + 1e-12) AS u FROM centroids) a
        JOIN (SELECT c, feature, ml / (sqrt(SUM(ml * ml) OVER (PARTITION BY c)) + 1e-12) AS u FROM centroids) b
            ON a.feature = b.feature AND a.c < b.c
        GROUP BY a.c, b.c""",
        "centroids",
    ),
)
def pairwise_cosine(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    return coherence.pairwise_cosines(p.centroids, p.n_clusters).select("a", "b", r6("cos").alias("cos"))


@query(
    "merged_coherence",
    with_ctes(
        f"""SELECT z.k, z.state, count(DISTINCT z.c) AS n,
            {s6('COALESCE(any_value(q.mean_cos), 1)')} AS mean_cos,
            {s6('COALESCE(any_value(q.median_cos), 1)')} AS median_cos
        FROM cut z LEFT JOIN (
            SELECT x.k, x.state, avg(cos) AS mean_cos, median(cos) AS median_cos
            FROM (SELECT a.c AS a, b.c AS b, SUM(a.u * b.u) AS cos
                  FROM (SELECT c, feature, ml / (sqrt(SUM(ml * ml) OVER (PARTITION BY c)) + 1e-12) AS u FROM centroids) a
                  JOIN (SELECT c, feature, ml / (sqrt(SUM(ml * ml) OVER (PARTITION BY c)) + 1e-12) AS u FROM centroids) b
                      ON a.feature = b.feature AND a.c < b.c GROUP BY a.c, b.c) p
            JOIN cut x ON x.c = p.a JOIN cut y ON y.c = p.b AND y.k = x.k AND y.state = x.state
            GROUP BY x.k, x.state) q ON q.k = z.k AND q.state = z.state
        GROUP BY z.k, z.state""",
        "centroids",
        "cut",
    ),
)
def merged_coherence(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    out = coherence.pair_statistics(coherence.pairwise_cosines(p.centroids, p.n_clusters), p.rule_cut, p.sizes)
    return out.select("k", "state", "n", r6("mean_cos").alias("mean_cos"), r6("median_cos").alias("median_cos"))


@query("coherence_null")
def coherence_null(spark: SparkSession, sf: str) -> DataFrame:
    """Merge coherence of the tree's cuts against random draws."""
    p = TablePair(spark, sf)
    gram = tree.cluster_grams(p.centroids, p.n_clusters, ["ml"])[0]
    return coherence.merge_coherence(spark, coherence.centroid_cosines(gram), gram.diagonal() > 0, p.tree_labels)


@query(
    "hvg_topn",
    with_ctes(
        f"""SELECT feature, {s6('score')} AS score FROM (
            SELECT feature, CASE WHEN count(d) OVER w = 1 AND d IS NOT NULL THEN 1.0
                ELSE (d - avg(d) OVER w) / nullif(stddev_samp(d) OVER w, 0) END AS score
            FROM (SELECT feature, d, greatest(0, CAST(ceil((m - min(m) OVER ()) / ((max(m) OVER () - min(m) OVER ()) / 20)) AS INTEGER) - 1) AS bin
                  FROM (SELECT f.feature, ln(1 + avg(COALESCE(y, 0))) AS m,
                            ln(nullif(var_samp(COALESCE(y, 0)) / avg(COALESCE(y, 0)), 0)) AS d
                        FROM sc_obs o CROSS JOIN (SELECT DISTINCT feature FROM sc) f
                        LEFT JOIN (SELECT obs_id, feature, x / SUM(x) OVER (PARTITION BY obs_id)
                                       * (SELECT median(t) FROM (SELECT SUM(x) AS t FROM sc GROUP BY obs_id)) AS y FROM sc) v
                            ON v.obs_id = o.obs_id AND v.feature = f.feature
                        GROUP BY f.feature))
            WINDOW w AS (PARTITION BY bin)
        ) QUALIFY rank() OVER (ORDER BY round(COALESCE(score, 0), 9) DESC) <= 10""",
        "sc",
        "sc_obs",
    ),
)
def hvg_topn(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    n = p.sc_obs.agg(F.count(F.lit(1)).alias("n"))
    return prep.top_variable_features(prep.feature_dispersion(p.sc, n), 10).select("feature", r6("score").alias("score"))


@query(
    "variance_rank",
    with_ctes(
        f"""SELECT feature, {s6('variance')} AS variance, row_number() OVER (ORDER BY round(variance, 9) DESC, feature) AS rank
        FROM (SELECT f.feature, var_pop(COALESCE(m, 0)) AS variance
              FROM sizes z CROSS JOIN shared f
              LEFT JOIN profiles c ON c.k = (SELECT max(k) FROM ks) AND c.state = z.c AND c.feature = f.feature
              GROUP BY f.feature)""",
        "profiles",
        "shared",
    ),
)
def variance_rank(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    finest = F.col("k") == p.n_clusters
    z = clusters.profile_zscores(
        p.profiles(p.rule_cut).where(finest), clusters.state_domain(p.rule_cut).where(finest)
    )
    # One row per feature is ranked.
    per = z.groupBy("feature").agg(F.max("variance").alias("variance"))
    return per.select(
        "feature",
        r6("variance").alias("variance"),
        F.row_number().over(W.orderBy(F.round("variance", 9).desc(), "feature")).cast("bigint").alias("rank"),
    )


@query(
    "mapper_pivot",
    with_ctes(
        f"""SELECT metric, {s6("max(CASE WHEN mapper = 'nearest_centroid' THEN value END)")} AS nearest_centroid,
            {s6("max(CASE WHEN mapper = 'majority' THEN value END)")} AS majority
        FROM (SELECT 'n_states' AS metric, 'nearest_centroid' AS mapper, CAST(count(DISTINCT state) AS DOUBLE) AS value
              FROM nearest WHERE k = (SELECT max(k) FROM ks)
              UNION ALL SELECT 'mean_confidence', 'nearest_centroid', avg(confidence) FROM nearest WHERE k = (SELECT max(k) FROM ks)
              UNION ALL SELECT 'n_states', 'majority', CAST(count(DISTINCT c) AS DOUBLE) FROM start
              UNION ALL SELECT 'mean_confidence', 'majority', max(n) / CAST(SUM(n) AS DOUBLE) FROM sizes)
        GROUP BY metric""",
        "nearest",
        "start",
    ),
)
def mapper_pivot(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)
    top = max(p.rule_labels)
    near = nearest.nearest_assignment(p.scores({top: p.rule_labels[top]}))

    def metrics(mapper: str, states: Column, mean: Column, df: DataFrame) -> DataFrame:
        return df.agg(states.cast("double").alias("n_states"), mean.alias("mean_confidence")).select(
            F.lit(mapper).alias("mapper"),
            F.explode(
                F.array(
                    F.struct(F.lit("n_states").alias("metric"), F.col("n_states").alias("value")),
                    F.struct(F.lit("mean_confidence").alias("metric"), F.col("mean_confidence").alias("value")),
                )
            ).alias("e"),
        ).select("mapper", "e.metric", "e.value")

    a = metrics("nearest_centroid", F.countDistinct("state"), F.avg("confidence"), near)
    b = metrics("majority", F.countDistinct("c"), F.max("n") / F.sum("n"), p.sizes)
    out = quality.metric_by_mapper(a.unionByName(b), ["nearest_centroid", "majority"])
    return out.select("metric", r6("nearest_centroid").alias("nearest_centroid"), r6("majority").alias("majority"))


@query(
    "outer_concat",
    with_ctes(
        "SELECT side, obs_id, feature, x FROM (SELECT 'sc' AS side, * FROM sc UNION ALL SELECT 'st', * FROM st)",
        "sc",
        "st",
    ),
)
def outer_concat(spark: SparkSession, sf: str) -> DataFrame:
    p = TablePair(spark, sf)

    def tag(side: str, df: DataFrame) -> DataFrame:
        return df.select(F.struct(F.lit(side).alias("side"), F.col("obs_id").alias("id")).alias("obs_id"), "feature", "x")

    return features.outer_concat([tag("sc", p.sc), tag("st", p.st)]).select(
        "obs_id.side", F.col("obs_id.id").alias("obs_id"), "feature", "x"
    )


@query(
    "aligned_cosine",
    with_ctes(
        f"""SELECT axis, name, {s6('CASE WHEN x * p = 0 THEN 0 ELSE greatest(-1.0, least(1.0, d / (sqrt(x) * sqrt(p)))) END')} AS value
        FROM (SELECT 'row' AS axis, CAST(obs_id AS VARCHAR) AS name, SUM(a * b) AS d, SUM(a * a) AS x, SUM(b * b) AS p FROM al GROUP BY obs_id
              UNION ALL
              SELECT 'column', feature, SUM(a * b), SUM(a * a), SUM(b * b) FROM al GROUP BY feature)""".replace(
            "FROM al",
            """FROM (SELECT obs_id, feature, COALESCE(t.x, 0) AS a, COALESCE(u.m, 0) AS b FROM sts t
                FULL JOIN (SELECT o.obs_id, feature, SUM(sx) / (SELECT SUM(n) FROM sizes) AS m
                           FROM sums CROSS JOIN st_obs o GROUP BY o.obs_id, feature) u USING (obs_id, feature))""",
        ),
        "sts",
        "sums",
        "st_obs",
        "sizes",
    ),
)
def aligned_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Measured supplier counts against one mean profile for all, by row and by column."""
    p = TablePair(spark, sf)
    total = p.sizes.agg(F.sum("n")).scalar()
    mean = p.sums.groupBy("feature").agg(F.sum("sx").alias("s")).select("feature", (F.col("s") / total).alias("m"))
    profile = mean.agg(F.collect_list(F.struct("feature", "m"))).scalar()
    pred = p.st_obs.select("obs_id", F.explode(profile).alias("e")).select("obs_id", "e.feature", F.col("e.m").alias("x"))
    both = features.align(p.st_shared, pred)
    by_row = reconstruct.cosine_by_axis(both, "obs_id").select(
        F.lit("row").alias("axis"), F.col("obs_id").cast("string").alias("name"), "value"
    )
    by_col = reconstruct.cosine_by_axis(both, "feature").select(
        F.lit("column").alias("axis"), F.col("feature").alias("name"), "value"
    )
    return by_row.unionByName(by_col).select("axis", "name", r6("value").alias("value"))


@query("flagship_state_counts", with_ctes("SELECT state, count(*) AS n FROM nearest WHERE k = (SELECT max(k) FROM ks) GROUP BY state", "nearest"))
def flagship_state_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers per nation profile: nearest centroid at K = L."""
    p = TablePair(spark, sf)
    top = max(p.rule_labels)
    near = nearest.nearest_assignment(p.scores({top: p.rule_labels[top]}))
    return near.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "start_cluster_counts",
    """SELECT c_mktsegment AS segment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c, count(*) AS n
    FROM customer GROUP BY c_mktsegment""",
)
def start_cluster_counts(spark: SparkSession, sf: str) -> DataFrame:
    start = clusters.start_clusters_from_labels(tables.customer_rows(spark, sf), "segment")
    return start.groupBy(F.col("name").alias("segment"), "c").agg(F.count(F.lit(1)).alias("n"))
