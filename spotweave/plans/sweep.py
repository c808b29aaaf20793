"""The sweep over K for one pair, and for a table of pairs.

All cuts are mapped and scored together, so each step is one job keyed by ``k``
instead of one pass per K. Steps exchange written tables: a lost executor costs the
tasks it ran, and a failed step can start again from the last table.
"""

from __future__ import annotations

import logging
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.functions.indexing import ordered_index
from spotweave.operators import (
    allcuts,
    clusters,
    coherence,
    features,
    graph,
    knn,
    kselect,
    mappers,
    nearest,
    normalize,
    quality,
    reconstruct,
    spatial,
    tree,
)
from spotweave.session import cut_lineage
from spotweave.sources import files, readers, writers

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class SweepConfig:
    mapping: str = "nearest_centroid"
    leiden_resolution: float = 3.0
    linkage_method: str = "average"
    start_from_annotation: str | None = None
    k_min: int | None = None
    k_max: int | None = None
    k_step: int = 1


def _lognorm_vectors(counts: DataFrame, obs: DataFrame) -> DataFrame:
    names = [r["feature"] for r in counts.select("feature").distinct().orderBy("feature").collect()]
    return knn.dense_vectors(counts, obs, names, "lx")


def build_scaffold(
    sc: DataFrame, sc_obs: DataFrame, shared: DataFrame, config: SweepConfig
) -> dict[str, DataFrame]:
    """Everything about the reference that no mapper changes.

    ``start(obs_id, c, name)``, the partial ``sums``, contacts of the start clusters in
    both neighbour graphs, and the modularity of the shared-feature communities.
    """
    everything = normalize.lognorm(sc)
    common = normalize.lognorm_shared(sc, shared)
    edges_all = graph.neighbour_edges(graph.principal_components(_lognorm_vectors(everything, sc_obs))).persist()
    if config.start_from_annotation:
        start = clusters.start_clusters_from_labels(sc_obs, config.start_from_annotation)
    else:
        start = graph.communities(edges_all, config.leiden_resolution, vertices=sc_obs)
    start = start.persist()
    edges_shared = graph.neighbour_edges(graph.principal_components(_lognorm_vectors(common, sc_obs))).persist()
    shared_communities = graph.communities(edges_shared, config.leiden_resolution, vertices=sc_obs)
    simple_shared = graph.simple_graph(edges_shared)
    one = shared_communities.select(F.lit(0).alias("k"), "obs_id", F.col("c").alias("state"))
    return {
        "start": start,
        "sums": clusters.cluster_sums(common, start, {"x": "sx", "lx": "slx"}),
        "contacts_all": graph.contact_counts(graph.simple_graph(edges_all), start),
        "contacts_shared": graph.contact_counts(simple_shared, start),
        "shared_communities": shared_communities,
        "shared_modularity": graph.modularity_of_labels(simple_shared, one).select("modularity"),
    }


def _size_vector(start: DataFrame) -> np.ndarray:
    rows = clusters.cluster_sizes(start).collect()  # one row per start cluster
    out = np.zeros(max(r["c"] for r in rows) + 1)
    for r in rows:
        out[r["c"]] = r["n"]
    return out


def analyse(run: str, pair: mappers.PairContext, scaffold: dict[str, DataFrame], has_confidence: bool) -> None:
    """Computes and writes the metrics of all cuts from the written mapping."""
    spark, labels = pair.spark, pair.labels
    ks = sorted(labels)
    in_run = F.col("k").isin(ks)
    mapping = spark.read.parquet(f"{run}/mapping").where(in_run)
    assigned = spark.read.parquet(f"{run}/assignment").where(in_run)
    cut = tree.cut_frame(spark, labels)
    n = len(pair.sizes)

    writers.write_by_k(quality.onehot_per_row(mapping), run, "onehot")
    onehot = spark.read.parquet(f"{run}/onehot").where(in_run)
    writers.write_by_k(quality.onehot_summary(onehot), run, "onehot_summary")
    if has_confidence:
        writers.write_by_k(quality.confidence_summary(assigned), run, "confidence_summary")
    else:
        writers.drop_by_k(spark, run, "confidence_summary")

    hard = assigned.select("k", "obs_id", "state")
    writers.write_by_k(spatial.spatial_organisation(pair.st_obs, hard), run, "topology")

    sizes = clusters.cluster_sizes(pair.start).persist()
    centroids = clusters.cluster_centroids(pair.sums, sizes, pair.shared)
    gram = tree.cluster_grams(centroids, n, ["ml"])[0]
    tests = coherence.merge_coherence(
        spark, coherence.centroid_cosines(gram), gram.diagonal() > 0, labels
    ).persist()
    writers.write_by_k(tests, run, "coherence")
    writers.write_by_k(coherence.coherence_summary(tests), run, "coherence_summary")

    one_hot = nearest.one_hot(hard)
    if pair.kernel is not None:
        voted = {kind: allcuts.with_votes(pair.spot_rows, m) for kind, m in (("soft", mapping), ("hard", one_hot))}
        spots = [reconstruct.mapped_spot_cosines(allcuts.mapped_spots(rows, pair.kernel), kind) for kind, rows in voted.items()]
        genes = [reconstruct.summed_cosines(allcuts.mapped_features(rows, pair.kernel), pair.st, kind).drop("draw") for kind, rows in voted.items()]
    else:
        profiles = clusters.state_profiles(pair.sums, sizes, cut).persist()
        scores = pair.scores()
        spots = [
            reconstruct.soft_spot_cosines(scores, mapping, profiles),
            reconstruct.hard_spot_cosines(scores.join(hard, ["k", "obs_id", "state"])),
        ]
        genes = [
            reconstruct.feature_cosines(pair.st, m, profiles, pair.shared, kind)
            for kind, m in (("soft", mapping), ("hard", one_hot))
        ]
    spot, gene = spots[0].unionByName(spots[1]), genes[0].unionByName(genes[1])
    writers.write_by_k(spot, run, "cossim_spot")
    writers.write_by_k(gene, run, "cossim_gene")
    spot = spark.read.parquet(f"{run}/cossim_spot").where(in_run)
    gene = spark.read.parquet(f"{run}/cossim_gene").where(in_run)
    counts = spatial.label_counts(hard)
    if pair.kernel is not None:
        null_spot, sums = allcuts.shuffled(pair.spot_rows, pair.kernel, counts, reconstruct.DRAWS)
        null_gene = reconstruct.summed_cosines(sums, pair.st, "hard").where(F.col("combo") == "hard-raw")
    else:
        index = ordered_index(pair.st_obs.select("obs_id"), ["obs_id"])
        null_spot, null_gene = spatial.shuffled_reconstruction(pair.st, scores, profiles, counts, index)
    nulls = reconstruct.null_medians(null_spot, null_gene).withColumn("combo", F.lit("hard-raw"))
    summary = reconstruct.cosine_medians(spot, gene, ["combo", "k"]).join(nulls, ["combo", "k"], "left")
    writers.write_by_k(summary, run, "cossim_summary")

    names = [r["feature"] for r in pair.st_all.select("feature").distinct().orderBy("feature").collect()]
    vectors = knn.dense_vectors(normalize.lognorm(pair.st_all), pair.st_obs, names, "lx")
    st_graph = graph.simple_graph(graph.neighbour_edges(graph.principal_components(vectors)))
    modularity = (
        graph.modularity_of_cuts(scaffold["contacts_all"], cut)
        .withColumnRenamed("modularity", "modularity_all")
        .join(
            graph.modularity_of_cuts(scaffold["contacts_shared"], cut).withColumnRenamed(
                "modularity", "modularity_shared"
            ),
            "k",
        )
        .join(
            graph.modularity_of_labels(st_graph, hard).withColumnRenamed("modularity", "modularity_st_expression"), "k"
        )
        .withColumn("modularity_shared_leiden", scaffold["shared_modularity"].scalar())
    )
    writers.write_by_k(modularity, run, "modularity")


def compare(spark: SparkSession, run: str, ks: list[int], has_confidence: bool) -> DataFrame:
    """Writes ``k_comparison`` and ``k_selection`` from the per-K tables of this run."""
    read = lambda t: spark.read.parquet(f"{run}/{t}").where(F.col("k").isin(ks))
    cossim = read("cossim_summary")

    def medians(combo: str, prefix: str) -> DataFrame:
        return cossim.where(F.col("combo") == combo).select(
            "k",
            F.col("median_spot").alias(f"{prefix}_spot"),
            F.col("median_gene").alias(f"{prefix}_gene"),
            *(
                [
                    F.col("median_spot_null").alias(f"{prefix}_spot_null"),
                    F.col("median_gene_null").alias(f"{prefix}_gene_null"),
                ]
                if combo == "hard-raw"
                else []
            ),
        )

    parts = [
        medians("hard-norm", "cossim_hard_norm"),
        medians("hard-raw", "cossim_hard_raw"),
        read("topology").select(
            "k",
            F.col("mean_self_zscore").alias("nhood_mean_self_zscore"),
            F.col("z_score").alias("local_purity_zscore"),
        ),
        read("modularity").select("k", "modularity_shared", "modularity_st_expression"),
    ]
    if has_confidence:
        parts.append(read("confidence_summary").select("k", F.col("mean").alias("mean_confidence")))
    frame = spark.createDataFrame([(k,) for k in ks], "k int")
    scored = kselect.score_metrics(kselect.collect_metrics(frame, parts))
    # One row per K.
    scored.coalesce(1).write.mode("overwrite").parquet(f"{run}/k_comparison")
    scored = spark.read.parquet(f"{run}/k_comparison")
    kselect.selection(scored).coalesce(1).write.mode("overwrite").text(f"{run}/k_selection")
    return scored.orderBy("k")


def run_pair(spark: SparkSession, sc_path: str, st_path: str, out: str, config: SweepConfig | None = None) -> DataFrame:
    """Sweeps one pair; returns the scored K table. Results are under ``<out>/<mapper>``."""
    config = config or SweepConfig()
    mapper = mappers.build_mapper(config.mapping)
    if config.linkage_method not in tree.METHODS:
        raise ValueError(f"linkage_method must be one of {tree.METHODS}")
    run = readers.run_folder(out, mapper.name)
    writers.write_config(spark, run, asdict(config))

    sc, st = readers.read_matrix(spark, sc_path), readers.read_matrix(spark, st_path)
    sc_obs, sc_counts = sc.obs, sc.counts
    if config.start_from_annotation:
        # All tables below start from the labelled rows.
        sc_obs = clusters.drop_unlabelled(sc_obs, config.start_from_annotation)
        sc_counts = sc_counts.join(sc_obs.select("obs_id"), "obs_id", "left_semi")
    shared = sc.var.distinct().join(st.var.distinct(), "feature", "left_semi").persist()
    key = writers.scaffold_key(
        spark, sc_path, st_path, shared, config.leiden_resolution, config.start_from_annotation
    )
    scaffold = writers.read_scaffold(spark, out, key)
    if scaffold is None:
        logger.info("building the reference scaffold")
        built = build_scaffold(sc_counts, sc_obs, shared, config)
        try:
            writers.write_scaffold(spark, out, built, key)
            scaffold = writers.read_scaffold(spark, out, key)
        except Exception:  # the cache only saves time for the next run
            logger.warning("the scaffold could not be cached under %s", out, exc_info=True)
        if scaffold is None:
            scaffold = {name: cut_lineage(part) for name, part in built.items()}

    start = scaffold["start"]
    sizes = _size_vector(start)
    n = len(sizes)
    writers.write_start_clustering(start, n, run)
    sums = scaffold["sums"]
    centroids = clusters.cluster_centroids(sums, clusters.cluster_sizes(start), shared)
    merges = tree.link_table(tree.distance_pairs(centroids, n), n, config.linkage_method)
    ks = tree.k_range(n, config.k_min, config.k_max, config.k_step)
    labels = tree.cuts(merges, ks, n)
    writers.write_by_k(tree.cut_frame(spark, labels), run, "cut")

    pair = mappers.PairContext(
        spark=spark,
        sc=normalize.lognorm_shared(sc_counts, shared),
        sc_obs=sc_obs,
        st=normalize.lognorm_shared(st.counts, shared),
        st_obs=st.obs,
        shared=shared,
        start=start,
        sums=sums,
        sizes=sizes,
        labels=labels,
        st_all=features.outer_concat([st.counts]),
    )
    try:
        mapper.prepare(pair)
        mapping, confidence = mapper.map()
        writers.write_by_k(mapping, run, "mapping")
        written = spark.read.parquet(f"{run}/mapping").where(F.col("k").isin(ks))
        assigned = nearest.hard_labels(written)
        if confidence is not None:
            assigned = assigned.join(confidence, ["k", "obs_id"])
        writers.write_by_k(assigned, run, "assignment")
        analyse(run, pair, scaffold, confidence is not None)
    finally:
        mapper.close()
    return compare(spark, run, sorted(ks), confidence is not None)


JOBS = "pair bigint, reference string, spatial string, folder string, status string, detail string"


def batch_jobs(spark: SparkSession, pairs_csv: str, sc_dir: str, st_dir: str) -> DataFrame:
    """One job per row of a pairs table, with the folders it reads and the one it writes."""
    number = F.col("PairID").cast("bigint")
    name = F.concat(F.lpad(number.cast("string"), 3, "0"), F.lit("_"), F.col("scName"), F.lit("__"), F.col("stName"))
    return readers.read_pairs(spark, pairs_csv).select(
        number.alias("pair"), F.concat(F.lit(f"{sc_dir}/"), "scName").alias("reference"), F.concat(F.lit(f"{st_dir}/"), "stName").alias("spatial"), name.alias("folder")
    )


def run_batch(
    spark: SparkSession, pairs_csv: str, sc_dir: str, st_dir: str, out: str, config: SweepConfig | None = None
) -> DataFrame:
    """Sweeps the pairs of a table and writes the table ``jobs``: what became of each, ``done``,
    ``missing`` (an input folder is absent) or ``failed``."""

    def status_of(job) -> tuple[str, str]:
        absent = [path for path in (job.reference, job.spatial) if not files.exists(spark, path)]
        if absent:
            return "missing", ", ".join(absent)
        try:
            run_pair(spark, job.reference, job.spatial, f"{out}/{job.folder}", config)
        except Exception as problem:  # the other jobs do not depend on this one
            logger.exception("sweep of %s", job.folder)
            return "failed", str(problem)
        return "done", ""

    finished = []
    for job in batch_jobs(spark, pairs_csv, sc_dir, st_dir).orderBy("pair").collect():  # jobs, not data
        finished.append((*job, *status_of(job)))
        spark.catalog.clearCache()
    spark.createDataFrame(finished, JOBS).write.mode("overwrite").parquet(f"{out}/jobs")
    return spark.read.parquet(f"{out}/jobs")
