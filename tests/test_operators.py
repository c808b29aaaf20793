import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.operators import clusters, features, graph, kselect, mappers, nearest, normalize, prep, quality, validate
from spotweave.operators.reindex import reindex_fill
from spotweave.sources import readers, writers

NAN = float("nan")


def counts(spark, rows):
    return spark.createDataFrame(rows, "obs_id bigint, feature string, x double")


def test_lognorm_of_zero_rows_is_zero(spark):
    got = normalize.lognorm(counts(spark, [(1, "A", 0.0), (2, "A", 1.0), (2, "B", 3.0)])).collect()
    want = {(1, "A"): 0.0, (2, "A"): np.log1p(2500), (2, "B"): np.log1p(7500)}
    assert {(r["obs_id"], r["feature"]): r["lx"] for r in got} == pytest.approx(want)


def test_empty_cluster_gets_the_small_centroid(spark):
    start = spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], "obs_id bigint, c int, name string")
    c = normalize.lognorm(counts(spark, [(1, "A", 4.0)]))
    sums = clusters.cluster_sums(c, start, {"x": "sx", "lx": "slx"})
    shared = spark.createDataFrame([("A",), ("B",)], "feature string")
    out = {(r["c"], r["feature"]): (r["m"], r["ml"]) for r in clusters.cluster_centroids(sums, clusters.cluster_sizes(start), shared).collect()}
    assert out[1, "A"] == out[1, "B"] == (1e-6, 0.0)
    assert out[0, "A"][0] == pytest.approx(4.0)


def test_empty_spot_is_assigned_to_state_zero(spark):
    start = spark.createDataFrame([(1, 0), (2, 1)], "obs_id bigint, c int")
    sc = normalize.lognorm(counts(spark, [(1, "A", 4.0), (2, "B", 2.0)]))
    st = normalize.lognorm(counts(spark, [(7, "B", 5.0)]))
    spots = spark.createDataFrame([(7,), (8,)], "obs_id bigint")
    sums = clusters.cluster_sums(sc, start, {"x": "sx", "lx": "slx"})
    dots = nearest.cluster_dots(st, spots, sums, 2)
    gram = np.diag([16.0, 4.0])
    weights = nearest.cut_weights(spark, {2: np.array([0, 1]), 1: np.array([0, 0])}, np.ones(2), gram, gram)
    got = {(r["k"], r["obs_id"]): r for r in nearest.nearest_assignment(nearest.state_scores(dots, weights)).collect()}
    assert got[2, 7]["state"] == 1 and got[2, 7]["sim"] == pytest.approx(1.0)
    assert got[2, 8]["state"] == 0 and got[2, 8]["confidence"] == pytest.approx(0.0, abs=1e-6)
    assert got[1, 8]["confidence"] == 1.0


def test_hard_labels_take_the_lowest_state_on_ties(spark):
    m = spark.createDataFrame([(2, 1, 1, 0.5), (2, 1, 0, 0.5), (2, 2, 1, 0.0), (2, 2, 0, 0.0)], "k int, obs_id bigint, state int, p double")
    assert {r["obs_id"]: r["state"] for r in nearest.hard_labels(m).collect()} == {1: 0, 2: 0}


def test_onehot_of_zero_row_and_single_state(spark):
    m = spark.createDataFrame(
        [(2, 1, 0, 0.0), (2, 1, 1, 0.0), (2, 2, 0, 2.0), (2, 2, 1, 2.0), (2, 3, 0, -1.0), (2, 3, 1, 1.0), (1, 1, 0, 1.0)],
        "k int, obs_id bigint, state int, p double",
    )
    got = {(r["k"], r["obs_id"]): (r["max_prob"], r["gini_impurity"], r["entropy"]) for r in quality.onehot_per_row(m).collect()}
    assert got[2, 1] == pytest.approx((0.0, 2.0, 0.0))
    assert got[2, 2] == pytest.approx((0.5, 1.0, 1.0))
    assert got[2, 3] == pytest.approx((1.0, 0.0, 0.0))
    assert got[1, 1] == (1.0, 0.0, 0.0)


def test_unlabelled_rows_drop_and_missing_column_raises(spark):
    obs = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "obs_id bigint, t string")
    got = {r["obs_id"]: (r["c"], r["name"]) for r in clusters.start_clusters_from_labels(obs, "t").collect()}
    assert got == {1: (1, "b"), 3: (0, "a")}
    with pytest.raises(KeyError):
        clusters.drop_unlabelled(obs, "nope")


def test_align_checks_features_and_rows(spark):
    a = counts(spark, [(1, "A", 1.0), (2, "A", 2.0)])
    with pytest.raises(ValueError, match="feature"):
        features.align(a, counts(spark, [(1, "Z", 1.0), (2, "Z", 1.0)]))
    with pytest.raises(ValueError, match="rows"):
        features.align(a, counts(spark, [(1, "A", 1.0)]))
    assert features.align(a, a).where("x = pred").count() == 2


def test_modularity_of_loops_and_reversed_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (3, 4), (2, 3)], "src bigint, dst bigint")
    g = graph.simple_graph(edges)
    assert g.count() == 3
    one = spark.createDataFrame([(0, i, 0) for i in range(1, 5)] + [(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 1)], "k int, obs_id bigint, state int")
    got = {r["k"]: r["modularity"] for r in graph.modularity_of_labels(g, one).collect()}
    assert got[0] == pytest.approx(0.0)
    assert got[1] == pytest.approx(2 / 3 - 2 * (3 / 6) ** 2)


def test_communities_find_two_cliques_and_keep_lone_rows(spark):
    clique = lambda ids: [(a, b) for a in ids for b in ids if a < b]
    edges = spark.createDataFrame(clique(range(6)) + clique(range(10, 16)) + [(0, 10)], "src bigint, dst bigint")
    everyone = spark.createDataFrame([(i,) for i in [*range(6), *range(10, 16), 99]], "obs_id bigint")
    got = {r["obs_id"]: r["c"] for r in graph.communities(edges, 1.0, vertices=everyone).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1
    assert len(set(got.values())) == 3


def test_skyline_and_best_k(spark):
    rows = [(1, 0.5, 0.5, 0.5), (2, 0.5, 0.5, 0.5), (3, 0.4, 0.5, 0.5), (4, NAN, NAN, NAN), (5, 0.1, 0.1, 0.9), (6, 0.5, 0.0, NAN)]
    t = spark.createDataFrame(rows, "k int, recon double, spatial double, coherence double")
    t = t.withColumn("overall", kselect.overall(t))
    front = {r["k"] for r in kselect.with_pareto(t).where("pareto").collect()}
    assert front == {1, 2, 5}
    best = {r["name"]: (r["k"], r["score"]) for r in kselect.best_ks(t).collect()}
    assert best["overall"] == (1, pytest.approx(0.5)) and best["coherence"] == (5, 0.9)
    gone = t.withColumn("recon", F.lit(NAN)).withColumn("overall", F.lit(NAN))
    best = {r["name"]: r["k"] for r in kselect.best_ks(gone).collect()}
    assert best["recon"] is None and best["overall"] is None


def test_score_table_without_columns_is_nan(spark):
    t = spark.createDataFrame([(1, 0.5, 0.5)], "k int, cossim_hard_raw_spot double, cossim_hard_raw_gene double")
    row = kselect.score_table(t).first()
    assert row["recon"] == 0.5 and np.isnan(row["spatial"]) and np.isnan(row["coherence_null"])


def test_validation_findings(spark):
    obs = spark.createDataFrame([(1,), (2,)], "obs_id bigint")
    bad = counts(spark, [(1, "A", -1.0), (1, "B", 2.5)])
    found = {(r["check"], r["severity"]) for r in validate.check_counts(bad, obs, "s").collect()}
    assert found == {("count_negative", "error"), ("small_max", "warn"), ("count_fractional", "warn"), ("row_empty", "warn")}
    nan = counts(spark, [(1, "A", NAN), (1, "B", -2.0)])
    assert "count_negative" not in {r["check"] for r in validate.check_counts(nan, obs, "s").collect()}
    var = spark.createDataFrame([("abc",), ("ABC",), ("ABC",)], "feature string")
    assert {r["check"]: r["n"] for r in validate.check_features(var, "s").collect()} == {"feature_case": 1, "feature_duplicate": 1}
    index = spark.createDataFrame([("d", "x", "3")], "Name string, CellCount string, GeneCount string")
    two = spark.createDataFrame([(2,)], "n bigint")
    got = validate.check_index_counts(index, "d", "s", {"CellCount": two, "GeneCount": two}).collect()
    assert [r["check"] for r in got] == ["index_GeneCount"]
    rows = {r["obs_id"] for r in validate.unique_ids(spark.createDataFrame([("a",), ("a",), ("b",)], "obs_id string")).collect()}
    assert rows == {"a", "a-1", "b"}


def test_noise(spark):
    c = counts(spark, [(1, "A", 10.0), (2, "B", 4.0)])
    obs = spark.createDataFrame([(1,), (2,)], "obs_id bigint")
    var = spark.createDataFrame([("A",), ("B",)], "feature string")
    assert prep.gaussian_noise(c, obs, var, 0.0).count() == 2
    a = sorted(map(tuple, prep.gaussian_noise(c, obs, var, 0.5).collect()))
    assert len(a) == 4 and a == sorted(map(tuple, prep.gaussian_noise(c, obs, var, 0.5).collect()))
    assert min(r[2] for r in a) >= 0


def test_reindex_keeps_values_and_fills(spark):
    m = spark.createDataFrame([(1, 0, 0.2), (1, 9, 1.0), (5, 0, 1.0)], "obs_id bigint, state int, p double")
    rows = spark.createDataFrame([(1,), (2,)], "obs_id bigint")
    got = sorted(map(tuple, reindex_fill(m, rows, 2).collect()))
    assert got == [(1, 0, 0.2), (1, 1, 0.0), (2, 0, 0.0), (2, 1, 0.0)]


def test_coordinates_must_be_complete(spark):
    obs = spark.createDataFrame([("1",), ("2",)], "obs_id string")
    cells = spark.createDataFrame([("1", 0.5, 0.5)], "cell_id string, x double, y double")
    with pytest.raises(ValueError, match="1 row"):
        prep.attach_coordinates(obs, cells, "cell_id", "x", "y")


def test_csv_sources(spark, tmp_path):
    (tmp_path / "exon.csv").write_text("gene,c1,c2\ng1,1,0\ng2,2,3\n")
    (tmp_path / "intron.csv").write_text("gene,c1,c2\ng1,1,0\ng2,0,1\n")
    both = readers.read_aligned_sum(spark, [f"{tmp_path}/exon.csv", f"{tmp_path}/intron.csv"])
    assert {(r["obs_id"], r["feature"]): r["x"] for r in both.collect()} == {("c1", "g1"): 2, ("c1", "g2"): 2, ("c2", "g2"): 4}
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    writers.tsv_to_csv(spark, f"{tmp_path}/t.tsv", f"{tmp_path}/t.csv")
    assert readers.read_csv_rows(spark, f"{tmp_path}/t.csv").collect()[0].asDict() == {"a": "1", "b": "2"}
    assert readers.read_index(spark, f"{tmp_path}/none") is None
    (tmp_path / "pairs.csv").write_text("PairID,scName\n0,a\n")
    with pytest.raises(ValueError, match="stName"):
        readers.read_pairs(spark, f"{tmp_path}/pairs.csv")


def test_bucketed_counts_need_no_shuffle_for_row_windows(spark, tmp_path):
    c = counts(spark, [(i % 50, f"F{i}", 1.0) for i in range(500)])
    spark.sql("DROP TABLE IF EXISTS counts_by_row")
    c.write.mode("overwrite").option("path", f"{tmp_path}/b").bucketBy(4, "obs_id").sortBy("obs_id").saveAsTable("counts_by_row")
    plan = normalize.lognorm(spark.table("counts_by_row"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE counts_by_row")


def test_mapper_registry(spark):
    with pytest.raises(ValueError):
        mappers.build_mapper("unknown")
    with pytest.raises(ValueError):
        mappers.register_aligner("wann", lambda *a: None)
    mappers.register_aligner("tangram", lambda pair, k, cells: None)
    assert mappers.build_mapper("tangram").name == "tangram"


def test_random_subset_takes_the_smallest_draws(spark, monkeypatch):
    from hashlib import md5

    ids = [i % 97 for i in range(300)] + [None, None]
    rows = spark.createDataFrame([(i, "x") for i in ids], "obs_id bigint, v string").repartition(3)
    known = sorted((md5(f"5:{i}".encode()).hexdigest(), i) for i in ids if i is not None)
    for digits, exact in ((4, 10_000), (1, 2), (1, 40)):
        monkeypatch.setattr(prep, "BUCKET_DIGITS", digits)
        monkeypatch.setattr(prep, "EXACT_ROWS", exact)
        for n in (0, 1, 50, 299, 300, 500):
            got = sorted(r["obs_id"] for r in prep.random_subset(rows, n, seed=5).collect())
            assert got == sorted(i for _, i in known[:n])
    empty = spark.createDataFrame([], "obs_id bigint, v string")
    assert prep.random_subset(empty, 5).collect() == []


def test_automatic_bins(spark):
    rows = [("a", v / 1000) for v in range(400, 1000)] + [("one", 1.0)] * 4 + [("null", None)]
    frame = spark.createDataFrame(rows, "key string, v double")
    got = {(r["key"], round(r["low"], 9)): (round(r["width"], 9), r["n"]) for r in quality.auto_histogram(frame, ["key"], "v").collect()}
    assert got.pop(("one", 1.0)) == (0.01, 4)
    assert len(got) == 30 and all(v == (0.02, 20) for v in got.values())


def test_features_without_variance_or_alone_in_a_bin(spark):
    cells = [(i, "flat", 5.0) for i in range(4)] + [(i, "low", 1.0 + i) for i in range(4)] + [(0, "high", 4000.0), (1, "high", 100.0)]
    counts = spark.createDataFrame(cells, "obs_id bigint, feature string, x double")
    n = spark.createDataFrame([(5,)], "n bigint")
    score = {r["feature"]: r["score"] for r in prep.top_variable_features(prep.feature_dispersion(counts, n), 2).collect()}
    assert score["high"] == 1.0 and len(score) >= 2


def test_boxes_of_a_table_equal_the_listed_ones(spark):
    rng = np.random.default_rng(4)
    spots = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-20, 20, (300, 2)))] + [(900, None, 1.0)], "obs_id bigint, px double, py double")
    corners = rng.integers(-20, 18, (40, 2))
    boxes = [(float(x), float(y), float(x + w), float(y + h)) for (x, y), (w, h) in zip(corners, rng.integers(0, 9, (40, 2)))] + [(-5.0, -19.0, 500.0, 3.0)]
    table = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)] + [(-7, 3.0, 3.0, 1.0, 9.0), (-8, None, 0.0, 9.0, 9.0)], "box int, x0 double, y0 double, x1 double, y1 double")
    want = {r["obs_id"]: r["box"] for r in prep.assign_boxes(spots, boxes).collect()}
    assert {r["obs_id"]: r["box"] for r in prep.assign_boxes_table(spots, table).collect()} == want
    assert {r["box"] for r in prep.assign_boxes_table(spots, table.where("box < 0")).collect()} == {-1}


def test_best_key_column_counts_every_key(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "key string")
    lookup = spark.createDataFrame([("b", "a", 1), ("b", "q", 2), (None, "b", 3)], "one string, two string, three int")
    assert features.best_key_column(keys, lookup) == ("two", 0.75)
    assert features.best_key_column(keys.where("key = 'z'"), lookup) == ("one", 0.0)
    assert features.best_key_column(keys.limit(0), lookup) == ("one", 0.0)
