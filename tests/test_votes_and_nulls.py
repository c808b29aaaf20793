import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.functions.indexing import ordered_index
from spotweave.operators import coherence, knn, spatial, wann
from spotweave.operators.nulls import LabelShuffle, permute


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permute_is_a_bijection(n):
    for draw in range(3):
        assert sorted(permute(np.arange(n), n, 0, draw)) == list(range(n))
    if n > 7:
        assert (permute(np.arange(n), n, 0, 0) != permute(np.arange(n), n, 0, 1)).any()


def test_shuffled_labels_keep_their_counts_and_look_uniform():
    counts = [50, 0, 30, 20]
    shuffle = LabelShuffle.from_counts(counts)
    share = np.zeros(100)
    for draw in range(400):
        lab = shuffle.labels(np.arange(100), draw)
        assert np.bincount(lab, minlength=4).tolist() == counts
        share += lab == 0
    # Every row holds label 0 in about half of the draws.
    assert abs(share / 400 - 0.5).max() < 0.12


def test_spatial_null_equals_a_direct_count_and_its_closed_form(spark):
    rng = np.random.default_rng(0)
    n, draws = 200, 100
    state = rng.integers(0, 3, n)
    spots = spark.createDataFrame(
        [(int(i), float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(size=(n, 2)))], "obs_id bigint, px double, py double"
    )
    assigned = spark.createDataFrame(
        [(k, int(i), int(s if k == 3 else s % 2)) for k in (2, 3) for i, s in enumerate(state)], "k int, obs_id bigint, state int"
    )
    edges = spatial.spatial_graph(spots).persist()
    assert edges.count() == n * 6
    counts = spatial.label_counts(assigned)
    # The numbers of the spots are their ids here.
    index = ordered_index(spots.select("obs_id"), ["obs_id"])
    got = spatial.edge_counts(edges, assigned, counts, index, draws).toPandas()
    pdf = edges.select(F.col("src").alias("i"), F.col("dst").alias("j")).toPandas()
    assert got[(got.k == 3) & (got.draw == -1) & (got.state == -1)]["n"].item() == n * 6
    own = state[pdf["i"]][state[pdf["i"]] == state[pdf["j"]]]
    assert got[(got.k == 3) & (got.draw == -1) & (got.state >= 0)].sort_values("state")["n"].tolist() == np.bincount(own, minlength=3).tolist()
    shuffle = LabelShuffle.from_counts(counts[3])
    for draw in (0, 7):
        a, b = shuffle.labels(pdf["i"].to_numpy(), draw), shuffle.labels(pdf["j"].to_numpy(), draw)
        want = np.bincount(a[a == b], minlength=3)
        have = got[(got.k == 3) & (got.draw == draw)].sort_values("state")["n"].to_numpy()
        assert have.tolist() == want.tolist()
    out = {r["k"]: r for r in spatial.spatial_organisation(spots, assigned, edges).collect()}
    closed = {r["k"]: r["expected"] for r in spatial.expected_purity(assigned).collect()}
    for k in (2, 3):
        assert out[k]["null_mean"] == pytest.approx(closed[k], abs=0.01)
        assert 0 <= out[k]["p_value"] <= 1 and out[k]["n_states"] == k


def test_one_state_has_purity_one_and_no_enrichment(spark):
    spots = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "obs_id bigint, px double, py double")
    one = spots.select(F.lit(1).alias("k"), "obs_id", F.lit(0).alias("state"))
    row = spatial.spatial_organisation(spots, one, n_perm=5).first()
    assert row["observed"] == 1.0 and row["z_score"] == 0.0 and row["mean_self_zscore"] is None
    with pytest.raises(ValueError):
        spatial.spatial_organisation(spots.where("obs_id < 5"), one)


def test_adaptive_votes_equal_a_plain_restatement(spark):
    rng = np.random.default_rng(4)
    n_ref, n_spot, width = 40, 12, 21
    c = rng.integers(0, 4, n_ref)
    nn = np.array([rng.permutation([j for j in range(n_ref) if j != i])[:width] for i in range(n_ref)])
    sn = np.array([rng.permutation(n_ref)[:width] for _ in range(n_spot)])
    frame = lambda m: spark.createDataFrame(
        [(i, int(j), r + 1) for i, row in enumerate(m) for r, j in enumerate(row)], "obs_id bigint, nbr bigint, rank int"
    )
    start = spark.createDataFrame([(i, int(s)) for i, s in enumerate(c)], "obs_id bigint, c int")
    labels = {1: np.zeros(4, int), 2: np.array([0, 1, 0, 1]), 4: np.arange(4)}
    grid = [11, 13, 15, 17, 19, 21]
    found = wann.reliability(frame(nn), start, labels, grid).persist()
    sizes = {(r["k"], r["obs_id"]): r["size"] for r in wann.explode_sizes(found, list(labels)).collect()}
    votes = {(r["k"], r["obs_id"], r["state"]): r["p"] for r in wann.adaptive_vote(frame(sn), found, labels, grid).collect()}
    for k, lab in labels.items():
        want = {}
        for i in range(n_ref):
            size = 21
            for kp in grid:
                t = np.zeros(k)
                for j in range(kp):
                    t[lab[c[nn[i, j]]]] += 1 + 1e-4 * (21 - j)
                if t.argmax() == lab[c[i]]:
                    size = kp
                    break
            want[i] = size
            assert sizes[k, i] == size
        for i in range(n_spot):
            p = np.zeros(k)
            for j in range(want[sn[i, 0]]):
                p[lab[c[sn[i, j]]]] += 1 / want[sn[i, j]]
            p /= p.sum()
            got = [votes.get((k, i, s), 0.0) for s in range(k)]
            assert np.allclose(got, p)


def test_reliability_grid_clamps():
    assert wann.reliability_grid(1000)[-1] == 51
    assert wann.reliability_grid(20) == [11, 13, 15, 17, 19]
    assert wann.reliability_grid(6) == [5]


def test_merge_coherence_draws_like_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(6, 5)))
    cos = coherence.centroid_cosines(x @ x.T)
    labels = {2: np.array([0, 0, 0, 1, 1, 1]), 6: np.arange(6), 1: np.zeros(6, int)}
    rows = {(r["k"], r["state"]): r for r in coherence.merge_coherence(spark, cos, np.ones(6, bool), labels).collect()}
    g = np.random.default_rng(1)
    pick = lambda m: cos[np.ix_(m, m)][np.triu_indices(len(m), 1)].mean()
    null = np.array([pick(g.choice(np.array([0, 1, 2]), size=3, replace=False)) for _ in range(200)])
    row = rows[2, 1]
    assert row["mean_cossim"] == pytest.approx(pick([3, 4, 5]))
    assert row["null_mean"] == pytest.approx(null.mean())
    assert rows[6, 0]["skipped_reason"] == coherence.FEW and rows[1, 0]["skipped_reason"] == coherence.NO_OTHERS
    summary = {r["k"]: r for r in coherence.coherence_summary(spark.createDataFrame(list(rows.values()))).collect()}
    assert summary[2]["n_tested_states"] == 2 and summary[6]["mean_cossim"] is None


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_votes_of_equal_rows_are_worked_out_from_one_list(spark, monkeypatch, most):
    monkeypatch.setattr(wann, "BROADCAST_ROWS", most)
    rng = np.random.default_rng(12)
    # Groups of copies larger and smaller than a list, single rows and a row without neighbours' labels.
    points = np.vstack([np.repeat(rng.poisson(2.0, size=(3, 5)), 70, axis=0), np.repeat(rng.poisson(2.0, size=(20, 5)), 3, axis=0), rng.poisson(2.0, size=(40, 5))]).astype(float)
    rows = [(int(i), points[i].tolist(), int(rng.integers(0, 4))) for i in rng.permutation(len(points))]
    cells = spark.createDataFrame(rows, "obs_id bigint, vec array<double>, c int").persist()
    spots = spark.createDataFrame([(i, (points[i * 7] + (i % 3 == 0)).tolist()) for i in range(30)] + [(100 + i, points[0].tolist()) for i in range(9)], "obs_id bigint, vec array<double>")
    start = cells.where("obs_id % 11 <> 5").select("obs_id", "c")
    labels = {k: np.arange(4) % k for k in (1, 2, 3, 4)}
    grid = wann.reliability_grid(cells.count())
    plain = wann.reliability(knn.knn_join(cells, cells, grid[-1], self_join=True), start, labels, grid).persist()
    groups, top, n = knn.knn_groups(cells, cells, grid[-1], self_join=True)
    assert n == cells.select("vec").distinct().count()
    assert top.count() == n * (grid[-1] + 1) < cells.count() * grid[-1]
    got = wann.reliability(top, start, labels, grid, (groups, n))
    flat = lambda df: sorted((r["obs_id"], r["c"], tuple(r["sizes"])) for r in df.collect())
    assert flat(got) == flat(plain)
    want = wann.adaptive_vote(knn.knn_join(spots, cells, grid[-1]), plain, labels, grid)
    groups, top, n_spots = knn.knn_groups(spots, cells, grid[-1])
    voted = wann.adaptive_vote(top, plain, labels, grid, (groups, n_spots))
    rounded = lambda df: sorted((r["k"], r["obs_id"], r["state"], round(r["p"], 9)) for r in df.collect())
    assert rounded(voted) == rounded(want) and voted.select("obs_id").distinct().count() == 39
