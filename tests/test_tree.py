import numpy as np
import pytest

from spotweave.operators import tree


def points(n=12, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, 4))
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def test_average_heights_are_mean_distances():
    d = points()
    merges = tree.link(d, "average")
    members = {i: [i] for i in range(len(d))}
    for step, (a, b, height, size) in enumerate(merges):
        left, right = members[int(a)], members[int(b)]
        assert height == pytest.approx(d[np.ix_(left, right)].mean())
        members[len(d) + step] = left + right
        assert size == len(left + right)


@pytest.mark.parametrize("method", tree.METHODS)
def test_cuts_are_nested_and_have_k_groups(method):
    d = points(15, 2)
    labels = tree.cuts(tree.link(d, method), tree.k_range(15), 15)
    for k in range(1, 16):
        assert len(set(labels[k])) == k
    for k in range(2, 16):
        # Every group of cut k lies inside one group of cut k - 1.
        for s in range(k):
            assert len(set(labels[k - 1][labels[k] == s])) == 1


def test_identity_cut_and_errors():
    d = points(4)
    merges = tree.link(d)
    assert tree.cut_labels(merges, 9, 4).tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        tree.link(d, "single")
    with pytest.raises(ValueError):
        tree.link(np.zeros((1, 1)))
    with pytest.raises(ValueError):
        tree.link(np.full((3, 3), np.nan))


def test_k_range_zero_counts_as_unset():
    assert tree.k_range(5, 0, 0) == [5, 4, 3, 2, 1]
    assert tree.k_range(9, 2, 7, 2) == [7, 5, 3]
    for bad in ({"k_step": 0}, {"k_min": 8}):
        with pytest.raises(ValueError):
            tree.k_range(5, **bad)


def by_definition(d, method):
    """Greedy merging by the mean distances between and within groups."""
    groups, out = [[i] for i in range(len(d))], []
    mean = lambda a, b: d[np.ix_(a, b)].mean()
    while len(groups) > 1:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = groups[i], groups[j]
                h = mean(a, b)
                if method == "ward":
                    h = 2 * len(a) * len(b) / (len(a) + len(b)) * (h - mean(a, a) / 2 - mean(b, b) / 2)
                if best is None or h < best[0]:
                    best = (h, i, j)
        h, i, j = best
        groups[i] = groups[i] + groups.pop(j)
        out.append((h if method == "average" else np.sqrt(h), sorted(map(sorted, groups))))
    return out


def groups_of(labels):
    return sorted(sorted(np.flatnonzero(labels == s).tolist()) for s in set(labels.tolist()))


@pytest.mark.parametrize("method", tree.METHODS)
def test_chain_finds_the_greedy_tree(method):
    d = points(30, 5)
    merges = tree.link(d, method)
    for step, (height, groups) in enumerate(by_definition(d, method)):
        assert merges[step, 2] == pytest.approx(height)
        assert groups_of(tree.cut_labels(merges, 29 - step, 30)) == groups


@pytest.mark.parametrize("method", tree.METHODS)
def test_rounds_in_spark_find_the_same_tree(spark, method):
    d = points(40, 6)
    rows = [(i, j, float(d[i, j])) for i in range(40) for j in range(i + 1, 40)]
    pairs = spark.createDataFrame(rows, "a int, b int, d double")
    want = tree.link(d, method)
    for most in (40, 25, 1):
        got = tree.link_table(pairs, 40, method, most)
        assert np.allclose(got, want)


def test_every_group_is_an_interval_of_the_leaf_order():
    d = points(25, 7)
    cut = tree.cuts(tree.link(d), tree.k_range(25), 25)
    assert sorted(cut.order.tolist()) == list(range(25))
    for k, labels in cut.items():
        along = labels[cut.order]
        assert 1 + (along[1:] != along[:-1]).sum() == k == len(set(labels.tolist()))
        first = [int(np.flatnonzero(labels == s)[0]) for s in range(k)]
        assert first == sorted(first)


def test_equal_distances_give_every_k():
    d = np.ones((9, 9)) - np.eye(9)
    for method in tree.METHODS:
        cut = tree.cuts(tree.link(d, method), tree.k_range(9), 9)
        assert [len(set(cut[k].tolist())) for k in range(1, 10)] == list(range(1, 10))


def test_cut_frame_of_a_tree(spark):
    cut = tree.cuts(tree.link(points(11, 8)), [11, 4, 1], 11)
    rows = {(r["k"], r["c"]): r["state"] for r in tree.cut_frame(spark, cut).collect()}
    assert rows == {(k, c): int(s) for k, labels in cut.items() for c, s in enumerate(labels)}
