"""Principal components against an eigenvalue decomposition in numpy."""

import numpy as np
import pytest

from spotweave.operators import components


def rows(spark, x, parts=3):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "obs_id bigint, vec array<double>").repartition(parts)


def exact(x, size):
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    return values[::-1][:size], vectors[:, ::-1][:, :size]


@pytest.mark.parametrize("n, width, size", [(300, 600, 30), (500, 90, 30), (50, 12, 11), (40, 300, 30)])
def test_components_are_the_leading_eigenvectors(spark, n, width, size):
    rng = np.random.default_rng(n)
    x = rng.poisson(0.3, (n, width)) * rng.gamma(0.5, 2.0, width) + 5.0
    values, vectors = components.covariance_components(rows(spark, x), n, width, size)
    expected, own = exact(x, size)
    assert np.allclose(values, expected, rtol=1e-8)
    assert np.allclose(np.abs((vectors * own).sum(axis=0)), 1, atol=1e-6)
    assert (vectors[np.abs(vectors).argmax(axis=0), np.arange(size)] > 0).all()


def test_distances_in_all_components_are_those_of_the_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 70))
    got = {r["obs_id"]: r["vec"] for r in components.principal_components(rows(spark, x), 30).collect()}
    y = np.array([got[i] for i in range(60)])
    assert y.shape == (60, 30)
    assert np.allclose(np.linalg.norm(x[:, None] - x[None], axis=2), np.linalg.norm(y[:, None] - y[None], axis=2), atol=1e-8)


def test_equal_rows_and_too_few(spark):
    same = components.principal_components(rows(spark, np.ones((6, 4))), 30).collect()
    assert len(same) == 6 and all(len(r["vec"]) == 3 and np.allclose(r["vec"], same[0]["vec"]) for r in same)
    with pytest.raises(ValueError):
        components.principal_components(rows(spark, np.ones((1, 4))), 30)
    with pytest.raises(ValueError):
        components.principal_components(rows(spark, np.ones((3, 4))).limit(0), 30)
