"""Batched k-means against a loop over restarts; the silhouette against all pairs."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from casekit.operators import lloyd as L


def frame(spark, x, extra=()):
    names = [f"f{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame([(*map(float, r), *e) for r, e in zip(x, extra or [()] * len(x))], [*names, *(["cluster"] if len(extra) else [])])
    return VectorAssembler(inputCols=names, outputCol="features").transform(df).repartition(3)


def blobs(n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.6, (n, 2)) + rng.choice([0.0, 3.0, 7.0], n)[:, None]
    return np.vstack([x.round(1), x[:30].round(1)])  # repeated rows


def loop(x, centres, tol=1e-4, max_iter=300):
    for _ in range(max_iter):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(len(centres))])
        shift, centres = ((new - centres) ** 2).sum(), new
        if shift <= tol * x.var(0).mean():
            break
    return centres, ((x[:, None] - centres) ** 2).sum(2).min(1).sum()


def test_all_restarts_end_where_single_ones_do(spark):
    x = blobs()
    df = frame(spark, x)
    starts = L.seeds(L.distinct_vectors(df, "features"), 3, 5, 42)
    assert all(any((r == c).all() for r in x) for s in starts for c in s)
    fits = [loop(x, s) for s in starts]
    model = L.fit(df, restarts=5)
    best = min(range(5), key=lambda r: (round(fits[r][1], 9), r))
    assert np.isclose(model.cost, min(c for _, c in fits)) and np.allclose(model.centres, fits[best][0])
    got = {tuple(r.features): r.cluster for r in model.transform(df).collect()}
    assert all(v == ((np.array(k) - model.centres) ** 2).sum(1).argmin() for k, v in got.items())


def test_empty_clusters_move_to_the_farthest_vector(spark):
    x = np.array([[0.0], [0.1], [5.0]])
    vectors = L.distinct_vectors(frame(spark, x), "features")
    new, cost = L.moved(vectors, {0: np.array([[0.0], [100.0]])})[0]
    assert new[1].tolist() == [5.0] and np.isclose(cost, 25.01)
    one = L.fit(frame(spark, np.ones((4, 2))), k=3, restarts=2)
    assert one.cost == 0


def pairs(x, c):
    away = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        same = (c == c[i]) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a, b = away[i, same].mean(), min(away[i, c == k].mean() for k in set(c) - {c[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("group", [2_000, 40])
def test_silhouette_equals_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(L, "GROUP", group)
    x = blobs()
    c = ((x[:, None] - np.array([[0.0, 0.0], [3.0, 3.0], [7.0, 7.0]])) ** 2).sum(2).argmin(1)
    c[0] = 3  # a cluster of its own
    x[0] = 9.9
    value, low, high = L.silhouette(frame(spark, x, [(int(v),) for v in c]))
    assert np.isclose(value, pairs(x, c)) and np.isclose(low, value) and np.isclose(high, value)


def test_bounds_hold_where_cells_stand_for_vectors(spark, monkeypatch):
    x = blobs()
    c = ((x[:, None] - np.array([[0.0, 0.0], [3.0, 3.0], [7.0, 7.0]])) ** 2).sum(2).argmin(1)
    df = frame(spark, x, [(int(v),) for v in c])
    for cells in (64, 4096):
        monkeypatch.setattr(L, "CELLS", cells)
        value, low, high = L.silhouette(df, exact_vectors=10)
        assert low <= pairs(x, c) <= high and low <= value <= high
    assert high - low < 0.5
    assert L.silhouette(df.withColumn("cluster", F.lit(0))) == (0.0, 0.0, 0.0)
