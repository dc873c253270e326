"""The forest: pure leaves, brute-force splits, the same bags anywhere, large nodes by histograms, both scoring paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casekit.operators import forest as T
from casekit.operators import models as M

from .test_network import frame


def data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 30, n), rng.integers(0, 2, n), rng.integers(0, 8, n), rng.random(n).round(2)]).astype(float)
    return x, ((x[:, 0] > 12) ^ (x[:, 2] > 4) ^ (rng.random(n) < 0.1)).astype(int)


def test_grown_tree_has_pure_leaves_and_best_gini_cuts():
    x, y = data(300)
    x, w = x.astype(np.float32), np.stack([1.0 * (y == 0), 2.5 * (y == 1)], 1)
    f, cut, left, p, gains = T.grow(x, w, np.random.default_rng(0), tries=4)  # all features are tried
    leaf = T.walk(x, f, cut, left)
    for k in np.unique(leaf):
        rows = leaf == k
        assert f[k] < 0 and (len(np.unique(x[rows], axis=0)) == 1 or len(set(y[rows])) == 1)
        assert np.isclose(p[k], w[rows, 1].sum() / w[rows].sum())
    total = 0.0  # every node: no cut of any feature is better, and the gains add up
    for k in np.flatnonzero(f >= 0):
        rows = np.array([k in path(x[i], f, cut, left) for i in range(len(x))])
        score = lambda side: (w[side].sum(0) ** 2).sum() / w[side].sum() if side.any() else 0
        own = score(rows & (x[:, f[k]] <= cut[k])) + score(rows & (x[:, f[k]] > cut[k]))
        best = max(score(rows & (x[:, j] <= v)) + score(rows & (x[:, j] > v)) for j in range(4) for v in np.unique(x[rows, j])[:-1])
        assert np.isclose(own, best)
        total += own - score(rows)
    assert np.isclose(total, gains.sum())


def path(row, f, cut, left):
    out = [0]
    while f[out[-1]] >= 0:
        k = out[-1]
        out.append(left[k] + int(row[f[k]] > cut[k]))
    return out


def test_poisson_counts_follow_their_distribution():
    ids = np.arange(40_000)
    for mean in (0.3, 1.0, 7.0, 300.0):
        k = T.poisson(T.uniform(ids, 5, 1), np.full(len(ids), mean))
        assert abs(k.mean() - mean) < 5 * (mean / len(ids)) ** 0.5 and abs(k.var() / mean - 1) < 0.05
    again = T.bag(ids[::-1].copy(), np.ones((len(ids), 2), int), 3, 42, np.ones(2))[::-1]
    assert (again == T.bag(ids, np.ones((len(ids), 2), int), 3, 42, np.ones(2))).all()


@pytest.mark.parametrize("local", [None, 40])  # 40: large nodes are split by histograms, leaves above subtrees may occur
def test_forest_is_pure_on_its_bags_and_both_scoring_paths_agree(spark, local, monkeypatch):
    x, y = data()
    df = frame(spark, x, y).withColumn("weight", F.when(F.col("serious") == 1, 1.5).otherwise(0.75)).repartition(5)
    model = T.ForestClassifier(trees=6, local_rows=local, weight_col="weight").fit(df)
    assert (len(model.tops[0].feature) > 1) == (local is not None)
    subtrees = {(r.tree, r.root): r for r in model.subtrees.collect()}
    vectors = {}
    for row, t in zip(x.astype(np.float32), y):
        vectors.setdefault(tuple(row.tolist()), [0, 0])[t] += 1
    keys = list(vectors)
    ids = [r.id for r in spark.createDataFrame([(i, list(k)) for i, k in enumerate(keys)], "i int, x array<float>").orderBy("i").select(F.xxhash64("x").alias("id")).collect()]
    counts, arr, p = np.array([vectors[k] for k in keys]), np.array(keys, np.float32), np.zeros(len(keys))
    for t in range(6):
        w, at, top = T.bag(np.array(ids), counts, t, 42, np.array([0.75, 1.5])), model.tops[t].route(arr), model.tops[t]
        for i in range(len(keys)):
            if top.leaf[at[i]]:
                q = top.p[at[i]]
                assert q in (0.0, 1.0)
            else:
                s = subtrees[t, at[i]]
                f, cut, left = np.frombuffer(s.feature, np.int8), np.frombuffer(s.cut, np.float32), np.frombuffer(s.left, np.int32)
                q = np.frombuffer(s.p)[T.walk(arr[i:i + 1], f, cut, left)[0]]
            p[i] += q / 6
            if w[i].sum():  # distinct vectors, so a leaf that holds this one holds nothing of another class
                assert np.isclose(q, w[i, 1] / w[i].sum())
    want = dict(zip(keys, p))
    sent = M.positive_probability(model, df, ["primaryid"])
    monkeypatch.setattr(T, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(T, "LOCAL_ROWS", 100)
    met = M.positive_probability(model, df, ["primaryid"])
    a, b = ({r.primaryid: r.p for r in s.collect()} for s in (sent, met))
    assert len(a) == len(x) and a == b
    assert all(abs(a[i] - want[tuple(np.float32(x[i]).tolist())]) < 1e-9 for i in range(len(x)))
    assert abs(model.importances.sum() - 1) < 1e-9 and model.importances[0] > model.importances[1]


def test_same_forest_on_any_partitioning_and_one_class(spark):
    x, y = data(200)
    df = frame(spark, x, y)
    a, b = (T.ForestClassifier(trees=3).fit(d).subtrees.orderBy("tree").drop("gains").collect() for d in (df.coalesce(1), df.repartition(7)))
    assert a == b
    one = T.ForestClassifier(trees=2).fit(frame(spark, x, np.ones(len(y))))
    assert {r.p for r in M.positive_probability(one, df, []).collect()} == {1.0}


@pytest.mark.parametrize("piece", [1 << 40, 4000])  # one piece, many pieces (some may be empty)
def test_a_large_model_meets_a_vector_once_for_each_piece(spark, monkeypatch, piece):
    """Scores by pieces equal the broadcast ones, and nothing is dealt by tree: no step unfolds a vector for every tree."""
    x, y = data(300)
    df = frame(spark, x, y).repartition(3)
    model = T.ForestClassifier(trees=12, local_rows=40).fit(df)
    sent = {r.primaryid: r.p for r in M.positive_probability(model, df, ["primaryid"]).collect()}
    monkeypatch.setattr(T, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(T, "PIECE_BYTES", piece, raising=False)
    monkeypatch.setattr(T, "SCORE_ROWS", 100, raising=False)
    met = M.positive_probability(model, df, ["primaryid"])
    assert {r.primaryid: r.p for r in met.collect()} == sent
    assert "MapInArrow" not in met._jdf.queryExecution().toString()
