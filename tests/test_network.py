"""The network against a plain NumPy loop, finite differences, and held-out quality."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from casekit.operators import models as M
from casekit.operators import network as N


def frame(spark, x, y):
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    names = [f"f{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame(rows, ["primaryid", *names, "serious"])
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(1)
    net, x, y = N.Network.start([4, 6, 5, 1], 3), rng.standard_normal((20, 4)), rng.integers(0, 2, 20)
    _, g = net.loss_and_gradient(x, y)
    at = 0
    for p in net.arrays():
        flat = p.reshape(-1)
        for i in range(0, flat.size, 3):
            old, got = flat[i], []
            for d in (1e-6, -1e-6):
                flat[i] = old + d
                got.append(net.loss_and_gradient(x, y)[0])
            flat[i] = old
            assert abs((got[0] - got[1]) / 2e-6 - g[at + i]) < 1e-4
        at += flat.size


def test_training_equals_a_numpy_loop(spark):
    """Same slices, same order of steps: weights and losses of every pass agree with a loop written out here."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1200, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = frame(spark, x, y)
    model = N.NetworkClassifier(hidden=(8, 4), max_iter=3, steps=4).fit(df)
    place = {r.primaryid: r.p for r in df.select("primaryid", F.pmod(F.xxhash64(F.col("primaryid").cast("string"), F.lit(42)), F.lit(1 << 30)).alias("p")).collect()}
    place = np.array([place[i] for i in range(1200)])
    held = place % 10 == 0
    slices = [~held & (place // 10 % 4 == i) for i in range(4)]
    net = N.Network.start([3, 8, 4, 1], 42)
    w, b = [v.copy() for v in net.weights], [v.copy() for v in net.biases]
    params = [v for pair in zip(w, b) for v in pair]
    m, v, t, order, best, kept = [0 * q for q in params], [0 * q for q in params], 0, np.random.default_rng(42), -1, None
    rate = min(0.01, 1e-3 * max(1, sum(s.sum() for s in slices) / 4 / 200) ** 0.5)
    for loss, score in model.passes:
        total = 0
        for i in order.permutation(4):
            a, n = [x[slices[i]]], slices[i].sum()
            for k in range(3):
                z = a[-1] @ w[k] + b[k]
                a.append(np.maximum(z, 0) if k < 2 else 1 / (1 + np.exp(-z)))
            q, target = a[-1][:, 0], y[slices[i]]
            total -= np.sum(target * np.log(q) + (1 - target) * np.log(1 - q))
            d, grads = (q - target)[:, None], [None] * 6
            for k in (2, 1, 0):
                grads[2 * k], grads[2 * k + 1] = (a[k].T @ d + 1e-4 * w[k]) / n, d.sum(0) / n
                d = (d @ w[k].T) * (a[k] > 0)
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t) * m[k] / (np.sqrt(v[k]) + 1e-8)
        z = np.maximum(np.maximum(x[held] @ w[0] + b[0], 0) @ w[1] + b[1], 0) @ w[2] + b[2]
        right = np.mean((z[:, 0] > 0) == (y[held] > 0))
        assert abs(loss - total / (~held).sum()) < 1e-9 and abs(score - right) < 1e-12
        if right > best:
            best, kept = right, [q.copy() for q in params]
    for q, r in zip(kept, model.net.arrays()):
        assert np.allclose(q, r, atol=1e-9)


def test_stops_after_passes_without_gain_and_learns(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 3))
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(int)
    model = N.NetworkClassifier(hidden=(16, 8), max_iter=60, patience=4).fit(frame(spark, x, y))
    scores = [s for _, s in model.passes]
    assert max(scores) > 0.9 and len(scores) <= 60
    if len(scores) < 60:  # stopped: no gain of tol in the last patience + 1 passes
        assert max(scores[-5:]) < max(scores[:-5]) + 1e-4
    got = M.positive_probability(model, frame(spark, x[:50], y[:50]), ["primaryid"]).collect()
    assert np.allclose([r.p for r in sorted(got)], model.net.probability(x[:50]))


def test_many_partitions_are_added_in_two_stages(spark):
    df = spark.range(4000).repartition(50).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    assert N._summed(df, lambda x, y: np.array([x.sum(), y.sum()]), 2, 50).tolist() == [3999 * 2000 + 4000, 2000]


def test_equal_rows_are_one_row_with_its_count_and_one_sum_leaves_a_step(spark, monkeypatch):
    """Every row three times: the gradient work sees each once, and the driver gets one vector from many partitions."""
    net, rng = N.Network.start([2, 4, 1], 1), np.random.default_rng(5)
    x, y, c = rng.standard_normal((30, 2)), rng.integers(0, 2, 30), rng.integers(1, 5, 30)
    one, many = net.loss_and_gradient(x, y, c), net.loss_and_gradient(np.repeat(x, c, 0), np.repeat(y, c))
    assert abs(one[0] - many[0]) < 1e-9 and np.allclose(one[1], many[1])
    got, real = [], N._summed
    monkeypatch.setattr(N, "_summed", lambda rows, partial, size, parts: got.append((rows.count(), rows.agg(F.sum("n")).first()[0], parts)) or real(rows, partial, size, parts))
    monkeypatch.setattr(N, "PART_ROWS", 20)
    df = frame(spark, np.tile(np.round(rng.standard_normal((700, 2)), 1), (3, 1)), np.arange(2100) % 7 // 4)
    distinct = df.select("f0", "f1", "serious").distinct().count()
    N.NetworkClassifier(hidden=(4,), max_iter=1, steps=2).fit(df)
    assert sum(n for _, n, _ in got) == 2100 and max(parts for *_, parts in got) > N.DRIVER_SUMS
    assert all(r <= min(distinct, n) for r, n, _ in got) and sum(r for r, *_ in got) < 2100
    rows = spark.range(400).repartition(8).select(F.array(F.col("id").cast("double")).alias("x"), F.lit(1).alias("y"))
    seen, frombuffer = [], np.frombuffer
    monkeypatch.setattr(N.np, "frombuffer", lambda v, *a: seen.append(1) or frombuffer(v, *a))
    assert real(rows, lambda x, y: np.array([x.sum()]), 1, 8).tolist() == [399 * 200] and len(seen) == 1
