"""The nearest-neighbour estimate against brute force over all pairs, on the same jittered points."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casekit.operators import neighbours as N


def psi(x):
    out = 0.0
    while x < 30:
        out -= 1 / x
        x += 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def brute(points, k=3):
    x, y = (np.array(c) for c in zip(*points))
    keep = np.array([np.sum(y == c) > 1 for c in y])
    x, y = x[keep], y[keep]
    total = 0.0
    for i in range(len(x)):
        same = np.flatnonzero((y == y[i]) & (np.arange(len(x)) != i))
        ky = min(k, len(same))
        r = np.sort(np.abs(x[same] - x[i]))[ky - 1]
        away = np.abs(x - x[i])
        m = np.sum(away < r) if r > 0 else np.sum(away <= 0)
        total += psi(ky) - psi(len(same) + 1) - psi(m)
    return max(0.0, psi(len(x)) + total / len(x))


@pytest.mark.parametrize("block", [10_000, 13])
def test_estimate_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.random() < 0.4), float(rng.normal()), float(rng.integers(0, 3)), 1.0) for i in range(240)]
    rows = [(i, y, x + 1.5 * y, c + (rng.random() < 0.5) * y, k) for i, y, x, c, k in rows] + [(900, 2, 0.0, 0.0, 1.0)]  # a class of one row
    df = spark.createDataFrame(rows, "primaryid long, serious int, a double, b double, c double").repartition(4)
    pts = N.points(df, ["a", "b", "c"], "serious", "primaryid", 42)
    want = {f: brute([(r.x, r.y) for r in pts.where(F.col("feature") == f).collect()]) for f in "abc"}
    got = {r.feature: r.score for r in N.mutual_information_knn(df, ["a", "b", "c"]).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    assert got["a"] > 0.15 and got["c"] < 0.05
    again = {r.feature: r.score for r in N.mutual_information_knn(df.coalesce(1), ["a", "b", "c"]).collect()}
    assert again == pytest.approx(got, abs=1e-12)


def test_repeated_ids_and_equal_points(spark):
    df = spark.range(60).select((F.col("id") % 5).alias("primaryid"), (F.col("id") % 2).cast("int").alias("serious"), F.lit(1.0).alias("a"))
    assert N.mutual_information_knn(df, ["a"]).first().score < 0.3
    x = spark.range(1, 40).select(N.digamma(F.col("id").cast("double")).alias("p"), F.col("id")).collect()
    assert all(abs(r.p - psi(r.id)) < 1e-10 for r in x)


def test_no_rank_table_is_broadcast(spark, monkeypatch):
    """The ranks have a row for each point: however small their checkpoint is thought to be, the driver must not collect them."""
    sent = []
    real = N.F.broadcast
    monkeypatch.setattr(N.F, "broadcast", lambda df: sent.append(df.columns) or real(df))
    df = spark.range(60).select(F.col("id").alias("primaryid"), (F.col("id") % 2).cast("int").alias("serious"), (F.col("id") % 7).cast("double").alias("a"))
    out = N.mutual_information_knn(df, ["a"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert all("x" not in columns for columns in sent)
