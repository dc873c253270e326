"""Bisector tournament against brute force over Python integers; edge rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from casekit.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance double"


def brute(rows, k=16, rounds=3, scale=64, dim=64):
    kept = [(i, [max(-clusters.LIMIT, min(clusters.LIMIT, math.floor(scale * x))) if abs(scale * x) < 1e300 else int(math.copysign(clusters.LIMIT, x)) for x in v])
            for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in hashed[:k]]
    if not c:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else m for j, m in enumerate(c)]
    got = [(i, near(v)) for i, v in kept]
    top = (1 << 63) - 1
    own = {j: min(top, sum(d for _, (d, m) in got if m == j)) for j in range(k)}
    whole = min(top, sum(d for _, (d, _) in got))
    return sorted((i or -1, j, d, own[j], whole, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, (d, j) in got)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], SCHEMA)  # clashing extra columns
    return sorted((r.vec_id or -1, *r[1:]) for r in clusters.cluster(df).collect())


@pytest.mark.parametrize("kind", ["plain", "few", "ties", "huge", "none"])
def test_clusters_match_brute_force(spark, kind):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range({"few": 9, "none": 0}.get(kind, 150))]
    if kind == "ties":  # few distinct vectors, many on the planes between centroids, repeated rows and ids
        rows = [(i % 60, [float(rng.randrange(2)) / 64 * (d < 3) for d in range(64)]) for i in range(150)]
    if kind == "huge":
        rows += [(900, [1e30] * 64), (901, [-1e305] * 64), (902, [1e30, -1e30] * 32), (903, [-1e30] * 64)]
    if kind != "none":
        rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [float("nan")] + [0.0] * 63),
                 (505, [float("inf")] + [0.0] * 63), (506, [None] + [0.0] * 63), (None, [0.25] * 64), (3, rows[3][1]), (3, rows[3][1])]
    assert run(spark, rows) == brute(rows)


def test_zero_favours_the_smaller_number():
    game = clusters.Tournament(np.array([[0, 0], [2, 0], [2, 0], [0, 2]]))
    x = np.array([[1, 0], [1, 1], [2, 0], [5, 5], [0, 1]], np.int64)
    assert game.nearest(x).tolist() == [0, 0, 1, 1, 0]
    assert game.distance(x, game.nearest(x)).tolist() == [1, 2, 0, 34, 1]
