"""Impact-ordered search against brute force over Python integers; edge rows, ties, equal vectors."""

import math
import random

import numpy as np
import pytest

from casekit.llm import topk

SCHEMA = "vec_id long, embedding array<double>, rank string, score string"


def brute(rows, k=5, every=50, scale=256):
    lim = topk.LIMIT
    whole = lambda x: max(-lim, min(lim, math.floor(max(-1e18, min(1e18, scale * x)))))
    kept = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(kept):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(kept) if m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows):
    return sorted(map(tuple, topk.search(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()))


@pytest.mark.parametrize("kind", ["plain", "ties", "edge", "huge", "few", "none"])
def test_search_matches_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "CHUNK", 3)
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 0.125) for _ in range(16)]) for i in range({"few": 3, "none": 0}.get(kind, 400))]
    if kind == "ties":  # a third equal, few distinct scores
        rows = [(i, [0.5] * 6 if i % 3 == 0 else [float(rng.randrange(-1, 2)) for _ in range(6)]) for i in range(400)]
    if kind == "edge":
        rows += [(450, None), (451, []), (500, []), (452, [1.0]), (550, [1.0] * 20), (453, [float("nan")] * 16), (600, [float("-inf")] + [0.0] * 15),
                 (650, [None] + [0.0] * 15), (None, [3.0] * 16), (50, rows[50][1]), (50, [0.3] * 16), (7, rows[7][1]), (-100, [0.1] * 16)]
    if kind == "huge":
        rows += [(1000 + 50 * i, [rng.choice([1e30, -1e300, 2e5, 0.1]) for _ in range(16)]) for i in range(12)]
    assert run(spark, rows) == brute(rows)


def test_bounds_rule_out_no_member_and_reading_stops_early():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((3000, 32)) * np.geomspace(400, 1, 32)).astype(np.int64)  # impacts fall quickly
    order, bounds = topk.segments(x)
    row = {"n": 3000, "dim": 32, "vectors": x.astype(np.int32).tobytes(), "counts": np.ones(3000, np.int32).tobytes(), "ids": np.arange(3000).tobytes(),
           "segments": order.astype(np.int32).tobytes(), "bounds": bounds.astype(np.int32).tobytes()}
    block, possible = topk.Block(row), 0
    for q in x[:40]:
        s = x @ q
        want = np.lexsort((np.arange(3000), -s))[:6]
        rows = block.possible(q, 6, None)
        assert set(want) <= set(rows)
        possible += len(rows)
        score, ids = block.best(q, 6, None)
        assert ids.tolist() == want.tolist() and score.tolist() == s[want].tolist()
        score, ids = block.best(q, 6, int(s[want[2]]))
        assert ids.tolist() == want[:3].tolist()
    assert possible < 0.15 * 40 * 3000
