"""Likeness of very long texts, of heavy terms, and the draws' distribution."""

import random
from collections import Counter

import numpy as np
import pytest

from casekit.llm import fingerprint


@pytest.mark.parametrize("n", [3_000, 300_000])
def test_likeness_of_long_texts(n):
    """256 samples from four pairs of texts; the true likeness is 0.8."""
    got = []
    for seed in range(4):
        rng = random.Random(seed)
        a = [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
        b = a[:int(n * 8 / 9)] + [f"v{rng.randrange(1 << 40)}" for _ in range(n - int(n * 8 / 9))]
        s = fingerprint.signatures([" ".join(a).encode(), " ".join(b).encode()])
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - 0.8) < 0.05 + 0.03 * (n < 10_000)


def test_heavy_terms_in_long_texts_weigh_by_their_counts():
    err = []
    for seed in range(12):
        rng = random.Random(seed)
        rare = [f"w{rng.randrange(1 << 40)}" for _ in range(4000)]
        a = rare + [f"x{seed} y{seed}"] * 1500
        b = rare[:3000] + [f"x{seed} y{seed}"] * 700 + [f"v{rng.randrange(1 << 40)}" for _ in range(500)]
        u, v = (Counter(zip(w, w[1:])) for w in (" ".join(a).split(), " ".join(b).split()))
        s = fingerprint.signatures([" ".join(a).encode(), " ".join(b).encode()])
        err.append((s[0] == s[1]).mean() - sum((u & v).values()) / sum((u | v).values()))
    assert abs(np.mean(err)) < 0.05


def test_draws_follow_their_distribution():
    y = np.random.default_rng(1).integers(0, 1 << 64, 400_000, dtype=np.uint64)
    c = np.exp(fingerprint._log_c(y).astype(float))
    assert abs(c.mean() - 2) < 0.02 and abs(c.var() - 2) < 0.05
    for x in (0.001, 0.05, 1.0, 4.0):
        assert abs((c < x).mean() - (1 - (1 + x) * np.exp(-x))) < 4e-3 + 4 * (x * x / 2 / 4e5) ** 0.5
    assert len(np.unique(c)) > 390_000
