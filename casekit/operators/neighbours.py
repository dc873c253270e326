"""Mutual information of continuous features with a class by nearest neighbours (O-42), the reference's estimator.

For each row and feature: r is the distance to the k-th nearest row of the same class, m the number of rows of any class
nearer than r (itself included). The estimate is psi(n) + mean psi(k) - mean psi(rows of its class) - mean psi(m), at least 0.
Features are divided by their standard deviation and moved by a seeded jitter of 1e-10 of their size, which parts equal values.

Everything happens on exact ranks, so no window spans a table: rows of a feature and class get their place in the order of
values, places are cut into blocks of ``BLOCK`` with the ``k`` rows next to each border sent to both sides, and m is the
difference of two ranks among all rows of the feature. A class with a single row takes no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casekit import config as C
from casekit.operators import ranking as R

BLOCK = 10_000


def digamma(x: Column) -> Column:
    """Logarithmic derivative of the gamma function for x >= 1: six steps up, then the asymptotic series."""
    z = x + 6.0
    w = 1.0 / (z * z)
    series = F.log(z) - 0.5 / z - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))
    return series - sum((1.0 / (x + float(i)) for i in range(1, 6)), 1.0 / x)


def jitter(key: str, feature: Column, seed: int) -> Column:
    """Standard normal number from a hash of seed, feature and row."""
    u = lambda salt: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), feature, F.col(key).cast("string"), F.col("_copy").cast("string"))),
                                         1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2.0 * F.log(u("a"))) * F.cos(2 * math.pi * u("b"))


def points(df: DataFrame, features: list[str], label: str, key: str, seed: int) -> DataFrame:
    """``feature, y, x``: scaled and jittered values, one row for each row and feature; checkpointed."""
    scale = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)],
                   *[F.avg(F.abs(F.col(c).cast("double"))).alias(f"a{i}") for i, c in enumerate(features)]).first()
    numbered = df.withColumn("_copy", F.xxhash64(F.monotonically_increasing_id())) if _repeats(df, key) else df.withColumn("_copy", F.lit(0))
    each = []
    for i, c in enumerate(features):
        s = scale[f"s{i}"] or 1.0
        size = max(1.0, (scale[f"a{i}"] or 0.0) / s)
        each.append(F.struct(F.lit(c).alias("feature"), (F.col(c).cast("double") / s).alias("v"), F.lit(1e-10 * size).alias("size")))
    long = numbered.select(key, "_copy", F.col(label).alias("y"), F.explode(F.array(*each)).alias("e"))
    return long.select("e.feature", "y", (F.col("e.v") + F.col("e.size") * jitter(key, F.col("e.feature"), seed)).alias("x")).checkpoint()


def _repeats(df: DataFrame, key: str) -> bool:
    return bool(df.groupBy(key).count().where("count > 1").limit(1).count())


def radii(pts: DataFrame, k: int) -> DataFrame:
    """``feature, y, x, n_y, k_y, r, kth`` of every point of a class with more than one row (``kth``: the neighbour itself)."""
    ranks = R.rank_distinct(pts, "x", ["feature", "y"]).select("feature", "y", "x", "before", "cnt")
    sizes = ranks.groupBy("feature", "y").agg(F.sum("cnt").alias("n_y")).where("n_y > 1")  # a row for each feature and class
    placed = ranks.withColumn("pos", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("cnt") - 1)))
    block, at = F.floor(F.col("pos") / BLOCK), F.col("pos") % BLOCK
    near = F.array_compact(F.array(block, F.when(at < k, block - 1), F.when(at >= BLOCK - k, block + 1)))
    dealt = placed.select("feature", "y", "x", "pos", block.alias("own"), F.explode(near).alias("block"))
    w = Window.partitionBy("feature", "y", "block").orderBy("pos")
    side = lambda v: F.when(v.isNotNull(), F.struct(F.abs(v - F.col("x")).alias("r"), v.alias("kth")))
    sides = [side(f("x", i).over(w)) for i in range(1, k + 1) for f in (F.lag, F.lead)]
    found = dealt.withColumn("near", F.array_sort(F.array_compact(F.array(*sides)))).where("own = block")
    k_y = F.least(F.lit(k), F.col("n_y") - 1)
    return found.join(F.broadcast(sizes), ["feature", "y"]).select("feature", "y", "x", "n_y", k_y.alias("k_y"), F.inline(F.array(F.element_at("near", k_y.cast("int")))))


def mutual_information_knn(df: DataFrame, features: list[str] | None = None, label: str = "serious", key: str = "primaryid", k: int = 3,
                           seed: int = C.RANDOM_STATE) -> DataFrame:
    """``feature, score`` (nats)."""
    features = features or C.FEATURE_COLS
    pts = radii(points(df, features, label, key, seed), k).checkpoint()
    lo = F.when(F.col("kth") < F.col("x"), F.col("kth")).otherwise(F.col("x") - F.col("r"))  # the neighbour bounds its own side
    hi = F.when(F.col("kth") > F.col("x"), F.col("kth")).otherwise(F.col("x") + F.col("r"))
    ends = [F.struct(at.alias("x"), F.lit(0).alias("one")) for at in (lo, hi)]
    values = pts.select("feature", F.inline(F.array(F.struct("x", F.lit(1).alias("one")), *ends)))
    ranks = R.rank_distinct(values, "x", ["feature"], weight_cols=["one"]).select(
        "feature", "x", F.col("one").alias("here"), F.col("one_before").alias("below")).checkpoint()
    side = lambda name, at: ranks.select("feature", F.col("x").alias(at), F.col("here").alias(f"here_{name}"), F.col("below").alias(f"below_{name}"))
    whole = pts.withColumns({"lo": lo, "hi": hi})
    # both sides have a row for each point and feature: sorted joins, whatever sizes are expected of the checkpoints
    met = whole.join(side("lo", "lo").hint("merge"), ["feature", "lo"]).join(side("hi", "hi").hint("merge"), ["feature", "hi"])
    m = F.when(F.col("r") > 0, F.col("below_hi") - F.col("below_lo") - F.col("here_lo")).otherwise(F.col("here_lo"))
    psi = lambda c: digamma(c.cast("double"))
    n = F.count(F.lit(1)).cast("double")
    score = psi(n) + F.avg(psi(F.col("k_y"))) - F.avg(psi(F.col("n_y"))) - F.avg(psi(m))
    return met.groupBy("feature").agg(F.greatest(score, F.lit(0.0)).alias("score"))
