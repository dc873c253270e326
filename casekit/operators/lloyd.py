"""k-means with all restarts in one pass (O-59, O-60) and the Euclidean silhouette of its clusters (O-61).

Equal vectors are collapsed to one row with its count. A pass reads the vectors once, moves the centres of every restart that
still changes, and sends restarts * k sums from each task; ten restarts thus cost the jobs of one. Seeding is k-means++ by a
weighted reservoir: in the pass for the next centre each vector draws an exponential time with the rate
``count * squared distance`` from a hash, and the earliest is the next centre, for all restarts at once. A centre without
vectors moves to the vector farthest from its own centre.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit import config as C
from casekit.session import ensure_checkpoint_dir

EXACT_VECTORS = 60_000  # distinct vectors up to which the silhouette is exact
GROUP = 2_000  # vectors of a block
CELLS = 4_096  # cells that stand for the vectors of a larger table


def distinct_vectors(df: DataFrame, features: str) -> DataFrame:
    """``x, id, n``: distinct vectors, a hash of each, and how many rows have it; checkpointed."""
    ensure_checkpoint_dir(df.sparkSession)
    x = vector_to_array(F.col(features)).alias("x")
    return df.select(x).groupBy("x").agg(F.count(F.lit(1)).alias("n")).select("x", F.xxhash64("x").alias("id"), "n").checkpoint()


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x, batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centre."""
    return np.stack([np.einsum("nd,nd->n", x - c, x - c) for c in centres], axis=1)


def uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1) by hash."""
    h = ids.view(np.uint64).copy()
    for s in salt:
        h += np.uint64((s + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        h ^= h >> np.uint64(31)
    return ((h >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53


def seeds(vectors: DataFrame, k: int, restarts: int, seed: int) -> list[np.ndarray]:
    """k-means++ centres of each restart: k passes for all of them."""
    chosen: list[list[np.ndarray]] = [[] for _ in range(restarts)]
    for step in range(k):
        now = [np.array(c) for c in chosen]

        def draw(batches, now=now, step=step):
            best: list = [None] * restarts
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, ids, n = _batch(batch)
                for r in range(restarts):
                    rate = n * (squared(x, now[r]).min(1) if step else 1.0)
                    with np.errstate(divide="ignore"):
                        time = np.where(rate > 0, -np.log(uniform(ids, seed, r, step)) / rate, np.inf)
                    i = int(np.lexsort((ids, time))[0])
                    if best[r] is None or (time[i], ids[i]) < best[r][:2]:
                        best[r] = (time[i], ids[i], x[i])
            got = [(r, *b) for r, b in enumerate(best) if b is not None]
            if got:
                r, time, ids, x = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(time, pa.float64()), pa.array(ids, pa.int64()),
                                                  pa.array([v.tolist() for v in x])], ["r", "time", "id", "x"])

        first = vectors.mapInArrow(draw, "r int, time double, id long, x array<double>").groupBy("r").agg(
            F.min_by("x", F.struct("time", "id")).alias("x"))
        for row in first.collect():  # a row for each restart
            chosen[row.r].append(np.array(row.x))
    return [np.array(c) for c in chosen]


def moved(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """One pass for every restart given: its new centres, and the cost of the old ones."""
    def run(batches):
        sums = {r: np.zeros((len(c), c.shape[1] + 2)) for r, c in centres.items()}  # sums, count, cost
        far = {r: (-1.0, 0, None) for r in centres}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids, n = _batch(batch)
            for r, c in centres.items():
                d = squared(x, c)
                own = d.argmin(1)
                least = d[np.arange(len(x)), own]
                for j in range(len(c)):
                    at = own == j
                    sums[r][j] += np.append(n[at] @ x[at], [n[at].sum(), n[at] @ least[at]])
                i = int(np.lexsort((ids, -least))[0])
                if (least[i], -ids[i]) > far[r][:2] or far[r][2] is None:
                    far[r] = (least[i], -ids[i], x[i])
        rows = [(r, s.ravel().tolist(), far[r][0], -int(far[r][1]), far[r][2].tolist()) for r, s in sums.items() if far[r][2] is not None]
        if rows:
            r, s, d, i, x = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(s), pa.array(d, pa.float64()), pa.array(i, pa.int64()), pa.array(x)],
                                             ["r", "sums", "far", "id", "x"])

    part = vectors.mapInArrow(run, "r int, sums array<double>, far double, id long, x array<double>")
    total = part.select("r", F.posexplode("sums").alias("i", "s")).groupBy("r", "i").agg(F.sum("s").alias("s"))
    sums = {r: np.zeros((len(c), c.shape[1] + 2)) for r, c in centres.items()}
    for row in total.collect():  # restarts * k * (features + 2) numbers
        sums[row.r].reshape(-1)[row.i] = row.s
    out = {}
    for r, s in sums.items():
        new = np.where(s[:, -2:-1] > 0, s[:, :-2] / np.maximum(s[:, -2:-1], 1e-300), centres[r])
        out[r] = (new, float(s[:, -1].sum()))
    empty = [r for r, s in sums.items() if (s[:, -2] == 0).any()]
    if empty:
        for row in part.where(F.col("r").isin(empty)).groupBy("r").agg(F.max_by("x", F.struct("far", -F.col("id"))).alias("x")).collect():
            out[row.r][0][int(np.flatnonzero(sums[row.r][:, -2] == 0)[0])] = row.x
    return out


@dataclass
class KMeansModel:
    centres: np.ndarray
    cost: float
    features: str = "features"
    passes: int = 0

    def cluster(self) -> Column:
        """Number of the nearest centre (ties: the smaller number)."""
        x = vector_to_array(F.col(self.features))
        square = lambda c: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)),
                                       F.lit(0.0), lambda s, v: s + v)
        return F.array_min(F.array(*[F.struct(square(c).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(self.centres)]))["j"]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("cluster", self.cluster())


def fit(df: DataFrame, k: int = C.N_CLUSTERS, restarts: int = 10, seed: int = C.RANDOM_STATE, features: str = "features",
        max_iter: int = 300, tol: float = 1e-4) -> KMeansModel:
    """The best of ``restarts`` (lowest cost, then lowest number). A restart ends when its centres move less than ``tol`` times
    the mean variance of the features."""
    vectors = distinct_vectors(df, features)
    size = vectors.agg(F.max(F.size("x"))).first()[0]
    if size is None:
        raise ValueError("no rows to cluster")
    n = F.col("n").cast("double")
    stats = vectors.agg(F.sum(n), *[f(e) for i in range(size) for f, e in ((F.sum, n * F.col("x")[i]), (F.sum, n * F.col("x")[i] * F.col("x")[i]))]).first()
    mean, square = np.array(stats[1::2]) / stats[0], np.array(stats[2::2]) / stats[0]
    least = tol * float(np.mean(np.maximum(square - mean * mean, 0)))
    centres = dict(enumerate(seeds(vectors, k, restarts, seed)))
    done, cost, passes = {}, {}, 0
    while centres and passes < max_iter:
        passes += 1
        for r, (new, c) in moved(vectors, centres).items():
            shift, cost[r] = float(((new - centres[r]) ** 2).sum()), c
            centres[r] = new
            if shift <= least:
                done[r] = centres.pop(r)
    done |= centres
    for r, (_, c) in moved(vectors, done).items():
        cost[r] = c
    best = min(cost, key=lambda r: (cost[r], r))
    return KMeansModel(done[best], cost[best], features, passes)


# ---------------------------------------------------------------- silhouette
def silhouette(clustered: DataFrame, features: str = "features", exact_vectors: int | None = None) -> tuple[float, float, float]:
    """Mean Euclidean silhouette: (value, lower bound, upper bound).

    Up to ``EXACT_VECTORS`` distinct (vector, cluster) rows it is exact: blocks of vectors meet blocks, each task sums the
    distances from its vectors to each cluster, no pair is given out. Above it the vectors of a cell of a grid are taken
    for the cell's centre; a vector lies within the cell's radius of it, so every mean distance is off by two radii at most
    and the value lies within the bounds. One cluster, or none: 0.
    """
    most = EXACT_VECTORS if exact_vectors is None else exact_vectors
    spark = clustered.sparkSession
    rows = clustered.select(vector_to_array(F.col(features)).alias("x"), F.col("cluster").cast("int").alias("c"))
    points = rows.groupBy("x", "c").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    m, clusters = points.agg(F.count(F.lit(1)), F.count_distinct("c")).first()
    if clusters < 2:
        return 0.0, 0.0, 0.0
    if m > most:
        points = _cells(points).checkpoint()
        m = points.count()
    else:
        points = points.withColumn("radius", F.lit(0.0))
    names = sorted(r.c for r in points.select("c").distinct().collect())
    sizes = {r.c: r.n for r in points.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    blocks = max(1, -(-m // GROUP))
    placed = points.withColumn("b", F.pmod(F.xxhash64("x", "c"), F.lit(blocks)).cast("int"))
    left = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = placed.withColumnRenamed("b", "o").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"x": pa.array([], pa.list_(pa.float64())), "c": pa.array([], pa.int32()), "n": pa.array([], pa.int64()),
                             "radius": pa.array([], pa.float64()), "sums": pa.array([], pa.list_(pa.float64()))})
        x, y = (np.array(t["x"].to_pylist(), float) for t in (a, b))
        weight = np.stack([np.where(b["c"].to_numpy() == c, b["n"].to_numpy(), 0).astype(float) for c in names], axis=1)
        spread = np.stack([np.where(b["c"].to_numpy() == c, b["n"].to_numpy() * b["radius"].to_numpy(), 0) for c in names], axis=1).sum(0)
        away = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0))
        equal = (x[:, None, 0] == y[None, :, 0]) & (away < 1e-6)
        if equal.any():  # no rounding where two vectors are equal
            i, j = np.nonzero(equal)
            away[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum(1))
        sums = np.concatenate([away @ weight, np.tile(spread, (len(x), 1))], axis=1)
        return pa.table({"x": a["x"].cast(pa.list_(pa.float64())), "c": a["c"], "n": a["n"], "radius": a["radius"], "sums": pa.array(sums.tolist())})

    keys = ("b", "o")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "x array<double>, c int, n long, radius double, sums array<double>")
    total = met.groupBy("x", "c", "n", "radius").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(2 * len(names))]).alias("s"))

    def side(sign: int) -> Column:
        """Silhouette of a vector with all distances moved by their possible error: towards +1 or -1."""
        means, own = [], None
        for i, c in enumerate(names):
            inside = F.col("c") == c
            others = F.when(inside, F.lit(float(sizes[c] - 1))).otherwise(F.lit(float(sizes[c])))
            move = F.col("radius") + F.col("s")[i + len(names)] / float(sizes[c])
            mean = F.try_divide(F.col("s")[i], others)
            means.append(F.when(~inside, F.greatest(mean + sign * move, F.lit(0.0))))
            a = F.greatest(mean - sign * move * F.try_divide(F.lit(float(sizes[c])), others), F.lit(0.0))
            own = F.when(inside, a) if own is None else own.when(inside, a)
            lone = F.when(inside, F.lit(sizes[c] == 1)) if i == 0 else lone.when(inside, F.lit(sizes[c] == 1))
        near = F.least(*means) if len(means) > 1 else means[0]
        return F.when(lone, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(near - own, F.greatest(near, own)), F.lit(0.0)))

    mean = lambda v: (F.sum(v * F.col("n")) / F.sum("n"))
    value, low, high = total.agg(mean(side(0)), mean(side(-1)), mean(side(1))).first()
    del spark
    return float(value), float(low), float(high)


def _cells(points: DataFrame) -> DataFrame:
    """One point for each cell of a grid and cluster: the mean of its vectors, and the largest distance to it."""
    size = points.select(F.size("x").alias("s")).first().s
    low_high = points.agg(*[f(F.col("x")[i]) for i in range(size) for f in (F.min, F.max)]).first()
    spans = [(low_high[2 * i], max(low_high[2 * i + 1] - low_high[2 * i], 1e-300)) for i in range(size)]
    wide = sum(1 for i in range(size) if low_high[2 * i] < low_high[2 * i + 1])
    cuts = max(2, int(round(CELLS ** (1 / max(1, wide)))))
    cell = F.array(*[F.least(F.floor((F.col("x")[i] - a) / w * cuts), F.lit(cuts - 1)) for i, (a, w) in enumerate(spans)])
    placed = points.withColumn("cell", cell)
    n = F.col("n").cast("double")
    centre = placed.groupBy("cell", "c").agg(F.array(*[F.sum(n * F.col("x")[i]) / F.sum(n) for i in range(size)]).alias("m"))
    off = F.sqrt(F.aggregate(F.zip_with("x", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return (placed.join(centre, ["cell", "c"]).groupBy("cell", "c").agg(F.first("m").alias("x"), F.sum("n").alias("n"), F.max(off).alias("radius"))
            .select("x", "c", "n", "radius"))
