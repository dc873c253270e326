"""Operator 13: clustering of vectors by rounds of nearest-centroid assignment, the nearest found by a bisector tournament.

Components become integers ``floor(scale * x)``, so every step is exact. For each pair of centroids i < j the bisecting
plane has the integer normal 2 (c_j - c_i) and the threshold |c_j|^2 - |c_i|^2; a vector lies nearer to j only if its
product with the normal is greater than the threshold, so zero favours the smaller number. The reigning centroid meets
the next one in k - 1 such tests; a distance is worked out for the last winner alone, after the last round.

Only the k centroids, their planes and k sums of each task leave a task; sums are added by Spark, the driver gets k * dim
rows a round.

Kept are vectors with exactly ``dim`` components, none null, NaN or infinite; others (and null vectors) are left out.
Integers are held within -LIMIT and LIMIT (a component of 2 million at scale 64), so that no 64-bit sum can overflow; an
inertia beyond 64 bits is stated as the largest long. A repeated row is a vector of its own. Seeds that tie by hash
(repeated ids) follow the order of their integers; a null id is clustered but seeds nothing. With fewer vectors than k
there are as many centroids as seeds; without seeds the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import cut

#: Largest integer of a component: the square of twice it, 64 times added, fits a long.
LIMIT = 1 << 27
SCHEMA = "vec_id long, cluster int, distance long"


def integers(vector: Column, scale: int, limit: int = LIMIT) -> Column:
    """``floor(scale * x)`` of each component, within the limit."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-limit))), F.lit(float(limit)))))


def finite(vector: Column) -> Column:
    """Whether a vector is there and none of its components is null, NaN or infinite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, good), F.lit(False))


class Tournament:
    """Planes between all pairs of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = c = np.asarray(centroids, np.int64)
        square = (c * c).sum(1)
        self.normals = 2 * (c[None] - c[:, None])  # [i, j]: from i to j
        self.thresholds = square[None] - square[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each row of ``x``."""
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = np.einsum("nd,nd->n", x, self.normals[best, j])
            best[side > self.thresholds[best, j]] = j
        return best

    def distance(self, x: np.ndarray, best: np.ndarray) -> np.ndarray:
        away = x - self.centroids[best]
        return np.einsum("nd,nd->n", away, away)


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def seeds(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in the order of their hashes."""
    h = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means of their vectors, empty ones where they were."""
    k, dim = centroids.shape

    def run(batches):
        game, n, total = Tournament(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            x = _rows(batch, dim)
            best = game.nearest(x)
            n += np.bincount(best, minlength=k)
            np.add.at(total, best, x)
        at = np.flatnonzero(n)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * dim, pa.int32()), pa.array(total[at].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), sums], ["c", "n", "sums"])

    part = vectors.mapInArrow(run, "c int, n long, sums array<long>").select("c", "n", F.posexplode("sums").alias("i", "s"))
    exact = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    out = centroids.copy()
    for r in part.groupBy("c", "i").agg(exact("n"), exact("s")).collect():  # k * dim rows
        out[r.c, r.i] = int(r.s) // int(r.n)
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    dim = centroids.shape[1]

    def run(batches):
        game = Tournament(centroids)
        for batch in batches:
            x = _rows(batch, dim)
            best = game.nearest(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(game.distance(x, best))],
                                             ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, SCHEMA)


def cluster(df: DataFrame, vector: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64,
            prefix: str = "1:") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: one row for each kept vector."""
    if dim > 64:
        raise ValueError("integers are held within bounds for up to 64 components")
    spark = df.sparkSession
    kept = df.where(finite(F.col(vector)) & (F.size(vector) == dim))
    vectors = kept.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col(vector), scale).alias("v"))
    centroids = seeds(vectors, k, prefix)
    if not len(centroids):
        return spark.createDataFrame([], SCHEMA + ", cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    rows = cut(assigned(vectors, centroids))
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), top).cast("long")
    own = rows.groupBy("cluster").agg(total("distance").alias("cluster_inertia"))
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(names, "cluster int, centroid_sha256 string").join(own, "cluster").withColumn(
        "inertia", F.lit(rows.agg(total("distance").alias("t")).first()["t"]).cast("long"))
    return rows.join(F.broadcast(named), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, prefix: str = "1:") -> str:
    """The same rows in SQL over the table ``embeddings``."""
    away = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (v[i] - cv[i]) * (v[i] - cv[i])))"
    out = f"""WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dim}
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v0 AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM kept),
c0 AS (SELECT c, v AS cv FROM (SELECT row_number() OVER (ORDER BY sha256('{prefix}' || vec_id), v) - 1 AS c, v FROM v0) WHERE c < {k})"""
    for n in range(rounds + 1):
        out += f""",
a{n} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(CAST({away} AS HUGEINT) * {k} + c) AS best FROM v0, c{n} GROUP BY r)"""
        if n < rounds:
            out += f""",
s{n} AS (SELECT best % {k} AS c, i, sum(v[i]) AS s, count(*) AS m FROM a{n}, range(1, {dim + 1}) AS t(i) GROUP BY 1, 2),
m{n} AS (SELECT c, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS mv FROM s{n} GROUP BY c),
c{n + 1} AS (SELECT c{n}.c, coalesce(mv, cv) AS cv FROM c{n} LEFT JOIN m{n} ON c{n}.c = m{n}.c)"""
    return out + f"""
SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, CAST(best // {k} AS BIGINT) AS distance,
  CAST(sum(best // {k}) OVER (PARTITION BY best % {k}) AS BIGINT) AS cluster_inertia, CAST(sum(best // {k}) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(cv, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON best % {k} = c"""
