"""Operator 11: exact top-k by integer inner product over an impact-ordered index, read score at a time.

Components become integers ``floor(scale * x)``. Distinct vectors are dealt by hash into blocks of about ``BLOCK``; a
block is one row of the index. In it every dimension has its postings in segments of equal quantised magnitude, largest
first. A query takes the segments of all dimensions in descending impact (|query component| * segment magnitude) and adds
quantised products to accumulators. What is still unread of a dimension, and what quantising lost, bounds how far an
accumulator can be from the true score, so a row is out once it is proven to lie below the (k+1)-th best; reading ends
when so many are out that scoring the others exactly costs a fraction of the postings left. Possible members are always scored exactly,
so the result does not depend on where reading ends.

Queries are packed into chunks and meet the blocks in waves of 1, 4, 16, ... blocks a chunk; each wave knows the
(k+1)-th best score of those before it, so later blocks give rows only where they can still matter. Each wave ends in a
checkpoint of k + 1 rows a query, so a lost executor repeats one wave at most. A chunk and a block are the most that a
task holds at once.

Rows with a null id, and vectors that are null or hold null, NaN or infinite components, take no part. Shorter vectors
count as ended by zeros (an empty one scores 0). Integers are held within -LIMIT and LIMIT, so that scores of 2,048
components fit a long. Repeated rows are rows: all but the query's own are candidates, and each query row has its result.
Equal vectors are scored once, with their k + 1 smallest ids. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casekit.llm.clusters import finite, integers
from casekit.llm.common import cut

LIMIT = 1 << 26
BLOCK, CHUNK = 4096, 1024  # vectors of a block, queries of a chunk
LEAST_BLOCKS = 16  # of a table of some thousands of vectors, so that a small cluster is busy
LEVELS = 64  # magnitudes of a dimension
ROUNDS = (8, 32, 128)  # a query reads down to these fractions of its largest impact, then the rest
WORTH = 4  # reading ends when the postings left are this many times the components of the possible members
INDEX = "block int, n int, dim int, vectors binary, counts binary, ids binary, segments binary, bounds binary"
FOUND = "qid long, score long, vec_id long"


def as_matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows padded with zeros to the longest."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = values
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Width of a quantised magnitude, by dimension."""
    return np.abs(x).max(0, initial=0) // LEVELS + 1


def segments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each dimension by descending quantised magnitude; how many have the magnitude ``level`` or more."""
    level = (np.abs(x) // steps(x)).T
    order = np.argsort(-level, axis=1, kind="stable")
    bounds = np.stack([np.count_nonzero(level >= i, axis=1) for i in range(LEVELS + 1)], axis=1)
    return order, bounds


class Block:
    """One row of the index, ready to be read."""

    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.x = np.frombuffer(row["vectors"], np.int32).reshape(n, dim).astype(np.int64)
        self.counts, self.ids = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["ids"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.order = np.frombuffer(row["segments"], np.int32).reshape(dim, n).astype(np.int64)
        self.bounds = np.frombuffer(row["bounds"], np.int32).reshape(dim, LEVELS + 1)
        self.step = steps(self.x)
        size = np.abs(self.x)
        quantised = np.sign(self.x) * (size // self.step * self.step + self.step // 2)
        self.impact = np.take_along_axis(quantised.T, self.order, axis=1).astype(float)
        self.largest = size.max(0, initial=0)

    def best(self, q: np.ndarray, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the block's first ``k`` rows by (score, smaller id), none below ``least``."""
        n, dim = self.x.shape
        q = np.pad(q[:dim], (0, max(0, dim - len(q))))
        rows = self.possible(q, k, least)
        score = self.x[rows] @ q
        if least is not None:
            rows, score = rows[score >= least], score[score >= least]
        if len(rows) > k:  # each row has an id at least
            cut_at = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= cut_at], score[score >= cut_at]
        m = self.counts[rows]
        at = np.repeat(self.first[rows] - np.concatenate([[0], np.cumsum(m)[:-1]]) if len(rows) else rows, m) + np.arange(m.sum())
        ids, score = self.ids[at], np.repeat(score, m)
        top = np.lexsort((ids, -score))[:k]
        return score[top], ids[top]

    def possible(self, q: np.ndarray, k: int, least: int | None) -> np.ndarray:
        """Rows that the bounds cannot rule out."""
        n, dim = self.x.shape
        weight = np.abs(q).astype(float)
        most = weight @ self.largest
        rounding = most * (dim + 2) * 2.0 ** -50
        top, total = (weight * self.largest).max(initial=0), np.zeros(n)
        read, left, level = np.zeros(dim, np.int64), n * dim, np.full(dim, LEVELS)
        for part in (*ROUNDS, None):
            if part is None:
                level = np.zeros(dim, np.int64)
            else:  # the lowest level whose impact reaches the fraction
                reach = np.ceil((top / part / np.maximum(weight, 1e-9) + 1) / self.step - 1)
                level = np.minimum(level, np.clip(reach, 0, LEVELS)).astype(np.int64)
            end = self.bounds[np.arange(dim), level]
            new = end - read
            if new.any():
                spans = [(d, a, b) for d, (a, b) in enumerate(zip(read.tolist(), end.tolist())) if b > a]
                at = np.concatenate([self.order[d, a:b] for d, a, b in spans])
                value = np.concatenate([self.impact[d, a:b] for d, a, b in spans])
                value *= np.repeat(q.astype(float), new)
                total += np.bincount(at, value, minlength=n)
                read, left = end, left - int(new.sum())
            slack = weight @ np.maximum(np.minimum(level * self.step - 1, self.largest), self.step // 2) + rounding
            floor = -np.inf if least is None else float(least) - abs(float(least)) * 2.0 ** -50
            if n > k:
                floor = max(floor, np.partition(total, n - k)[n - k] - slack)
            rows = np.flatnonzero(total + slack >= floor)
            if len(rows) * dim * WORTH <= left or not left:
                break
        return rows


def build_index(distinct: DataFrame, n_blocks: int) -> DataFrame:
    """One row for each block of distinct vectors (``v``, ``ids``)."""
    def build(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        x, ids = as_matrix(_one(t["v"])), _one(t["ids"])
        order, bounds = segments(x)
        data = [t["block"][0].as_py(), *x.shape, *(a.tobytes() for a in (
            x.astype(np.int32), ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32),
            ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), order.astype(np.int32), bounds.astype(np.int32)))]
        names = ["block", "n", "dim", "vectors", "counts", "ids", "segments", "bounds"]
        return pa.table({n: pa.array([v], pa.binary() if i > 2 else pa.int32()) for i, (n, v) in enumerate(zip(names, data))})

    block = F.pmod(F.xxhash64("v"), F.lit(n_blocks)).cast("int")
    return distinct.withColumn("block", block).groupBy("block").applyInArrow(build, INDEX)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


def _packed(queries: DataFrame) -> DataFrame:
    """One row for each chunk of queries (``chunk``, ``qid``, ``v``, ``least``)."""
    def pack(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        return pa.table({"chunk": t["chunk"][:1], **{c: pa.array([t[c].to_pylist()], kind) for c, kind in (
            ("qid", pa.list_(pa.int64())), ("v", pa.list_(pa.list_(pa.int64()))), ("least", pa.list_(pa.int64())))}})

    return queries.groupBy("chunk").applyInArrow(pack, "chunk int, qid array<long>, v array<array<long>>, least array<long>")


def _wave(queries: DataFrame, index: DataFrame, blocks: int, chunks: int, low: int, high: int, k: int) -> DataFrame:
    """What chunk c finds in the blocks c + low to c + high - 1 (modulo the number of blocks)."""
    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        if left.num_rows and right.num_rows:
            block, chunk = Block(right.to_pylist()[0]), left.to_pylist()[0]
            for qid, v, least in zip(chunk["qid"], chunk["v"], chunk["least"]):
                score, ids = block.best(np.array(v, np.int64), k, least)
                got.append((np.full(len(ids), qid), score, ids))
        parts = [np.concatenate(c) for c in zip(*got)] or [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("qid", "score", "vec_id"), map(pa.array, parts))))

    pairs = max(1, min(20_000, chunks * (high - low)))
    wanted = F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda o: F.pmod(F.col("chunk") + o, F.lit(blocks)))
    here = lambda c: (F.pmod(F.col("block") - c, F.lit(blocks)) >= low) & (F.pmod(F.col("block") - c, F.lit(blocks)) < high)
    left = _packed(queries).withColumn("block", F.explode(wanted)).repartition(pairs, "chunk", "block")
    right = index.withColumn("chunk", F.explode(F.filter(F.sequence(F.lit(0), F.lit(chunks - 1)), here))).repartition(pairs, "chunk", "block")
    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(scan, FOUND)


def first_rows(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each ``qid`` by (score, smaller id)."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def search(df: DataFrame, vector: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row whose id is divisible by ``every``."""
    kept = df.where(finite(F.col(vector)) & F.col("vec_id").isNotNull())
    vectors = kept.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col(vector), scale, LIMIT).alias("v"))
    near = Window.partitionBy("v").orderBy("vec_id")  # k + 1 ids of a vector are enough; limited before the shuffle too
    distinct = cut(vectors.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
                   .groupBy("v").agg(F.collect_list("vec_id").alias("ids")))
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = cut(asked.groupBy("v").agg(F.count(F.lit(1)).alias("n")).select("v", F.monotonically_increasing_id().alias("qid")))
    n, n_queries = distinct.count(), queries.count()
    blocks, chunks = max(1, -(-n // BLOCK), min(LEAST_BLOCKS, n // 256)), max(1, -(-n_queries // CHUNK))
    index = cut(build_index(distinct, blocks))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int"))

    best, low = None, 0
    while low < blocks:
        high = min(blocks, max(1, 5 * low))
        known = queries.withColumn("least", F.lit(None).cast("long")) if best is None else queries.join(
            best.groupBy("qid").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("m")), "qid", "left").select(
            *queries.columns, F.when(F.col("m") > k, F.col("s")).alias("least"))
        new = _wave(known, index, blocks, chunks, low, high, k + 1)
        best = cut(first_rows(reduce(DataFrame.union, [x for x in (best, new) if x is not None]), k + 1))
        low = high

    lists = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("top"))
    self_score = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    rows = asked.withColumn("own", F.struct((-self_score).alias("minus"), "vec_id")).join(queries.select("v", "qid"), "v").join(lists, "qid")
    at = F.array_position("top", F.col("own")).cast("int")  # 0: not among them
    others = F.when(at == 0, F.slice("top", 1, k)).otherwise(F.concat(F.slice("top", F.lit(1), at - 1), F.slice("top", at + 1, F.lit(k))))
    return rows.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("i", "hit")).select(
        "query_id", (F.col("i") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def oracle(k: int = 5, every: int = 50, scale: int = 256) -> str:
    """The same rows in SQL over the table ``embeddings`` (vectors of one length)."""
    return f"""WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM kept),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id,
  CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
