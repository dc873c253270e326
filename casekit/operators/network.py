"""Feed-forward network with the reference's solver (O-44, O-48): ReLU, Adam, early stopping on held-out rows.

Rows are dealt by a hash of their id into slices of one batch each, and equal rows of a slice become one row with its
count, which weighs its gradient. A step sums the gradient of one slice over its partitions; tasks add these sums where there
are more than ``DRIVER_SUMS``, so that a step sends the driver no more on a larger table, and the driver applies Adam to the
7,000 weights. The number of slices is fixed for large tables (``STEPS`` a pass), so the jobs of a pass do not grow with the
data, only their tasks do; the rate follows the square root of the batch. Each pass reads the slices in an order of its own,
ends with the accuracy on the held-out tenth, and the weights of the best pass are kept.

A slice is partitioned by its values and sorted, so a run repeats itself on any partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit import config as C

STEPS = 8  # slices of a large table
LEAST_BATCH = 200
PART_ROWS = 20_000  # distinct rows of a slice that one task takes at least
FAN_IN = 32  # partial sums that one task adds, of many
DRIVER_SUMS = 4  # partial sums that the driver adds itself


# ---------------------------------------------------------------- the network
@dataclass
class Network:
    """Weights and biases of each layer; the last one gives the logit of class 1."""
    weights: list
    biases: list

    @classmethod
    def start(cls, sizes: list[int], seed: int) -> "Network":
        """Uniform in +-sqrt(6 / (fan in + fan out)); 2 in place of 6 for the logistic output."""
        rng, w, b = np.random.default_rng(seed), [], []
        for i, (n, m) in enumerate(zip(sizes, sizes[1:])):
            bound = np.sqrt((2.0 if i == len(sizes) - 2 else 6.0) / (n + m))
            w.append(rng.uniform(-bound, bound, (n, m)))
            b.append(rng.uniform(-bound, bound, m))
        return cls(w, b)

    def copy(self) -> "Network":
        return Network([w.copy() for w in self.weights], [b.copy() for b in self.biases])

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        """Inputs of each layer, and the logits."""
        out = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if i < len(self.weights) - 1 else z)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.layers(x)[-1][:, 0]
        e = np.exp(-np.abs(z))
        return np.where(z >= 0, 1, e) / (1 + e)

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """Sum of the log losses of the rows (each ``counts`` times, once without), and its gradient as one vector (weights
        then biases, layer by layer)."""
        counts, a = np.ones(len(y)) if counts is None else counts, self.layers(x)
        z = a[-1][:, 0]
        loss = float(np.sum(counts * (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))))))
        delta, parts = (counts * (self.probability_of(z) - y))[:, None], []
        for i in range(len(self.weights) - 1, -1, -1):
            parts += [delta.sum(0), (a[i].T @ delta).ravel()]
            if i:
                delta = (delta @ self.weights[i].T) * (a[i] > 0)
        return loss, np.concatenate(parts[::-1])

    @staticmethod
    def probability_of(z: np.ndarray) -> np.ndarray:
        e = np.exp(-np.abs(z))
        return np.where(z >= 0, 1, e) / (1 + e)

    def arrays(self) -> list[np.ndarray]:
        return [p for pair in zip(self.weights, self.biases) for p in pair]


class Adam:
    """Adam on the mean loss of a batch plus ``alpha / 2n`` times the squared weights (not the biases)."""

    def __init__(self, net: Network, rate: float, alpha: float = 1e-4):
        self.net, self.rate, self.alpha, self.t = net, rate, alpha, 0
        n = sum(p.size for p in net.arrays())
        self.m, self.v = np.zeros(n), np.zeros(n)

    def step(self, gradient: np.ndarray, rows: int) -> None:
        at, penalty = 0, []
        for w, b in zip(self.net.weights, self.net.biases):
            penalty += [self.alpha * w.ravel(), np.zeros(b.size)]
        g = (gradient + np.concatenate(penalty)) / rows
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        move = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t) * self.m / (np.sqrt(self.v) + 1e-8)
        for p in self.net.arrays():
            p -= move[at:at + p.size].reshape(p.shape)
            at += p.size


# ---------------------------------------------------------------- training
def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x, *(c.to_numpy().astype(float) for c in batch.columns[1:])


def _summed(rows: DataFrame, partial, size: int, parts: int) -> np.ndarray:
    """Sum of ``partial`` (a vector of ``size``, from the columns of a batch) over the batches of all ``parts`` partitions."""
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += partial(*_matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v) for v in sorted(table["sums"].to_pylist()))  # rows arrive in any order
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(run, "sums binary")
    if parts > FAN_IN:
        sums = sums.groupBy(F.spark_partition_id() % FAN_IN).applyInArrow(add, "sums binary")
    if parts > DRIVER_SUMS:
        sums = sums.groupBy().applyInArrow(add, "sums binary")  # at most FAN_IN rows
    return sum((np.frombuffer(r.sums) for r in sums.collect()), np.zeros(size))


@dataclass
class NetworkModel:
    """A trained network; ``transform`` adds ``p`` = probability of class 1 for an assembled feature vector."""
    net: Network
    features: str = "features"
    passes: list = field(default_factory=list)  # (loss, accuracy on the held-out rows) of each pass

    def positive(self) -> Column:
        net = self.net

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            return pd.Series(net.probability(np.stack(v.to_numpy()).astype(float)) if len(v) else np.zeros(0))

        return score(vector_to_array(F.col(self.features)))


@dataclass
class NetworkClassifier:
    """Estimator: ``fit`` a table with an assembled feature vector, a 0/1 label and an id."""
    hidden: tuple = (96, 48, 24)
    max_iter: int = 120
    patience: int = 8
    tol: float = 1e-4
    rate: float = 1e-3
    seed: int = C.RANDOM_STATE
    label: str = "serious"
    features: str = "features"
    key: str = "primaryid"
    steps: int = STEPS

    def fit(self, df: DataFrame) -> NetworkModel:
        place = F.pmod(F.xxhash64(F.col(self.key).cast("string"), F.lit(self.seed)), F.lit(1 << 30))
        rows = df.select(vector_to_array(F.col(self.features)).alias("x"), F.col(self.label).cast("int").alias("y"), place.alias("place"))
        held_out = F.col("place") % 10 == 0
        n, n_held, dim = rows.agg(F.count(F.when(~held_out, 1)), F.count(F.when(held_out, 1)), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no rows to fit the network on")
        steps = max(1, min(self.steps, n // LEAST_BATCH))
        own = F.when(held_out, F.lit(-1)).otherwise(F.floor(F.col("place") / 10) % steps).cast("int")
        dealt = rows.groupBy(own.alias("slice"), "x", "y").agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
        sizes = {r.slice: (r.rows, max(1, min(-(-r.distinct // PART_ROWS), 4096))) for r in dealt.groupBy("slice").agg(  # a row for each slice
            F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct")).collect()}
        kept = {i: self._kept(dealt.where(F.col("slice") == i), sizes.get(i, (0, 1))[1]) for i in range(-1, steps)}
        try:
            for s in kept.values():
                s.count()  # stored before the dealt rows go
            dealt.unpersist()
            return self._train([(kept[i], *sizes.get(i, (0, 1))) for i in range(steps)], kept[-1], n_held, sizes.get(-1, (0, 1))[1], dim)
        finally:
            for s in (*kept.values(), dealt):
                s.unpersist()

    @staticmethod
    def _kept(df: DataFrame, tasks: int) -> DataFrame:
        return df.select("x", "y", "n").repartition(tasks, "x", "y").sortWithinPartitions("x", "y").persist(StorageLevel.MEMORY_AND_DISK)

    def _train(self, slices: list, held: DataFrame, n_held: int, held_parts: int, dim: int) -> NetworkModel:
        net = Network.start([dim, *self.hidden, 1], self.seed)
        size = sum(p.size for p in net.arrays())
        batch = sum(n for _, n, _ in slices) / len(slices)
        adam = Adam(net, min(0.01, self.rate * max(1.0, batch / LEAST_BATCH) ** 0.5))
        order, best, kept, waits, passes = np.random.default_rng(self.seed), -1.0, net.copy(), 0, []
        for _ in range(self.max_iter):
            loss = 0.0
            for i in order.permutation(len(slices)):
                rows, n, parts = slices[i]
                if n:
                    now = net.copy()
                    got = _summed(rows, lambda x, y, c: np.append(*reversed(now.loss_and_gradient(x, y, c))), size + 1, parts)  # noqa: B023
                    loss += got[-1]
                    adam.step(got[:-1], n)
            now = net.copy()
            right = _summed(held, lambda x, y, c: np.array([np.sum(c * ((now.probability(x) > 0.5) == (y > 0.5)))]), 1, held_parts)[0] if n_held else -loss  # noqa: B023
            score = right / max(1, n_held)
            passes.append((loss / max(1, batch * len(slices)), score))
            waits = waits + 1 if score < best + self.tol else 0
            if score > best or len(passes) == 1:
                best, kept = score, net.copy()
            if waits > self.patience:
                break
        return NetworkModel(kept, self.features, passes)
