"""Random forest grown to pure leaves (O-44, O-48, O-55, O-56).

Equal feature vectors are collapsed to one row with its class counts first. A tree draws each vector's bag count from a
Poisson distribution by a hash of vector and tree, so a bag is the same on any partitioning and after any retry.

Nodes with more than ``LOCAL_ROWS`` vectors in their bag are split by histograms: every task sums class weights by node,
feature and cell, Spark adds them, and the driver gets one best cut for each node. The frontier is taken in groups of nodes
whose histograms fit ``GROUP_BYTES``. Every other node leaves the driver at once: its bag is sent to one task, at most
``LOCAL_ROWS`` rows, which grows the whole subtree level by level to pure leaves and stores it as one row of the model's
table in the shared folder. Driver memory therefore follows the number of large nodes, not the depth of the trees.

A split looks at ``sqrt(features)`` features in random order, and at further ones until one varies. Cuts lie halfway between
neighbouring values of the node (at cells of ``CELLS`` quantiles in large nodes; a large node whose vectors share all cells is
grown by one task). Values are compared as 32-bit floats. Class weights are taken per class.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit import config as C
from casekit.session import ensure_checkpoint_dir

LOCAL_ROWS = 200_000
GROUP_BYTES = 64_000_000
WAVE_ROWS = 2_000_000_000  # bag rows shuffled at once
CELLS = 256
BROADCAST_BYTES = 64_000_000  # of a model that is sent to the rows
PIECE_BYTES = 32_000_000  # of the subtrees of a larger model that a scoring task holds
SCORE_ROWS = 500_000  # vectors that it holds
ONE = 1 << 40  # unit of a probability in sums, so that sums do not depend on their order
SUBTREE = "tree int, root int, feature binary, cut binary, left binary, p binary, gains array<double>"


# ---------------------------------------------------------------- bags
def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1) by hash."""
    x = ids.view(np.uint64)
    for s in salt:
        x = mixed(x + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53


def normal_quantile(u: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 26.2.23 (error below 4.5e-4)."""
    t = np.sqrt(-2 * np.log(np.minimum(u, 1 - u)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t ** 3)
    return np.where(u < 0.5, -z, z)


def poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson quantiles; by the normal approximation above a mean of 50."""
    out, large = np.zeros(len(u)), mean > 50
    if large.any():
        z, m = normal_quantile(u[large]), mean[large]
        out[large] = np.maximum(0, np.rint(m + np.sqrt(m) * z + (z * z - 1) / 6))
    at = np.flatnonzero((mean > 0) & ~large)
    term = np.exp(-mean[at])
    total, k = term.copy(), 0
    while len(at := at[keep := u[at] > total]):
        k += 1
        term = term[keep] * mean[at] / k
        total = total[keep] + term
        out[at] = k
        if k > 400:  # rounding
            break
    return out


def bag(ids: np.ndarray, counts: np.ndarray, tree: int, seed: int, weights: np.ndarray) -> np.ndarray:
    """Weight of each vector and class in a tree's bag."""
    return np.stack([poisson(uniform(ids, seed, 2 * tree + c), counts[:, c].astype(float)) * weights[c] for c in (0, 1)], axis=1)


# ---------------------------------------------------------------- a subtree in one task
def grow(x: np.ndarray, w: np.ndarray, rng: np.random.Generator, tries: int) -> tuple:
    """Node arrays (feature or -1, cut, left child, probability) and the gain of each feature; right child = left + 1."""
    dim = x.shape[1]
    values, codes = zip(*(np.unique(x[:, f], return_inverse=True) for f in range(dim)))
    codes, width = np.stack(codes, axis=1).astype(np.int64), max(len(v) for v in values)
    feature, cut, left, p, gains = [], [], [], [], np.zeros(dim)
    rows, node, count, total = np.arange(len(x)), np.zeros(len(x), np.int64), 1, 0
    while count:
        sums = np.stack([np.bincount(node, w[rows, c], minlength=count) for c in (0, 1)], axis=1)
        weight = sums.sum(1)
        f_, cut_, left_ = np.full(count, -1, np.int8), np.zeros(count), np.zeros(count, np.int32)
        p.append(np.divide(sums[:, 1], weight, out=np.zeros(count), where=weight > 0))
        mixed_node = (sums > 0).all(1)
        order = rng.random((count, dim)).argsort(1)
        best, low, high = np.full(count, -np.inf), np.zeros(count, np.int64), np.zeros(count, np.int64)
        for turn in range(dim):
            asked = mixed_node & ((turn < tries) | np.isinf(best))
            at = np.flatnonzero(asked[node])
            if not len(at):
                break
            n = node[at]
            key = n * width + codes[rows[at], order[n, turn]]
            rank = np.argsort(key, kind="stable")
            key, n, at = key[rank], n[rank], rows[at[rank]]
            run = np.cumsum(w[at], axis=0)
            edge = np.flatnonzero((key[1:] != key[:-1]) & (n[1:] == n[:-1]))  # the last row left of a cut
            if not len(edge):
                continue
            e = n[edge]
            first = np.searchsorted(n, e)
            before = np.where((first > 0)[:, None], run[first - 1], 0.0)
            l = run[edge] - before
            r = sums[e] - l
            lw, rw = l.sum(1), np.maximum(r.sum(1), 1e-300)
            score = (l * l).sum(1) / lw + (r * r).sum(1) / rw
            start = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
            top = np.maximum.reduceat(score, start)
            hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(start, len(e)))))
            hit = hit[np.unique(e[hit], return_index=True)[1]]  # the first of equal cuts
            better = score[hit] > best[e[hit]]
            hit = hit[better]
            m = e[hit]
            best[m], f_[m], low[m], high[m] = score[hit], order[m, turn], key[edge[hit]] % width, key[edge[hit] + 1] % width
        split = np.flatnonzero(f_ >= 0)
        left_[split] = total + count + 2 * np.arange(len(split))
        for f in range(dim):
            m = split[f_[split] == f]
            half = values[f][low[m]].astype(float) / 2 + values[f][high[m]].astype(float) / 2
            cut_[m] = np.where(half.astype(np.float32) < values[f][high[m]], half, values[f][low[m]])
            gains[f] += np.sum(best[m] - (sums[m] ** 2).sum(1) / weight[m])
        feature.append(f_)
        cut.append(cut_.astype(np.float32))
        left.append(left_)
        total += count
        go = f_[node] >= 0
        rows, node = rows[go], node[go]
        right = codes[rows, f_[node]] > low[node]
        node, count = left_[node].astype(np.int64) - total + right, 2 * len(split)
    return *(np.concatenate(v) for v in (feature, cut, left, p)), gains


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at, live = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(live := live[feature[at[live]] >= 0]):
        n = at[live]
        at[live] = left[n] + (x[live, feature[n]] > cut[n])
    return at


def gini_best(table: pa.Table, order: np.ndarray, tries: int) -> dict:
    """Best cut of one large node from its sums by feature and cell: the first ``tries`` features of ``order`` and further
    ones until one varies."""
    f, cell, w = table["f"].to_numpy(), table["cell"].to_numpy(), np.stack([table["w0"].to_numpy(), table["w1"].to_numpy()], 1)
    best = {"score": -np.inf}
    for turn, k in enumerate(order):
        if turn >= tries and best["score"] > -np.inf:
            break
        at = np.flatnonzero(f == k)
        at = at[np.argsort(cell[at])]
        if len(at) < 2:
            continue
        run = np.cumsum(w[at], axis=0)
        l, r = run[:-1], run[-1] - run[:-1]
        score = (l * l).sum(1) / np.maximum(l.sum(1), 1e-300) + (r * r).sum(1) / np.maximum(r.sum(1), 1e-300)
        i = int(np.argmax(score))
        if score[i] > best["score"]:
            best = {"score": float(score[i]), "f": int(k), "cell": int(cell[at[i]]), "gain": float(score[i] - (run[-1] ** 2).sum() / run[-1].sum()),
                    "rows": int(table["n"].to_numpy()[at[:i + 1]].sum())}
            best |= {"l0": float(l[i, 0]), "l1": float(l[i, 1]), "r0": float(r[i, 0]), "r1": float(r[i, 1])}
    return best


# ---------------------------------------------------------------- the upper part of the trees
@dataclass
class Top:
    """Large nodes of one tree: they end in leaves (root = -1) or in the roots of subtrees."""
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [0])
    p: list = field(default_factory=lambda: [0.0])
    leaf: list = field(default_factory=lambda: [False])

    def split(self, node: int, feature: int, cut: float, sides: list[tuple[float, float]]) -> list[int]:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for w0, w1 in sides:
            self.feature.append(-1)
            self.cut.append(0.0)
            self.left.append(0)
            self.p.append(w1 / (w0 + w1) if w0 + w1 else 0.0)
            self.leaf.append(not (w0 > 0 and w1 > 0))
        return [len(self.feature) - 2, len(self.feature) - 1]

    def route(self, x: np.ndarray) -> np.ndarray:
        return walk(x, np.array(self.feature), np.array(self.cut, np.float32), np.array(self.left))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of 32-bit floats as binary values."""
    n, size = len(x), x.shape[1] * 4
    data = np.ascontiguousarray(x, np.float32).tobytes()
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(data)])


@dataclass
class ForestModel:
    """Subtrees as a table (one row each), the large nodes above them, and impurity importances."""
    subtrees: DataFrame
    tops: list
    importances: np.ndarray
    features: str = "features"
    size: int = 0  # bytes of all subtrees
    _sent: object = None

    def positive(self) -> Column:
        """Probability of class 1 as a column, by a broadcast model."""
        if self._sent is None:
            one = lambda r: (np.frombuffer(r.feature, np.int8), np.frombuffer(r.cut, np.float32), np.frombuffer(r.left, np.int32),
                             np.rint(np.frombuffer(r.p) * ONE).astype(np.int64))
            trees = {(r.tree, r.root): one(r) for r in self.subtrees.drop("gains").collect()}  # at most BROADCAST_BYTES
            self._sent = self.subtrees.sparkSession.sparkContext.broadcast(trees)
        sent, tops = self._sent, self.tops

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series(np.zeros(0))
            x, total = np.stack(v.to_numpy()).astype(np.float32), np.zeros(len(v), np.int64)
            for t, top in enumerate(tops):
                at = top.route(x)
                for node in np.unique(at).tolist():
                    rows = np.flatnonzero(at == node)
                    if top.leaf[node]:
                        total[rows] += round(top.p[node] * ONE)
                    else:
                        feature, cut, left, p = sent.value[t, node]
                        total[rows] += p[walk(x[rows], feature, cut, left)]
            return pd.Series(total / float(ONE) / len(tops))

        return score(vector_to_array(F.col(self.features), "float32"))

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns plus ``p``: the mean leaf probability of all trees. A model of up to ``BROADCAST_BYTES`` goes to
        the rows; a larger one is cut into pieces of about ``PIECE_BYTES``, and ``SCORE_ROWS`` distinct vectors at once meet each
        piece, so a vector is sent once for each piece and not for each tree."""
        if self.size <= BROADCAST_BYTES:
            return df.select(*keep, self.positive().alias("p"))
        tops = self.tops
        rows = df.select(*keep, vector_to_array(F.col(self.features), "float32").alias("_x"))
        ensure_checkpoint_dir(df.sparkSession)
        vectors = rows.select(F.col("_x").alias("x")).distinct().checkpoint()
        parts, pieces = max(1, -(-vectors.count() // SCORE_ROWS)), max(1, -(-self.size // PIECE_BYTES))

        def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table({"x": pa.array([], pa.list_(pa.float32())), "p": pa.array([], pa.int64())})
            first, column = key[0].as_py() == 0, pa.concat_arrays(left["x"].chunks)
            x, total = column.flatten().to_numpy(zero_copy_only=False).reshape(left.num_rows, -1), np.zeros(left.num_rows, np.int64)
            held: dict[int, dict] = {t: {} for t in range(len(tops))} if first else {}
            for s in right.select(["tree", "root", "feature", "cut", "left", "p"]).to_pylist():
                held.setdefault(s["tree"], {})[s["root"]] = s
            for t, roots in held.items():
                top = tops[t]
                at = top.route(x)
                for node in np.unique(at).tolist():
                    rows = np.flatnonzero(at == node)
                    if top.leaf[node]:
                        total[rows] += round(top.p[node] * ONE) if first else 0  # counted by one piece
                    elif node in roots:
                        s = roots[node]
                        leaf = walk(x[rows], np.frombuffer(s["feature"], np.int8), np.frombuffer(s["cut"], np.float32), np.frombuffer(s["left"], np.int32))
                        total[rows] += np.rint(np.frombuffer(s["p"])[leaf] * ONE).astype(np.int64)
            at = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            return pa.table({"x": pa.ListArray.from_arrays(at, pa.array(x.ravel())), "p": pa.array(total)})

        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
        placed = vectors.select(every(pieces).alias("piece"), F.pmod(F.xxhash64("x"), F.lit(parts)).cast("int").alias("part"), "x")
        trees = self.subtrees.drop("gains").select(
            "*", F.pmod(F.xxhash64("tree", "root"), F.lit(pieces)).cast("int").alias("piece"), every(parts).alias("part"))
        met = placed.groupBy("piece", "part").cogroup(trees.groupBy("piece", "part")).applyInArrow(meet, "x array<float>, p long")
        scores = met.groupBy(F.col("x").alias("_x")).agg((F.sum("p") / F.lit(float(ONE)) / F.lit(len(tops))).alias("p"))
        return rows.join(scores, "_x").select(*keep, "p")


@dataclass
class ForestClassifier:
    """Estimator: ``fit`` a table with an assembled feature vector, a 0/1 label and (if weighted) a weight per class."""
    trees: int = 120
    seed: int = C.RANDOM_STATE
    label: str = "serious"
    features: str = "features"
    weight_col: str | None = None
    local_rows: int | None = None

    def fit(self, df: DataFrame) -> ForestModel:
        spark, local = df.sparkSession, self.local_rows or LOCAL_ROWS
        y = F.col(self.label).cast("int")
        weight = F.col(self.weight_col) if self.weight_col else F.lit(1.0)
        rows = df.select(vector_to_array(F.col(self.features), "float32").alias("x"), y.alias("y"), weight.alias("w"))
        weights = {r.y: r.w for r in rows.groupBy("y").agg(F.max("w").alias("w")).collect()}
        weights = np.array([weights.get(0, 1.0), weights.get(1, 1.0)], float)
        ensure_checkpoint_dir(spark)
        vectors = rows.groupBy("x").agg(F.count(F.when(F.col("y") == 0, 1)).alias("n0"), F.count(F.when(F.col("y") == 1, 1)).alias("n1"))
        vectors = vectors.select("x", F.xxhash64("x").alias("id"), "n0", "n1").checkpoint()
        n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no rows to fit the forest on")
        tries = max(1, int(dim ** 0.5))
        tops, gains = [Top() for _ in range(self.trees)], np.zeros((self.trees, dim))
        if n > local:
            self._grow_tops(vectors, dim, tops, gains, weights, tries, local)
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
        wave = max(1, WAVE_ROWS // n)
        for first in range(0, self.trees, wave):
            self._subtrees(vectors, dim, tops, range(first, min(self.trees, first + wave)), weights, tries).write.mode("append").parquet(path)
        subtrees = spark.read.schema(SUBTREE).parquet(path)
        for r in subtrees.select("tree", F.posexplode("gains").alias("f", "g")).groupBy("tree", "f").agg(F.sum("g").alias("g")).collect():
            gains[r.tree, r.f] += r.g  # trees * features rows
        total = gains.sum(1, keepdims=True)
        share = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).mean(0)
        size = subtrees.agg(F.sum(F.length("feature") + F.length("cut") + F.length("left") + F.length("p"))).first()[0]
        return ForestModel(subtrees, tops, share / share.sum() if share.sum() else share, self.features, size or 0)

    def _bags(self, batch: pa.RecordBatch, trees, tops, weights):
        """For each tree: the vectors in its bag, their weights, and the node of the upper part where each one ends."""
        x, ids = _vectors(batch), batch.column(1).to_numpy()
        counts = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], 1)
        for t in trees:
            w = bag(ids, counts, t, self.seed, weights)
            at = np.flatnonzero(w.sum(1) > 0)
            if len(at):
                yield t, x[at], w[at], tops[t].route(x[at])

    def _subtrees(self, vectors: DataFrame, dim: int, tops: list, trees: range, weights: np.ndarray, tries: int) -> DataFrame:
        seed = self.seed

        def deal(batches):
            for batch in batches:
                for t, x, w, node in self._bags(batch, trees, tops, weights):
                    go = ~np.array(tops[t].leaf)[node]
                    if go.any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(go.sum(), t, np.int32)), pa.array(node[go].astype(np.int32)), _packed(x[go]), pa.array(w[go, 0]), pa.array(w[go, 1])],
                            ["tree", "root", "x", "w0", "w1"])

        def finish(table: pa.Table) -> pa.Table:
            data = [bytes(v) for v in table["x"].to_pylist()]
            order = np.array(sorted(range(len(data)), key=data.__getitem__))  # rows arrive in any order
            x = np.frombuffer(b"".join(data), np.float32).reshape(-1, dim)[order]
            w = np.stack([table["w0"].to_numpy(), table["w1"].to_numpy()], 1)[order]
            t, root = table["tree"][0].as_py(), table["root"][0].as_py()
            f, cut, left, p, gains = grow(x, w, np.random.default_rng([seed, t, root]), tries)
            one = lambda v: pa.array([v.tobytes()], pa.binary())
            return pa.table({"tree": pa.array([t], pa.int32()), "root": pa.array([root], pa.int32()), "feature": one(f), "cut": one(cut), "left": one(left),
                             "p": one(p), "gains": pa.array([gains.tolist()])})

        return vectors.mapInArrow(deal, "tree int, root int, x binary, w0 double, w1 double").groupBy("tree", "root").applyInArrow(finish, SUBTREE)

    def _grow_tops(self, vectors: DataFrame, dim: int, tops: list, gains: np.ndarray, weights: np.ndarray, tries: int, local: int) -> None:
        shares = [i / CELLS for i in range(1, CELLS)]
        cuts = [np.unique(np.array(c, np.float32)) for c in vectors.select(
            *[F.percentile_approx(F.col("x")[f], shares, 10_000) for f in range(dim)]).first()]  # dim * CELLS numbers
        frontier, group = [(t, 0) for t in range(self.trees)], max(1, GROUP_BYTES // (dim * CELLS * 24))
        while frontier:
            later = []
            for first in range(0, len(frontier), group):
                part = frontier[first:first + group]
                for (t, node), best in zip(part, self._best_cuts(vectors, dim, tops, part, cuts, weights, tries)):
                    if best.get("f") is None:
                        continue  # all vectors share their cells: one task grows it
                    gains[t, best["f"]] += best["gain"]
                    sides = [(best["l0"], best["l1"]), (best["r0"], best["r1"])]
                    kids = tops[t].split(node, best["f"], float(cuts[best["f"]][best["cell"]]), sides)
                    sizes = (best["rows"], best["all"] - best["rows"])
                    later += [(t, k) for k, size in zip(kids, sizes) if size > local and not tops[t].leaf[k]]
            frontier = later

    def _best_cuts(self, vectors: DataFrame, dim: int, tops: list, part: list, cuts: list, weights: np.ndarray, tries: int) -> list[dict]:
        slots: dict[int, dict[int, int]] = {}
        for i, (t, node) in enumerate(part):
            slots.setdefault(t, {})[node] = i
        width, seed = CELLS + 1, self.seed

        def histograms(batches):
            sums = np.zeros((len(part) * dim * width, 3))
            for batch in batches:
                for t, x, w, node in self._bags(batch, slots, tops, weights):
                    place = np.full(len(tops[t].feature), -1)
                    place[list(slots[t])] = list(slots[t].values())
                    slot = place[node]
                    at = np.flatnonzero(slot >= 0)
                    for f in range(dim):  # cell c: cut c - 1 < x <= cut c
                        key = (slot[at] * dim + f) * width + np.searchsorted(cuts[f], x[at, f], side="left")
                        for c, v in enumerate((w[at, 0], w[at, 1], None)):
                            sums[:, c] += np.bincount(key, v, minlength=len(sums))
            at = np.flatnonzero(sums[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array((at // (dim * width)).astype(np.int32)), pa.array((at // width % dim).astype(np.int32)),
                                              pa.array((at % width).astype(np.int32)), *(pa.array(sums[at, c]) for c in range(3))], ["slot", "f", "cell", "w0", "w1", "n"])

        def choose(table: pa.Table) -> pa.Table:
            i = table["slot"][0].as_py()
            best = gini_best(table, np.random.default_rng([seed, *part[i], 1]).permutation(dim), tries)
            whole = int(table["n"].to_numpy()[table["f"].to_numpy() == 0].sum())
            names = ("f", "cell", "gain", "rows", "l0", "l1", "r0", "r1")
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), *[pa.float64()] * 4)
            return pa.table({"slot": pa.array([i], pa.int32()), "all": pa.array([whole], pa.int64()), **{k: pa.array([best.get(k)], t) for k, t in zip(names, kinds)}})

        sums = vectors.mapInArrow(histograms, "slot int, f int, cell int, w0 double, w1 double, n double").groupBy("slot", "f", "cell").agg(
            F.sum("w0").alias("w0"), F.sum("w1").alias("w1"), F.sum("n").alias("n"))
        got = sums.groupBy("slot").applyInArrow(choose, "slot int, all long, f int, cell int, gain double, rows long, l0 double, l1 double, r0 double, r1 double")
        found = {r.slot: r.asDict() for r in got.collect()}  # a row for each node of the group
        return [found.get(i, {}) for i in range(len(part))]
