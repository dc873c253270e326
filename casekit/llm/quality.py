"""Operator 1: quality rules, gradient-boosted trees over document statistics.

Statistics are counted over whole texts. Trees are grown here (histogram splits, logistic loss) on
a bounded sample of labelled documents, with monotonic constraints on chosen features: a split that
would break one is not taken, and the bounds of both children are set at the middle of their values.
The grown forest is flattened into numpy node arrays; scoring steps all rows through all trees at
once.

Null or empty texts have zero statistics and fail the base rule (fewer than 20 words); repeated rows
each give a row; an empty table gives an empty result; other columns are ignored. Without labels of
both classes the verdict is the base rule alone (probability 1).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import U64, mix, raw, slices

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and their constraint: +1 / -1 the probability never falls / rises with the feature, 0 free.
FEATURES = (("log_words", 1), ("mean_word", 0), ("symbols_per_word", -1), ("dup_line_share", -1),
            ("repeat_share", -1), ("top_word_share", 0), ("distinct_share", 0), ("bar_share", -1),
            ("upper_share", 0), ("digit_share", 0), ("mean_line_words", 0), ("symbol_word_share", -1))
#: Bound of the labelled sample that the trees are grown on (documents, in order of a hash of doc_id).
SAMPLE = 8_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
WINDOW = 8


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 8-word windows that occur twice or more (exact: ranks of pairs, pairs of pairs, ...)."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    rolled = ids.astype(U64)
    for step in (1, 2, 4):
        rolled = mix(rolled[:-step] * U64(0x9E3779B97F4A7C15) + rolled[step:])
    once = np.sort(rolled)
    if not (once[1:] == once[:-1]).any():  # equal windows have equal hashes
        return 0
    rank = ids
    for step in (1, 2, 4):
        rank = np.unique(rank[:-step] * np.int64(len(ids) + 1) + rank[step:], return_inverse=True)[1]
    again = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[again] += 1
    edge[again + WINDOW] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The base counts and the features of one whole text (UTF-8)."""
    words = text.split()  # bytes.split() cuts at exactly [\x20\x09-\x0D]
    n = len(words)
    if not n:
        return [0, 0, int(_SYMBOL[np.frombuffer(text, np.uint8)].sum()), 0, 0], [0.0] * len(FEATURES)
    data = np.frombuffer(text, np.uint8)
    counts = np.bincount(data, minlength=256)
    chars = int(counts.sum() - counts[0x80:0xC0].sum())
    word_chars = chars - int(counts[_SPACES].sum())
    symbols = int(counts[_SYMBOL].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeat = repeated_words(ids)
    marked = sum(c for w, c in Counter(words).items() if w.translate(None, b"#*$%&|<>") != w) if symbols else 0
    feats = [np.log1p(n), word_chars / n, symbols / n, dup / len(lines), repeat / n, np.bincount(ids).max() / n,
             len(number) / n, int(counts[0x7C]) / n, int(counts[0x41:0x5B].sum()) / word_chars,
             int(counts[0x30:0x3A].sum()) / word_chars, n / len(lines), marked / n]
    return [n, word_chars, symbols, dup, repeat], feats


@dataclass
class Forest:
    """All trees in flat arrays: node -> feature (-1: leaf), threshold, children, value."""
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            go = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, go)
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, signs, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48,
         ridge: float = 1.0, least: float = 4.0) -> Forest:
    """Newton boosting with histogram splits under monotonic constraints ``signs``."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    p0 = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    score = np.full(len(y), base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def leaf_value(g, h, low, high):
        return float(np.clip(-g / (h + ridge), low, high))

    def build(rows, level, low, high, grad, hess):
        me = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([-1, 0.0, -1, -1, leaf_value(g, h, low, high)])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for j, sign in enumerate(signs):
                k = len(cuts[j])
                if not k:
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, grad[rows], k + 1))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], k + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=k + 1))[:-1]
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(g - gl) / (h - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (g - gl)**2 / (h - hl + ridge) - g**2 / (h + ridge)
                ok = (nl >= least) & (len(rows) - nl >= least) & ((vr - vl) * sign >= 0)
                gain = np.where(ok, gain, -1)
                s = int(np.argmax(gain))
                if gain[s] > best[0]:
                    best = (float(gain[s]), (j, s, float(vl[s]), float(vr[s])))
        if best[1] is None:
            score[rows] += rate * nodes[me][4]
            nodes[me][4] *= rate
            return me
        j, s, vl, vr = best[1]
        go = binned[rows, j] <= s
        mid = (vl + vr) / 2
        lows, highs = (low, low), (high, high)
        if signs[j] > 0:
            lows, highs = (low, mid), (mid, high)
        elif signs[j] < 0:
            lows, highs = (mid, low), (high, mid)
        a = build(rows[go], level + 1, lows[0], highs[0], grad, hess)
        b = build(rows[~go], level + 1, lows[1], highs[1], grad, hess)
        nodes[me] = [j, float(cuts[j][s]), a, b, 0.0]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(build(np.arange(len(y)), 0, -np.inf, np.inf, p - y, np.maximum(p * (1 - p), 1e-6)))
    f, t, a, b, v = (np.array(c) for c in zip(*nodes))
    return Forest(np.array(roots), f.astype(np.int64), t, a.astype(np.int64), b.astype(np.int64), v, base, depth)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """Grow the forest on at most ``sample`` labelled documents (crc32(doc_id) mod 5 = 0 stays held out)."""
    picked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .where("doc_id IS NOT NULL AND quality IN (0, 1) AND crc32(cast(doc_id AS string)) % 5 != 0")
              .groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = picked.collect()  # bounded by ``sample``
    if len({r.quality for r in rows}) < 2:
        return None
    spark = docs.sparkSession
    known = spark.createDataFrame(rows, "doc_id long, quality int")
    got = (_needed(docs).join(F.broadcast(known), "doc_id").mapInArrow(_features, _FIT_SCHEMA).toPandas())
    if got.quality.nunique() < 2:
        return None
    got = got.sort_values("doc_id", kind="stable")
    return grow(np.stack(got.features.to_list()), got.quality.to_numpy(float), [s for _, s in FEATURES])


_FIT_SCHEMA = "doc_id long, quality int, features array<double>"


def _features(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("quality")),
                 pa.array([[float(v) for v in statistics(t)[1]] for t in raw(part, "text")], pa.list_(pa.float64()))],
                ["doc_id", "quality", "features"])


def judge(docs: DataFrame, forest: Forest | None, cut: float = 0.5) -> DataFrame:
    """Counts, base verdict, probability of good quality and the final verdict of every row."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                stats = [statistics(t) for t in raw(part, "text")]
                base = np.array([s[0] for s in stats], np.int64).reshape(-1, len(BASE))
                x = np.array([s[1] for s in stats], float).reshape(-1, len(FEATURES))
                p = forest.probability(x) if forest is not None else np.ones(len(x))
                failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(base[:, i]) for i in range(len(BASE))), pa.array(failed),
                     pa.array(~failed & (p >= cut)), pa.array(p)],
                    ["doc_id", *BASE, "base_failed", "kept", "probability"])

    schema = ", ".join(["doc_id long", *(f"{b} long" for b in BASE), "base_failed boolean, kept boolean, probability double"])
    return _needed(docs).mapInArrow(run, schema)


def _needed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
