"""Operator 7: toxicity by a subsequence string kernel, Nystrom landmarks and a linear support vector machine.

Words are compared by the gap-weighted subsequence kernel: every choice of three letters in order, with up to
two letters or other characters skipped between neighbours, weighs ``DECAY`` for each one skipped; the kernel
is normalised and raised to ``POWER``. So "idi-ot", "idioot" and "i d i o t" stay close to "idiot". Two
sentences are compared by the sum over their pairs of words (a convolution kernel). Landmarks are words of the
training sentences: those that tell the classes apart most, clean ones that look like those, and frequent ones. Nystrom features of a sentence
are its kernel values to the landmarks times the inverse root of the landmarks' kernel matrix; a linear
squared-hinge machine is trained on them with each sentence labelled as its document, then once more with only
those sentences of toxic documents that stand out from clean ones. A logistic step on the document's highest
sentence margin and on the number and share of its positive sentences gives the score.

As the machine is linear, a sentence's margin is a sum over its words, so each distinct word is scored once per
worker (bounded memory), and whole texts are read. Words over 32 letters are cut into overlapping ones.

Training: at most ``SAMPLE`` labelled documents whose crc32(doc_id) mod 5 is not 0. Null and empty texts have no
sentence and get the score of a text without any insult; repeated rows each give a row; an empty table gives an
empty result; other columns are never read. Of several labels of a doc_id the least counts, of several texts the
least is learned from. Without labels of both classes every score is the share of toxic
labels (0 without labels).
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import held, slices, texts

SAMPLE = 1_000  # documents of each class at most
LANDMARKS, BACKGROUND, LIKE = 64, 16, 48  # telling, frequent, and clean words that look like telling ones
TELLS = 1.5  # least log odds of a telling landmark
GAP, DECAY, POWER, WIDTH, STEP = 3, 0.6, 3, 32, 16
LETTERS = 40  # a-z and 14 classes for other letters
#: Digits and signs that stand for letters inside a word.
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_-]){2,}[^\W\d_](?![^\W_])")
CHUNK = 20_000  # words whose kernel values are held at once in training
ROWS = 8_192  # sentences whose features are multiplied at once in training
LEAST = 10  # labelled documents of each class without which a model may not reject rows
APART = 0.2  # least difference of the shares rejected among toxic and clean labelled rows of a model that may reject rows
KEEP, ALONE = 100_000, 400_000  # tokens remembered by a worker as a stage beside others, and by one that scores alone
SLICE = 250_000  # text bytes scored at once
SIGNS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
_CODES = bytes(c - 96 if 97 <= c <= 122 else 0 for c in range(256))


def letters(token: str) -> list[bytes]:
    """Words of a token as letter codes 1-40 (0: another character, a gap); long ones in overlapping pieces."""
    word = token.strip(SIGNS)
    if word and not (word[0].isalnum() and word[-1].isalnum()):
        start, end = 0, len(word)
        while start < end and not word[start].isalnum():
            start += 1
        while end > start and not word[end - 1].isalnum():
            end -= 1
        word = word[start:end]
    if word.isascii() and word.isalpha() and len(word) <= WIDTH:
        return [word.encode().translate(_CODES)] if len(word) >= 3 else []
    if any(c.isalpha() for c in word):
        word = word.translate(LOOKALIKE)
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    codes = bytes(ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 14 if c.isalpha() else 0 for c in word)
    if len(codes) <= WIDTH:
        return [codes] if sum(1 for c in codes if c) >= 3 else []
    pieces = [codes[i:i + WIDTH] for i in range(0, len(codes) - STEP, STEP)]
    return [p for p in pieces if sum(1 for c in p if c) >= 3]


def tokens(text: str) -> list[str]:
    """Lower-cased tokens; a line end is a token "." of its own; spelled-out words are one token;
    a token that follows itself counts once."""
    text = text.lower()
    cut = SPELLED.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), text).replace("\n", " . ").split()
    return [t for t, _ in groupby(cut)]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence code, value) of all words; values of a word have unit length."""
    width = max(map(len, words), default=0)
    x = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).astype(np.int64)
    base, rows, codes, values = LETTERS + 1, [], [], []
    for a in range(1, GAP + 1):
        for b in range(1, GAP + 1):
            c1, c2, c3 = x[:, :max(width - a - b, 0)], x[:, a:max(width - b, a)], x[:, a + b:]
            at = np.nonzero((c1 > 0) & (c2 > 0) & (c3 > 0))
            rows.append(at[0])
            codes.append((c1[at] * base + c2[at]) * base + c3[at])
            values.append(np.full(len(at[0]), DECAY ** (a + b - 2)))
    key = np.concatenate(rows) * base**3 + np.concatenate(codes)
    order = np.argsort(key)
    key, value = key[order], np.concatenate(values)[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    key, value = key[first], (np.add.reduceat(value, first) if len(first) else value)
    word = key // base**3
    norm = np.sqrt(np.bincount(word, value**2, len(words)))
    return word, key % base**3, value / np.maximum(norm[word], 1e-12)


def kernel(words: list[bytes], marks: list[bytes]) -> np.ndarray:
    """Kernel of each word to each landmark."""
    out, n = np.zeros((len(words), len(marks)), np.float32), len(marks)
    mark, code, value = features(marks)
    order = np.argsort(code, kind="stable")
    mark, code, value = mark[order], code[order], value[order]
    known, start, many = np.unique(code, return_index=True, return_counts=True)
    place = np.full((LETTERS + 1)**3, -1, np.int64)
    place[known] = np.arange(len(known))
    order = np.argsort(np.array([len(w) for w in words], int), kind="stable")  # words of like length share a matrix
    for at in range(0, len(words), 1000):
        part = order[at:at + 1000]
        word, code, weight = features([words[i] for i in part])
        hit = place[code]
        word, weight, hit = word[hit >= 0], weight[hit >= 0], hit[hit >= 0]
        times = many[hit]  # a subsequence stands in few landmarks: only those are multiplied
        each = np.repeat(start[hit] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        cell = np.repeat(word * n, times) + mark[each]
        out[part] = np.bincount(cell, np.repeat(weight, times) * value[each], len(part) * n).reshape(len(part), n)
    return np.clip(out, 0, 1, out=out)**POWER


@dataclass
class Model:
    """Landmarks, their weights, the machine's offset and the logistic step."""
    marks: list[bytes] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    offset: float = 0.0
    logit: np.ndarray = field(default_factory=lambda: np.zeros(4))
    share: float | None = None
    apart: bool = False  # whether it tells the labelled classes apart


class Scorer:
    def __init__(self, model: Model, keep: int = KEEP):
        self.keep = keep
        self.m, self.number, self.gain, self.ends, self.value = model, {}, np.zeros(0), np.zeros(0, bool), {}

    def learn(self, new: list[str]) -> None:
        words = [letters(t) for t in new]
        flat = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in self.value]
        if flat:
            self.value.update(zip(flat, (kernel(flat, self.m.marks) @ self.m.weights).tolist()))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.gain = np.concatenate([self.gain, [sum(self.value[w] for w in ws) for ws in words]])
        self.ends = np.concatenate([self.ends, [t[-1] in ".!?" for t in new]])

    def evidence(self, docs: list[str]) -> np.ndarray:
        """For each text: 1, highest sentence margin, log of positive sentences, their share."""
        cut = [tokens(t) for t in docs]
        if len(self.number) > self.keep:
            self.number, self.gain, self.ends, self.value = {}, np.zeros(0), np.zeros(0, bool), {}
        new = list(set(chain.from_iterable(cut)) - self.number.keys())
        if new:
            self.learn(sorted(new))
        size = np.array([len(c) for c in cut])
        out = np.zeros((len(docs), 4))
        out[:, 0], out[:, 1] = 1, self.m.offset
        ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(size.sum()))
        if len(ids):
            full = np.flatnonzero(size)
            begin = (np.cumsum(size) - size)[full]
            starts = np.zeros(len(ids), bool)
            starts[1:] = self.ends[ids][:-1]
            starts[begin] = True
            first = np.flatnonzero(starts)
            margin = np.add.reduceat(self.gain[ids], first) + self.m.offset
            at = np.searchsorted(first, begin)
            out[full, 1] = np.maximum.reduceat(margin, at)
            positive = np.add.reduceat((margin > 0).astype(float), at)
            out[full, 2] = np.log1p(positive)
            out[full, 3] = positive / np.diff(np.r_[at, len(first)])
        return out

    def score(self, docs: list[str]) -> np.ndarray:
        if self.m.share is not None:
            return np.full(len(docs), self.m.share)
        return 1 / (1 + np.exp(-np.clip(self.evidence(docs) @ self.m.logit, -40, 40)))


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Linear squared-hinge machine by Newton steps on the active rows; the last column of ``x`` is 1. Rows of weight 0 take
    no part. Rows are read ``ROWS`` at a time, so that no copy of all of them is made."""
    w, n = np.zeros(x.shape[1]), x.shape[1]
    pull = np.full(n, ridge)
    pull[-1] = 1e-6
    active = np.zeros(len(y), bool)
    for step in range(steps):
        before, left, right = active.copy(), np.diag(pull).astype(float), np.zeros(n)
        for at in range(0, len(y), ROWS):
            part = slice(at, at + ROWS)
            rows = x[part]
            active[part] = (y[part] * (rows @ w.astype(np.float32)) < 1) & (weight[part] > 0)
            rows = rows[active[part]]
            scale = weight[part][active[part]].astype(np.float32)
            left += (rows * scale[:, None]).T @ rows
            right += rows.T @ (scale * y[part][active[part]].astype(np.float32))
        if step and (before == active).all():
            break
        w = np.linalg.solve(left, right)
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def train(docs: list[str], toxic: np.ndarray, odds: float | None = None) -> Model:
    """Model from labelled texts (both classes present); ``odds``: of toxic among all labelled rows."""
    pool: dict[str, str] = {}  # one string for each distinct token
    cut = [[pool.setdefault(t, t) for t in tokens(d)] for d in docs]
    known = {t: letters(t) for t in set(chain.from_iterable(cut))}
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for c, y in zip(cut, toxic):
        seen[int(y)].update(set(chain.from_iterable(known[t] for t in set(c))))
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    tells = {w: k / n1 * np.log((k + 0.5) / (n1 + 1) * (n0 + 1) / (seen[0][w] + 0.5)) for w, k in seen[1].items()}
    marks = sorted((w for w in tells if seen[1][w] >= 2 and tells[w] > TELLS * seen[1][w] / n1), key=lambda w: (-tells[w], w))[:LANDMARKS]
    chosen = set(marks)
    clean = [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0])) if w not in chosen]
    if marks:
        alike = np.concatenate([kernel(clean[i:i + CHUNK], marks).max(axis=1) for i in range(0, len(clean), CHUNK)] or [np.zeros(0)])
        alike = alike * np.array([seen[0][w] for w in clean])
        marks += [clean[i] for i in np.argsort(-alike, kind="stable")[:LIKE] if alike[i] > 0]
    chosen.update(marks)
    marks += [w for w in clean if w not in chosen][:BACKGROUND]
    if not marks:
        return Model(share=float(toxic.mean()))
    flat = list(dict.fromkeys(chain.from_iterable(known.values())))
    place = {w: i for i, w in enumerate(flat)}
    gram = kernel(marks, marks)
    val, vec = np.linalg.eigh((gram + gram.T) / 2)
    root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-2))) @ vec.T
    owner, word, sentence = [], [], []
    for i, c in enumerate(cut):
        start = 0
        for j, t in enumerate(c):
            if t[-1] in ".!?" or j + 1 == len(c):
                words = [place[w] for u in c[start:j + 1] for w in known[u]]
                if words:
                    word += words
                    sentence += [len(owner)] * len(words)
                    owner.append(i)
                start = j + 1
    word_a, sentence_a = np.array(word, np.int32), np.array(sentence, np.int32)
    del word, sentence, cut, known, pool
    x = np.zeros((len(owner), len(marks) + 1), np.float32)
    for at in range(0, len(flat), CHUNK):  # adds up each sentence's kernel values, some words at a time
        use = np.flatnonzero((word_a >= at) & (word_a < at + CHUNK))
        near = kernel(flat[at:at + CHUNK], marks)
        for k in range(0, len(use), 100_000):
            part = use[k:k + 100_000]  # in order of sentences
            first = np.flatnonzero(np.r_[True, np.diff(sentence_a[part]) > 0])
            x[sentence_a[part][first], :-1] += np.add.reduceat(near[word_a[part] - at], first, axis=0)
    for at in range(0, len(x), ROWS):
        x[at:at + ROWS, :-1] = x[at:at + ROWS, :-1] @ root.astype(np.float32)
    x[:, -1] = 1
    owner_a = np.array(owner, int)
    y = np.where(toxic[owner_a] == 1, 1.0, -1.0)

    def fitted(use, sign):
        balance = np.where(sign > 0, 0.5 / max((sign[use] > 0).sum(), 1), 0.5 / max((sign[use] < 0).sum(), 1))
        return machine(x, sign, balance * use.sum() * use)

    w = fitted(np.ones(len(y), bool), y)
    margin = np.concatenate([x[at:at + ROWS] @ w.astype(np.float32) for at in range(0, len(x), ROWS)] or [np.zeros(0)])
    stands_out = margin > np.quantile(margin[y < 0], 0.995)
    use = (y < 0) | stands_out
    if (use & (y > 0)).any():
        w = fitted(use, y)
    model = Model(marks, root @ w[:-1], float(w[-1]))
    scorer = Scorer(model)
    shown = np.vstack([scorer.evidence(docs[i:i + 200]) for i in range(0, len(docs), 200)])
    model.logit = logistic(shown, toxic.astype(float))
    if odds:  # the sample is balanced, the labelled rows are not
        model.logit[0] += np.log(odds * n0 / n1)
    rejected = shown @ model.logit >= 0
    model.apart = min(n0, n1) >= LEAST and bool(rejected[toxic == 1].mean() - rejected[toxic == 0].mean() >= APART)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled documents of each class (chosen by a hash of doc_id)."""
    rows = []
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id IS NOT NULL AND toxic IN (0, 1) AND crc32(cast(doc_id AS string)) % 5 != 0").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    total = {r.toxic: r["count"] for r in good.groupBy("toxic").count().collect()}
    for y in (1, 0):
        rows += good.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    if not rows:
        return Model(share=0.0)
    known = docs.sparkSession.createDataFrame(rows, "doc_id long, toxic int")  # bounded by 2 * sample
    text = F.coalesce("text", F.lit("")).alias("text")
    got = _needed(docs).join(F.broadcast(known), "doc_id").select("doc_id", text, "toxic").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    toxic = got.toxic.to_numpy(int)
    if len(set(toxic)) < 2:
        return Model(share=float(toxic.mean()) if len(toxic) else 0.0)
    return train(got.text.to_list(), toxic, total[1] / total[0])


def _scorer(model: Model, keep: int = KEEP) -> Scorer:
    """One scorer for each model and worker process, so that its words outlive a task."""
    return held(("toxicity", tuple(model.marks), model.weights.tobytes(), model.offset, model.logit.tobytes(), model.share, keep), lambda: Scorer(model, keep))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    def run(batches):
        s = _scorer(model, ALONE)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.score(texts(part, "text")))], ["doc_id", "score"])

    got = _needed(docs).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score stays under ``most``, all columns as they are (one scan, no shuffle). A model that does
    not tell the labelled classes apart, or saw fewer than ``LEAST`` documents of one, rejects nothing; a warning says so."""
    if not model.apart:
        warnings.warn("The toxicity model cannot tell the labelled classes apart: all rows are kept", stacklevel=2)
        return docs

    def run(batches):
        s = _scorer(model)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield part.filter(pa.array(s.score(texts(part, "text")) < most))

    return docs.mapInArrow(run, docs.schema)


def _needed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
