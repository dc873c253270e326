"""Operator 8: document fingerprints by consistent weighted sampling.

Terms of a text are its pairs of neighbouring words (A-Z lower-cased; a text of one word has that word), weighted
by their counts. For each of ``SAMPLES`` samples every term has its own r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1),
fixed by a hash of the term; with t = floor(ln w / r + b) the sample is the (term, t) with the least
ln c - r (t - b) - r. Two texts take the same sample with a probability equal to their generalised Jaccard
similarity (sum of minima over sum of maxima of the weights), so the share of equal samples estimates it. A hash of
term and sample gives the variates: r and b from a table of ``LEVELS`` draws, c continuously (a quantile level and the
place within it), so texts of any length are sampled alike; the identity of a sample is a hash of term and t (16 bits
of it are kept).

The edited text of a document needs the beginning of the next document. Rows are dealt by ranges of doc_id, the
first document of each range is also sent to the end of the range before it, and each task reads its ranges from the
end, so that the following text is known when a row comes and no row waits: whole texts are shuffled once. A doc_id of
several rows sends one of them through the ranges; the text that follows is then joined to all its rows, salted by
their number. Rows without doc_id are mapped where they are.

Null texts count as empty; texts without words have the fingerprint "" (alike only among themselves). Rows that
repeat a doc_id each give a row; the next document is then the first row (by text) of the next larger doc_id. A
single document is followed by itself; rows without doc_id have no next document (empty). An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casekit.llm.common import LOWER, U64, cut, mix, small, word_hashes

SAMPLES, LEVELS = 64, 1 << 16
SLICE = 1_000_000  # characters worked on at once
#: A range of doc_id spans at least 2^8 ids; more, in steps of 2^4, until there are at most this many ranges.
RANGES = 1_000_000
SALTED = 256  # rows of one doc_id dealt together
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _draws() -> tuple[np.ndarray, ...]:
    """By level: quantiles of ln c and the way to the next one; by draw: r and b."""
    rng = np.random.Generator(np.random.PCG64(20_240_607))
    edges = np.empty(LEVELS + 1)  # c with 1 - (1 + c) exp(-c) = level / LEVELS, by halving
    low, high, want = np.zeros(LEVELS + 1), np.full(LEVELS + 1, 60.0), np.arange(LEVELS + 1) / LEVELS
    for _ in range(80):
        mid = (low + high) / 2
        over = -np.expm1(-mid) - mid * np.exp(-mid) > want
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    edges = np.log(np.maximum(low, 1e-300))
    r, b = rng.gamma(2.0, 1.0, LEVELS), rng.random(LEVELS)
    return edges[:-1].astype(np.float32), np.diff(edges).astype(np.float32), r.astype(np.float32), b.astype(np.float32)


_LOG_C, _STEP, _R, _B = _draws()
_ONCE = _R * _B - _R + np.float32(64)  # weight 1: t = 0; all keys are positive, so that their bits are in order
_TURN = mix(np.arange(1, SAMPLES + 1, dtype=U64)) | U64(1)
_LOW = U64(0xFFFFFFFF)


def _log_c(y: np.ndarray) -> np.ndarray:
    """ln c of 64-bit hashes: the upper 16 bits choose the level, the lower 32 bits the place within it."""
    level = (y >> U64(48)).astype(np.intp)
    place = (y & _LOW).astype(np.float32) * np.float32(2.0 ** -32)
    out = _LOG_C[level] + place * _STEP[level]
    least = np.flatnonzero(level == 0)  # the tail: 1 - (1 + c) exp(-c) is c^2 / 2 here
    out[least] = 0.5 * np.log(2 * (place[least].astype(float) + 2.0 ** -33) / LEVELS)
    return out


def _key(value: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """Order of positive float32 values, then a hash, as 64-bit integers."""
    return value.view(np.uint32).astype(U64) << U64(32) | ident


def weighted_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and counts of the distinct terms of all texts in order, and their number in each text."""
    words, n = word_hashes([t.translate(LOWER) for t in texts])
    pair = mix(words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:]) if len(words) else words
    terms, counts, sizes, at = [], [], [], 0
    for k in n.tolist():
        own = words[at:at + k] if k < 2 else pair[at:at + k - 1]
        h, c = np.unique(own, return_counts=True)
        terms.append(h)
        counts.append(c)
        sizes.append(len(h))
        at += k
    return np.concatenate(terms), np.concatenate(counts), np.array(sizes)


def signatures(texts: list[bytes]) -> np.ndarray:
    """Samples (uint16) of each text; a row of a text without words is all zero."""
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    if not texts:
        return out
    terms, counts, sizes = weighted_terms(texts)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    first = (np.cumsum(sizes) - sizes)[full]
    ident = mix(terms) & _LOW
    more = np.flatnonzero(counts > 1)
    log_w, again = np.log(counts[more]).astype(np.float32), terms[more]
    for k in range(SAMPLES):
        y = terms * _TURN[k]
        y ^= y >> U64(29)
        y *= U64(0xBF58476D1CE4E5B9)
        draw = (y >> U64(32)).astype(np.uint16)
        log_c = _log_c(y)
        key = _key(log_c + _ONCE[draw], ident)
        if len(more):
            r, b = _R[draw[more]], _B[draw[more]]
            t = np.floor(log_w / r + b)
            key[more] = _key(log_c[more] - r * (t - b) - r + np.float32(64), mix(again + t.astype(U64) * U64(0xA0761D6478BD642F)) & _LOW)
        out[full, k] = (np.minimum.reduceat(key, first) & U64(0xFFFF)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray, words_a: bool, words_b: bool) -> float:
    if not words_a or not words_b:
        return float(words_a == words_b)
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as many characters from the start of ``following`` (or all)."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def ranges(docs: DataFrame) -> tuple[int, DataFrame]:
    """Shift that makes ranges of doc_id, and (head, before): each range's first id, and the range that it follows."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    steps = list(range(8, 64, 4))
    n = ids.agg(*(F.approx_count_distinct(F.shiftright("doc_id", s)).alias(str(s)) for s in steps)).first()
    shift = next((s for s in steps if n[str(s)] <= RANGES), steps[-1])
    firsts = ids.groupBy(F.shiftright("doc_id", shift).alias("part")).agg(F.min("doc_id").alias("head"))
    order = Window.orderBy("head")  # at most about RANGES rows
    last = firsts.agg(F.max("part")).first()[0]
    return shift, cut(firsts.select("head", F.coalesce(F.lag("part").over(order), F.lit(last)).cast("long").alias("before")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row."""
    shift, firsts = ranges(docs)
    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known, unknown = need.where("doc_id IS NOT NULL"), need.where("doc_id IS NULL")
    often = cut(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                .select("doc_id", F.ceil(F.col("n") / SALTED).cast("long").alias("salts")))
    repeated, links = bool(often.limit(1).count()), known.withColumn("stands_for", F.lit(False))
    if repeated:
        few = small(often, RANGES)
        rows = known.join(few, "doc_id")
        links = known.join(few, "doc_id", "left_anti").withColumn("stands_for", F.lit(False)).union(
            rows.groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.lit(True)))
    part = F.shiftright("doc_id", shift)
    own = F.struct(part.alias("part"), F.lit(0).alias("tail"))
    spread = links.join(small(firsts, 2 * RANGES), F.col("doc_id") == F.col("head"), "left").select(
        "doc_id", "text", "stands_for", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(
            F.array(own, F.struct(F.col("before").alias("part"), F.lit(1).alias("tail"))))).alias("x"))
    dealt = spread.select("x.part", "x.tail", "stands_for", "doc_id", "text").repartition("part").sortWithinPartitions(
        "part", F.desc("tail"), F.desc("doc_id"))
    out = dealt.mapInArrow(_ranges_from_the_end, f"{OUT}, following string")
    if repeated:
        done = cut(out)
        out = done.where("following IS NULL")
        following = done.where("following IS NOT NULL").select("doc_id", "following").join(few, "doc_id")
        following = following.select("doc_id", "following", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        salted = rows.select("doc_id", "text", F.pmod(F.monotonically_increasing_id(), F.col("salts")).alias("salt"))
        out = out.drop("following").union(salted.join(following, ["doc_id", "salt"]).select("doc_id", "text", "following").mapInArrow(_each, OUT))
    else:
        out = out.drop("following")
    if unknown.limit(1).count():
        out = out.union(unknown.select("doc_id", "text", F.lit("").alias("following")).mapInArrow(_each, OUT))
    return out


def _in_slices(rows):
    """Fingerprints of (doc_id, text, following text), about ``SLICE`` characters at a time."""
    ready, size = [], 0
    for row in rows:
        ready.append(row)
        size += len(row[1]) + len(row[2])
        if size > SLICE:
            yield _fingerprint(ready)
            ready, size = [], 0
    if ready:
        yield _fingerprint(ready)


def _each(batches):
    return _in_slices(row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3))))


def _ranges_from_the_end(batches):
    """Fingerprints of rows by descending doc_id (the tail first), each followed by the row that came before it; a row
    that stands for a repeated doc_id gives only the text that follows it."""
    ready, stands, size = [], [], 0

    def flush():
        if ready:
            got = _fingerprint(ready)
            yield got.append_column("following", pa.nulls(got.num_rows, pa.string()))
        if stands:
            nothing = [pa.nulls(len(stands), t) for t in (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in stands], pa.int64()), *nothing, pa.array([f for _, f in stands], pa.string())],
                                             [*COLUMNS, "following"])

    now, after = None, ""
    for batch in batches:
        for part, tail, stands_for, doc, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if part != now:
                now, after = part, ""
            if not tail:
                if stands_for:
                    stands.append((doc, after))
                else:
                    ready.append((doc, text, after))
                size += len(text) + len(after)
            after = text
            if size > SLICE:
                yield from flush()
                ready, stands, size = [], [], 0
    yield from flush()


def _fingerprint(rows) -> pa.RecordBatch:
    change = [edited(t, f) for _, t, f in rows]
    own, new, after = [t.encode() for _, t, _ in rows], [t.encode() for t in change], [f.encode() for _, _, f in rows]
    distinct = {t: i for i, t in enumerate(dict.fromkeys(own + new + after))}
    sig = signatures(list(distinct))
    words = [bool(t.split()) for t in distinct]
    show = lambda i: sig[i].astype(">u2").tobytes().hex() if words[i] else ""
    a, b, c = ([distinct[t] for t in x] for x in (own, new, after))
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _, _ in rows], pa.int64()), pa.array([len(t) for _, t, _ in rows], pa.int64()),
         pa.array([hashlib.sha256(t).hexdigest() for t in new]), pa.array([show(i) for i in a]), pa.array([show(i) for i in b]),
         pa.array([likeness(sig[i], sig[j], words[i], words[j]) for i, j in zip(a, b)]),
         pa.array([likeness(sig[i], sig[j], words[i], words[j]) for i, j in zip(a, c)])],
        COLUMNS)
