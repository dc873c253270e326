"""Operator 12: links between the tokens of two tokenizers over the same text, by whitespace-token anchors.

A text is tokenised whole by both tokenizers: A gets space+text, B gets the text and adds the space itself. Their bytes
must both spell space+text, so a place is the same byte offset in either. Where both have a token end, one group of A and
B tokens ends. An anchor is such a shared end before a token that starts with a space in A and in B; anchors split a
document into windows, mostly single words. The alignment of a window (its groups as text, the id pairs that they link)
depends on its token ids alone and is worked out once for each tuple of ids, then remembered.

Counts over the corpus (in how many documents a pair of ids is linked) are Spark aggregates over the distinct pairs of
each document; pairs meet their counts by a join that broadcasts the counts only up to ``BROADCAST_PAIRS`` rows, and
otherwise shuffles, with frequent pairs salted.

Every row is a document of its own (repeated ids too). Null and empty texts, and texts that a tokenizer does not spell
byte for byte, have no tokens: zeros and an empty string. The strings of special tokens inside texts are plain text. Long
texts are whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casekit.llm.bpe import PATTERN, byte_letters
from casekit.llm.common import INVERSE, ODD, cut, held, mix, powers, slices, stored, texts

KEEP_WINDOWS = 150_000  # alignments remembered by a worker; bounds memory only
SLICE = 2_000_000  # text bytes tokenised at once
BROADCAST_PAIRS = 2_000_000  # rows of counts (about 100 MB in memory)
SALTS = 64
LONG_GROUP = 64  # links of a group up to which each is written out before counting
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


class TokenizerA:
    """A byte-level tokenizer file: ids and the bytes of each id.

    If the merges are numbered like the tokens that they make, tokens are merged by rank alone. That gives the same ids as
    long as every token's own bytes encode to it (two neighbours that spell a token are then always its listed merge; the
    tests check it for the file used).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        entries = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes = [b""] * (1 + max([*entries.values(), *special.values()]))
        for name, i in entries.items():
            self.bytes[i] = name.encode() if name in special else bytes(letters[c] for c in name)
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.ranked = all(entries[m] == 256 + i for i, m in enumerate(merges))
        if self.ranked:
            ranks = {self.bytes[i]: i for i in range(256 + len(merges))}
            self.encoder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            self.encoder = Tokenizer.from_file(path)
            self.encoder.encode_special_tokens = True
            self.encoder.no_truncation()
            self.encoder.no_padding()

    def encode(self, docs: list[str]) -> list[np.ndarray]:
        if self.ranked:
            return [self.encoder.encode_to_numpy(" " + t, disallowed_special=()) for t in docs]
        return [np.array(self.encoder.encode(" " + t, add_special_tokens=False).ids, np.int64) for t in docs]


class TokenizerB:
    """A piece model: ids and the bytes of each id."""

    def __init__(self, path: str):
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.encoder.get_piece_size()):
            piece = self.encoder.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.encoder.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, docs: list[str]) -> list[list[int]]:
        return self.encoder.encode(docs, num_threads=1)


class Side:
    """The tokens of some texts, one behind the other."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, space: np.ndarray):
        self.ids, self.end = ids, np.cumsum(sizes[ids])
        self.before_space = np.append(space[ids][1:], True)  # the next token (or text) starts with a space

    def marks(self, tokens=slice(None)) -> np.ndarray:
        """Whether one of the tokens ends at a byte."""
        out = np.zeros(self.end[-1] + 1, bool)
        out[self.end[tokens]] = True
        return out

    def spans(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First token and end of each span that ends at a marked byte."""
        ends = np.flatnonzero(places[self.end]) + 1
        return np.append(0, ends[:-1]), ends


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all elements of the spans, one span behind the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their times."""
    if not len(key):
        return key, times
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[start], np.add.reduceat(times[order], start)


class Windows:
    """Alignments of windows, remembered by their id tuples: groups as text, number of groups, linked pairs."""

    def __init__(self, a: TokenizerA, b: TokenizerB):
        self.tokenizers = a, b
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (a, b)]
        self.space = [np.array([x[:1] == b" " for x in t.bytes]) for t in (a, b)]
        self.salt = [mix(np.arange(len(t.bytes), dtype=np.uint64) + np.uint64((i + 1) << 40)) for i, t in enumerate((a, b))]
        # an id with the mark that follows it: "," within a side of a group, "|" between the sides, ";" between groups
        self.shown = pa.array([f"{i}{m}" for t, marks in ((a, ",|"), (b, ",;")) for m in marks for i in range(len(t.bytes))])
        self.wide = len(a.bytes) * len(b.bytes)
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.text: list[bytes] = []
        self.groups, self.first, self.count, self.pairs, self.times = (np.zeros(0, np.int64) for _ in range(5))

    def sides(self, ids: list[np.ndarray]) -> list[Side]:
        return [Side(*x) for x in zip(ids, self.sizes, self.space)]

    def align(self, docs: list[str]) -> list[pa.Array]:
        """Columns of ``ALIGNED`` after doc_id: one value for each text."""
        (a, b), n = (t.encode(docs) for t in self.tokenizers), len(docs)
        spell = self.tokenizers[1].bytes.__getitem__
        for d, text in enumerate(docs):  # A keeps every byte
            if not text or b"".join(map(spell, b[d])) != b" " + text.encode():
                a[d], b[d] = a[d][:0], []
        n_a, n_b = (np.array([len(x) for x in t], np.int64) for t in (a, b))
        ids = [np.concatenate(a).astype(np.int64), np.fromiter(chain.from_iterable(b), np.int64, int(n_b.sum()))]
        if n_a.any():
            sides = self.sides(ids)
            anchors = np.logical_and(*(s.marks(s.before_space) for s in sides))
            windows = [s.spans(anchors) for s in sides]
            number, doc = self._numbers(ids, windows), np.repeat(np.arange(n), n_a)[windows[0][0]]
        else:
            number = doc = np.zeros(0, np.int64)
        text, edges = list(map(self.text.__getitem__, number.tolist())), np.searchsorted(doc, np.arange(n + 1)).tolist()
        digests = [hashlib.sha256(b";".join(text[s:e])).hexdigest() if e > s else "" for s, e in zip(edges, edges[1:])]
        groups = np.bincount(doc, self.groups[number], minlength=n).astype(np.int64)
        count = self.count[number]
        at = ragged(self.first[number], count)
        key, times = summed(np.repeat(doc, count) * self.wide + self.pairs[at], self.times[at])
        links, ends = np.zeros(n, np.int64), pa.array(np.searchsorted(key, np.arange(n + 1) * self.wide), pa.int32())
        np.add.at(links, key // self.wide, times)
        return [pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(links), pa.array(digests, pa.string()),
                pa.ListArray.from_arrays(ends, pa.array(key % self.wide)), pa.ListArray.from_arrays(ends, pa.array(times))]

    def _numbers(self, ids: list[np.ndarray], windows: list) -> np.ndarray:
        """The number of each window. Equal windows are found by hash (and compared), so a tuple of ids is looked up once."""
        h = np.zeros(len(windows[0][0]), np.uint64)
        for side, salt, (first, end) in zip(ids, self.salt, windows):
            total = np.append(np.uint64(0), np.cumsum(salt[side] * powers(ODD, len(side))))
            h = mix(h + (total[end] - total[first]) * powers(INVERSE, len(side) + 1)[first])
        order = np.argsort(h)
        new = np.append(True, h[order][1:] != h[order][:-1])
        model = np.empty(len(h), np.int64)
        model[order] = order[new][np.cumsum(new) - 1]
        same = np.ones(len(h), bool)
        for side, (first, end) in zip(ids, windows):
            size = end - first
            same &= size == size[model]
            n = np.where(same, size, 0)
            differ = side[ragged(first, n)] != side[ragged(first[model], n)]
            same[np.repeat(np.arange(len(h)), n)[differ]] = False
        model[~same] = np.flatnonzero(~same)
        some, back = np.unique(model, return_inverse=True)
        if len(self.number) > KEEP_WINDOWS:
            self.forget()
        data = [side.astype(np.int32).tobytes() for side in ids]
        spans = [(4 * v[some]).tolist() for span in windows for v in span]
        keys = [data[0][f:e] + b"|" + data[1][g:h] for f, e, g, h in zip(*spans)]
        found = list(map(self.number.get, keys))
        unknown = [i for i, v in enumerate(found) if v is None]
        if unknown:
            start, at = len(self.text), some[unknown]
            self._learn([side[ragged(f[at], (e - f)[at])] for side, (f, e) in zip(ids, windows)], [np.cumsum((e - f)[at]) for f, e in windows])
            for k, i in enumerate(unknown):
                found[i] = self.number[keys[i]] = start + k
        return np.array(found, np.int64)[back]

    def _learn(self, ids: list[np.ndarray], ends: list[np.ndarray]) -> None:
        """Align windows, one behind the other (``ends``: where each one ends), and add them to the table."""
        sides, n = self.sides(ids), len(ends[0])
        shared = np.logical_and(*(s.marks() for s in sides))
        (first_a, end_a), (first_b, end_b) = (s.spans(shared) for s in sides)
        window = np.searchsorted(ends[0], end_a)  # of each group
        size_a, size_b = end_a - first_a, end_b - first_b
        # the text of all groups: tokens in the order of groups and sides, each with the mark that follows it
        n_a, n_b = (len(t.bytes) for t in self.tokenizers)
        shown = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        last = np.zeros(len(ids[0]), bool), np.zeros(len(ids[1]), bool)
        last[0][end_a - 1], last[1][end_b - 1] = True, True
        shown[np.arange(len(ids[0])) + np.repeat(first_b, size_a)] = ids[0] + n_a * last[0]
        shown[np.arange(len(ids[1])) + np.repeat(end_a, size_b)] = 2 * n_a + ids[1] + n_b * last[1]
        text = self.shown.take(pa.array(shown))
        offsets, data = np.frombuffer(text.buffers()[1], np.int32), text.buffers()[2].to_pybytes()
        cuts = offsets[np.append(0, ends[0] + ends[1])].tolist()
        self.text += [data[s:e - 1] for s, e in zip(cuts, cuts[1:])]
        # pairs: each link of short groups; distinct ids of each side of long ones, so that they cost no more than their distinct pairs
        few = size_a * size_b <= LONG_GROUP
        m = (size_a * size_b)[few]
        at, k = np.repeat(np.flatnonzero(few), m), ragged(np.zeros(len(m), np.int64), m)
        key = window[at] * self.wide + ids[0][first_a[at] + k // size_b[at]] * n_b + ids[1][first_b[at] + k % size_b[at]]
        keys, times = [key], [np.ones(len(key), np.int64)]
        for g in np.flatnonzero(~few).tolist():
            (u, x), (v, y) = (np.unique(i[f[g]:e[g]], return_counts=True) for i, f, e in zip(ids, (first_a, first_b), (end_a, end_b)))
            keys.append((window[g] * self.wide + (u * n_b)[:, None] + v).ravel())
            times.append((x[:, None] * y).ravel())
        key, times = summed(np.concatenate(keys), np.concatenate(times))
        place = np.searchsorted(key, np.arange(n + 1) * self.wide)
        old = len(self.pairs)
        for name, more in (("groups", np.bincount(window, minlength=n)), ("first", old + place[:-1]), ("count", np.diff(place)),
                           ("pairs", key % self.wide), ("times", times)):
            setattr(self, name, np.append(getattr(self, name), more))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``ALIGNED`` for every row of ``docs``: ``pairs`` holds the distinct linked id pairs (A id * number of B ids + B id),
    ``times`` the number of links of each."""
    def run(batches):
        w = held(("align", path_a, path_b), lambda: Windows(TokenizerA(path_a), TokenizerB(path_b)))
        names = [f.split()[0] for f in ALIGNED.split(", ")]
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), *w.align(texts(part, "text"))], names)

    needed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return needed.mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """``pair, n, best``: in how many documents a pair is linked, and whether no pair of its A id is linked in more."""
    counts = cut(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.floor(F.col("pair") / n_b).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score(rows: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``row, n_best, count_sum`` of the documents that have links (``row`` numbers the rows of ``rows``)."""
    each = rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    if counts.count() <= broadcast_pairs:
        joined = each.join(F.broadcast(counts), "pair")
    else:  # frequent pairs are dealt over SALTS tasks
        often = F.broadcast(counts.orderBy(F.desc("n")).limit(1000).select("pair", F.lit(SALTS).alias("salts")))
        salted = lambda df, salt: df.join(often, "pair", "left").withColumn("salt", F.explode(salt) if salt is not None else F.when(
            F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))).drop("salts")
        copies = F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        joined = salted(each, None).join(salted(counts, copies), ["pair", "salt"])
    return joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                     F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def links(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``."""
    rows = stored(align(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "alignment")
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    scored = score(rows, cut(pair_counts(rows, n_b)), broadcast_pairs)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(scored, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
