"""Operator 9: n-gram Jaccard join with PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Documents with equal sets form a class;
the join runs on classes. Sets whose Jaccard similarity is 0.8 or more differ in at most a quarter of the smaller
set's size k' = size / 4 elements, and their sizes lie in the same or neighbouring bands (factor 5/4). For each band
the domain is cut by hash into groups of two partitions, with more than k'/2 groups; as some group then holds one
difference at most, one of its two partitions agrees. A signature is the hash of one such partition's content, so
similar sets share one. Partitions that are empty for a set are left out as long as the groups without an empty
partition are themselves more than k'/2 (then the argument holds for those alone); otherwise they are emitted too.

Sets that share a signature form a run. All pairs of a run are compared in blocks inside tasks, first by parity
sketches (bit maps whose distance never exceeds the true number of differences, so nothing similar is lost). A run
emits a spanning forest of the pairs that may be similar, never all of them; those pairs are verified on the full
sets and joined into components. Runs that then still hold members of different components which may be similar are
compared once more in blocks, exactly, on the full sets; each block emits a spanning forest of real links only. So
no link between different components is lost, output stays linear in the members, and a hot run is split into
blocks of ``BLOCK`` members over many tasks.

Null, empty and word-less texts have an empty set and link with nothing; a text of one to four words has one shingle,
the whole sequence; repeated rows each give a row, in the same class; rows without doc_id link with nothing
(component null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.llm.common import LOWER, U64, cut, held, mix, raw, slices, small, word_hashes
from casekit.llm.components import components

WORDS, LEAST = 5, 4  # shingle length; sets below 4 shingles are similar only if equal
SPARE = 1.1  # partitions for each one that the argument needs, so that empty ones can be left out
BLOCK, BLOCK_BYTES = 4096, 64_000_000  # members, and bytes of sketches or sets, of a block
TILE = 1024
OPEN = 2_000_000  # a run longer than this is passed on without being held


def _bands(most: int = 1 << 40) -> np.ndarray:
    out = [LEAST]
    while out[-1] < most:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array(out)


BANDS = _bands()


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, n = word_hashes([t.translate(LOWER) for t in texts])
    rolled = words
    if len(words) >= WORDS:
        rolled = words[:-WORDS + 1]
        for j in range(1, WORDS):
            rolled = mix(rolled * U64(31) + U64(j)) + words[j:len(words) - WORDS + 1 + j]
        rolled = mix(rolled)
    out, at = [], 0
    for k in n.tolist():
        if k >= WORDS:
            out.append(np.unique(rolled[at:at + k - WORDS + 1]))
        elif k:
            whole = words[at:at + 1]
            for w in words[at + 1:at + k]:
                whole = mix(whole * U64(31)) + w
            out.append(mix(whole + U64(k)))
        else:
            out.append(np.zeros(0, U64))
        at += k
    return out


def class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(s: np.ndarray) -> bytes:
    """Parity bit map: bit i tells whether an odd number of elements falls into it."""
    bits = max(64, 1 << int(len(s) - 1).bit_length())
    odd = np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def signatures(s: np.ndarray) -> np.ndarray:
    """Signatures of one set under its own band and the band below."""
    if len(s) < LEAST:
        return np.zeros(0, U64)
    own, out = int(np.searchsorted(BANDS, len(s), side="right")) - 1, []
    for band in (own, own - 1):
        if band < 0:
            continue
        apart = (int(BANDS[band + 1]) - 1) // 4  # most differences of a similar pair whose smaller set is in this band
        groups = int(SPARE * (apart // 2 + 1)) + 2
        part = (((s >> U64(32)) * U64(2 * groups)) >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        at, total = part[first], np.add.reduceat(mix(s), first)
        whole = int((np.bincount(at // 2, minlength=groups) == 2).sum())
        if 2 * whole <= apart:  # too few groups without an empty partition
            empty = np.setdiff1d(np.arange(2 * groups), at)
            at, total = np.r_[at, empty], np.r_[total, np.zeros(len(empty), U64)]
        out.append(mix(total + mix(at.astype(U64) + U64(1)) + U64(band * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)))
    return np.concatenate(out)


def _profile(batches):
    held(None, lambda: None)  # frees what other operators keep in this worker
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(raw(part, "text"))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()),
                 pa.array([sketch(s) if len(s) >= LEAST else b"" for s in sets], pa.binary())], ["doc_id", "n", "cls", "sketch"])


def _signature_rows(batches):
    held(None, lambda: None)
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, "text"):
            sig, cls = [], []
            for s in shingle_sets(raw(part, "text")):
                c = class_of(s)
                if c not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(c)
                    sig.append(signatures(s))
                    cls.append(np.full(len(sig[-1]), c))
            if sig and sum(map(len, sig)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(cls))], ["sig", "cls"])


def _full_sets(batches):
    held(None, lambda: None)  # frees what other operators keep in this worker
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(raw(part, "text"))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "elements"])


def _runs(batches):
    """Rows sorted by (sig, cls) -> (run, cls) of signatures with two or more classes; equal member lists get equal ids."""
    held_s, held_c, opened, before = np.zeros(0, np.int64), np.zeros(0, np.int64), None, set()

    def emit(sig, cls):
        if not len(sig):
            return None
        keep = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])]
        sig, cls = sig[keep], cls[keep]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        length = np.diff(np.r_[first, len(sig)])
        run = mix(np.add.reduceat(mix(cls.view(U64)), first) + length.astype(U64)).view(np.int64)
        use = length > 1
        if opened is not None:  # the first run goes on from rows that were passed on already
            run[sig[first] == opened] = opened
            use |= sig[first] == opened
        fresh = np.zeros(len(first), bool)
        for i in np.flatnonzero(use):
            r = int(run[i])
            if r not in before or r == opened:
                fresh[i] = True
                if len(before) > 500_000:
                    before.clear()
                before.add(r)
        rows = np.repeat(fresh, length)
        if not rows.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(run, length)[rows]), pa.array(cls[rows])], ["run", "cls"])

    for batch in batches:
        sig = np.r_[held_s, batch.column(0).to_numpy()]
        cls = np.r_[held_c, batch.column(1).to_numpy()]
        last = int(np.searchsorted(sig, sig[-1], side="left")) if len(sig) else 0
        out = emit(sig[:last], cls[:last])
        if out is not None:
            yield out
        held_s, held_c = sig[last:], cls[last:]
        if len(held_s) > OPEN:
            opened = int(held_s[0])
            out = emit(held_s, held_c)
            if out is not None:
                yield out
            held_s, held_c = held_s[:0], held_c[:0]
    out = emit(held_s, held_c)
    if out is not None:
        yield out


def _in_blocks(rows: DataFrame, weight) -> DataFrame:
    """Deals the members of each run out to pairs of blocks: columns ``run, x, y`` name the block pair. ``weight``:
    bytes of a member."""
    size = rows.groupBy("run").agg(F.count(F.lit(1)).alias("members"), F.sum(weight).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    own = F.pmod(F.hash("cls"), blocks)
    dealt = rows.join(size, "run").withColumn("own", own).withColumn(
        "other", F.explode(F.when(blocks == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))))
    keep = [c for c in rows.columns if c != "run"]
    return (dealt.select("run", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), *keep)
            .repartition("run", "x", "y").sortWithinPartitions("run", "x", "y", "cls"))


def _groups(batches):
    """Tables of consecutive rows with equal (run, x, y)."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        key = np.stack([t.column(c).to_numpy() for c in ("run", "x", "y")])
        if not t.num_rows:
            continue
        edge = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, t.num_rows]
        for a, b in zip(edge[:-2], edge[1:-1]):
            yield t.slice(a, b - a)
        held = t.slice(edge[-2])
    if held is not None and held.num_rows:
        yield held


def _may_link(sketches: list[bytes], n: np.ndarray) -> np.ndarray:
    """Pairs that the sketches don't rule out: parity distance at most (|A| + |B|) / 9."""
    width = min(map(len, sketches))
    rows = []
    for s in sketches:
        v = np.frombuffer(s, np.uint8)
        while len(v) > width:
            v = v[:len(v) // 2] ^ v[len(v) // 2:]
        rows.append(v)
    if len(rows) == 2:
        ok = 9 * int(np.unpackbits(rows[0] ^ rows[1]).sum()) <= n[0] + n[1]
        return np.array([[False, ok], [ok, False]])
    bits, ok = np.stack(rows), np.zeros((len(rows), len(rows)), bool)
    kind = np.float32 if width < 100_000 else np.float64  # all values are multiples of a half, exact either way
    for i in range(0, len(rows), TILE):  # tiles of rows and of bits, so that a full block takes tens of MB
        alike = np.zeros((len(rows[i:i + TILE]), len(rows)), kind)
        for k in range(0, width, TILE // 8):
            x = np.unpackbits(bits[:, k:k + TILE // 8], axis=1).astype(np.float32)
            x *= 2
            x -= 1
            alike += x[i:i + TILE] @ x.T
        alike *= -4.5
        alike += (36 * width - n[i:i + TILE, None]).astype(kind)
        ok[i:i + TILE] = alike <= n[None, :].astype(kind)
    np.fill_diagonal(ok, False)
    return ok


def _forest(near) -> list[tuple[int, int]]:
    """Spanning forest of a symmetric boolean matrix, breadth-first from the members with most neighbours."""
    todo, out = np.ones(len(near), bool), []
    for root in np.argsort(-near.sum(axis=1), kind="stable"):
        if not todo[root]:
            continue
        todo[root], queue = False, [root]
        for u in queue:
            new = np.flatnonzero(near[u] & todo)
            todo[new] = False
            queue += new.tolist()
            out += [(int(u), int(v)) for v in new]
    return out


def _pairs_batch(pairs) -> pa.RecordBatch:
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _maybe_pairs(batches):
    out = []
    for t in _groups(batches):
        if t.num_rows > 1:
            cls = t.column("cls").to_numpy()
            near = _may_link(t.column("sketch").to_pylist(), t.column("n").to_numpy())
            out += [(cls[i], cls[j]) for i, j in _forest(near)]
        if len(out) > 50_000:
            yield _pairs_batch(out)
            out = []
    if out:
        yield _pairs_batch(out)


def _open_members(batches):
    """(run, cls) of members that may be similar to one of another component.

    Members that such pairs connect form a run of their own, named by its members, so a pair that met under many
    signatures comes once.
    """
    before: set[int] = set()
    for t in _groups(batches):
        comp = t.column("comp").to_numpy()
        if len(set(comp)) < 2:
            continue
        near = _may_link(t.column("sketch").to_pylist(), t.column("n").to_numpy()) & (comp[:, None] != comp[None, :])
        group = {}
        for u, v in _forest(near):
            group[v] = group[u] = group.get(u, u)
        cls, parts = t.column("cls").to_numpy(), {}
        for i, g in group.items():
            parts.setdefault(g, []).append(i)
        for at in parts.values():
            own = np.sort(cls[at])
            run = int((mix(own.view(U64)).sum() + U64(len(own))).astype(np.int64))
            if run not in before:
                if len(before) > 500_000:
                    before.clear()
                before.add(run)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), run)), pa.array(own)], ["run", "cls"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The join's condition on two sorted sets."""
    if 100 * min(len(a), len(b)) < 80 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= 80 * (len(a) + len(b) - same)


def _verify(batches):
    for batch in batches:
        a, b = batch.column("ea").to_pylist(), batch.column("eb").to_pylist()
        ok = [linked(np.frombuffer(x, U64), np.frombuffer(y, U64)) for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _exact_pairs(batches):
    """Spanning forest of the real links between members of different components, block by block."""
    for t in _groups(batches):
        cls, label = t.column("cls").to_pylist(), t.column("comp").to_pylist()
        sets = [np.frombuffer(x, U64) for x in t.column("elements").to_pylist()]
        near = _may_link(t.column("sketch").to_pylist(), t.column("n").to_numpy())
        out = []
        for i, j in zip(*np.nonzero(np.triu(near))):
            if label[i] != label[j] and linked(sets[i], sets[j]):
                out.append((cls[i], cls[j]))
                old, new = label[j], label[i]
                label = [new if v == old else v for v in label]
        if out:
            yield _pairs_batch(out)


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` for every row of ``docs``."""
    return _joined(docs).drop("component")


def _joined(docs: DataFrame) -> DataFrame:
    """``join`` with the ``component`` itself (null: in none); components whose least doc_id has several texts may share it."""
    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = need.where("doc_id IS NOT NULL")
    rows = cut(need.mapInArrow(_profile, "doc_id long, n long, cls long, sketch binary"))
    classes = rows.where(f"doc_id IS NOT NULL AND n >= {LEAST}").groupBy("cls").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"))

    signed = known.mapInArrow(_signature_rows, "sig long, cls long")
    runs = cut(signed.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(_runs, "run long, cls long").distinct())
    shown = classes.select("cls", "n", "sketch")
    maybe = cut(_in_blocks(runs.join(shown, "cls"), F.length("sketch")).mapInArrow(_maybe_pairs, "a long, b long").distinct())

    involved = maybe.select(F.col("a").alias("cls")).union(maybe.select("b")).distinct()
    wanted = cut(classes.select("cls", "doc_id").join(involved, "cls", "left_semi"))
    texts = known.join(small(wanted.select("doc_id").distinct(), 1_000_000), "doc_id", "left_semi")
    sets = cut(texts.mapInArrow(_full_sets, "cls long, elements binary").join(wanted.select("cls"), "cls", "left_semi")
               .dropDuplicates(["cls"]))
    links = cut(maybe.join(sets.select(F.col("cls").alias("a"), F.col("elements").alias("ea")), "a")
                .join(sets.select(F.col("cls").alias("b"), F.col("elements").alias("eb")), "b")
                .select("a", "b", "ea", "eb").mapInArrow(_verify, "a long, b long"))
    label = cut(components(links))

    # What may still be missing: links between members of different components in one run.
    comp = wanted.select("cls").join(label, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("component", "cls").alias("comp"))
    comp = cut(comp)
    left = runs.join(comp, "cls")
    mixed = left.groupBy("run").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("run")
    left = left.join(mixed, "run", "left_semi").join(shown, "cls")
    unsure = cut(_in_blocks(left, F.length("sketch")).mapInArrow(_open_members, "run long, cls long").distinct())
    more = (unsure.join(comp, "cls").join(shown, "cls").join(sets, "cls"))
    more = cut(_in_blocks(more, 8 * F.col("n")).mapInArrow(_exact_pairs, "a long, b long"))
    joined = components(links.union(more)) if more.limit(1).count() else label

    of_class = rows.where("doc_id IS NOT NULL AND n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    of_class = of_class.join(joined, of_class.cls == joined.node, "left").select(
        of_class.cls, "least", F.coalesce("component", "cls").alias("component"))
    lowest = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_class.join(lowest, "component").select("cls", "component_id", "component")
    return rows.select("doc_id", "n", "cls").join(named, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("cls").alias("class_id"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).alias("component"))


def _with_class(docs: DataFrame, n: str, cls: str) -> DataFrame:
    """``docs`` with the number of shingles and the class of each row's text, worked out anew in one map."""
    def run(batches):
        held(None, lambda: None)  # frees what other operators keep in this worker
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(raw(part, "text"))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64())],
                    [*part.schema.names, n, cls])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(n, T.LongType()), T.StructField(cls, T.LongType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay: of each component one row, of the smallest doc_id and, where that has several texts in
    the component, of the smallest class. Empty documents and rows without doc_id are in no group and all stay.

    Where a doc_id has a single class its rows go or stay by doc_id alone; only rows of a doc_id with several different
    texts (empty ones among them) are decided by (doc_id, class).
    """
    got = cut(_joined(docs))
    grouped = got.where("component IS NOT NULL")
    several = cut(got.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.count(F.lit(1)).alias("rows"),
                                                                         F.max("n_shingles").alias("n")).where("rows > 1"))
    mixed, twice = several.where("lo < hi").select("doc_id"), several.where("lo = hi AND n > 0").select("doc_id")
    chosen = grouped.where("doc_id = component_id").groupBy("component").agg(F.min("class_id").alias("chosen"))
    gone = grouped.where("doc_id <> component_id").select("doc_id", "class_id")
    if several.limit(1).count():
        other = grouped.where("doc_id = component_id").join(chosen, "component").where("class_id <> chosen").select("doc_id", "class_id")
        gone = gone.union(other)
    gone = cut(gone.distinct())
    if not several.limit(1).count():
        return docs.join(small(gone.select("doc_id"), 1_000_000), "doc_id", "left_anti").select(*docs.columns)
    mixed, twice, columns = small(cut(mixed), 1_000_000), small(cut(twice), 1_000_000), docs.columns
    plain = docs.join(mixed, "doc_id", "left_anti").join(small(cut(gone.join(mixed, "doc_id", "left_anti").select("doc_id")), 1_000_000), "doc_id", "left_anti")
    once = plain.join(twice, "doc_id", "left_semi").select(*columns).dropDuplicates(["doc_id"])
    out = plain.join(twice, "doc_id", "left_anti").select(*columns).union(once)
    if not mixed.limit(1).count():
        return out
    n, cls = (next(x for x in (f"{name}{'_' * k}" for k in range(len(columns) + 1)) if x not in columns) for name in ("n_of_row", "class_of_row"))
    rows = _with_class(docs.join(mixed, "doc_id", "left_semi").select(*columns), n, cls)
    here = small(cut(gone.join(mixed, "doc_id", "left_semi").select("doc_id", F.col("class_id").alias(cls))), 1_000_000)
    rows = rows.where(F.col(n) == 0).union(rows.where(F.col(n) > 0).join(here, ["doc_id", cls], "left_anti").select(*rows.columns)
                                          .dropDuplicates(["doc_id", cls]))
    return out.union(rows.select(*columns))
