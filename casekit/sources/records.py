"""Records of delimited text whose quoted fields may hold line ends, read in parallel splits.

Whether a line end closes a record depends on everything before it in the file. Each physical line is therefore reduced to
what it does to the state (inside a quoted field or not): it keeps, swaps, or fixes it. These steps compose, so

1. every split composes the steps of its lines to one step of its own (only lines that hold a quote matter);
2. a window over the splits of a file gives each split its start state, a few bytes a split;
3. every split cuts its lines into records from its start state on. What a split border cuts through comes out as
   fragments (two a split at most), which are joined in file order.

No line is shuffled but those of fragments, and files without any quote skip steps 2 and 3. The rules are those of pandas'
Python engine with bad lines skipped (Python's ``csv`` reader, strict): a quote opens a field only at its start, two quotes
inside stand for one, quotes inside an unquoted field are plain text, lines end at ``\\n``, ``\\r\\n`` or ``\\r``, and line
ends inside quotes are kept. Text after a closing quote is an error: its record is dropped and a new one begins with the next
line. A field left open to the end of its file is dropped too.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casekit.session import ensure_checkpoint_dir

#: What a line does: bit 0 its end state from outside quotes, bit 1 from inside; bit 2 is set if it keeps the state but has quotes.
KEEP, SWAP, OUT, IN, QUOTED = 2, 1, 0, 3, 6
RECORD = "file string, block long, part int, value string, ending string, fields array<string>"
WHOLE, TAIL, MIDDLE, HEAD = 0, 1, 2, 3  # part of a record that a split holds


# ---------------------------------------------------------------- lines and their steps
def lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """``file, block, value, ending``: the physical lines of each split, in order within it."""
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.decode(F.col("value").cast("binary"), encoding) if encoding.upper() not in ("UTF-8", "UTF8") else F.col("value")
    raw = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), value.alias("v"))
    ending = F.when(F.endswith("v", F.lit("\r")), F.lit("\r\n")).otherwise(F.lit("\n"))
    body = raw.select("file", "block", F.regexp_replace("v", r"\r\z", "").alias("v"), ending.alias("ending"))
    pieces = F.split("v", "\r", -1)
    several = F.transform(pieces, lambda x, i: F.struct(x.alias("value"), F.when(i < F.size(pieces) - 1, F.lit("\r")).otherwise(F.col("ending")).alias("ending")))
    one = F.array(F.struct(F.col("v").alias("value"), F.col("ending").alias("ending")))
    return body.select("file", "block", F.inline(F.when(F.contains("v", F.lit("\r")), several).otherwise(one)))


def step(value: Column, sep: str) -> Column:
    """What a line does to the state."""
    parts = F.split(value, '"', -1)
    # states: 0 at the start of a field, 1 within one, 2 inside quotes, 3 after a closing quote, 4 error
    text = lambda s, t: F.when((s == 2) | (s == 4) | (t == ""), s).when((s == 3) & ~F.startswith(t, F.lit(sep)), 4).when(
        F.endswith(t, F.lit(sep)), 0).otherwise(1)
    quote = lambda s: F.when((s == 0) | (s == 3), 2).when(s == 2, 3).otherwise(s)
    rest = F.slice(parts, F.lit(2), F.size(parts))
    ends_in = lambda s: F.aggregate(rest, text(F.lit(s), parts[0]), lambda a, t: text(quote(a), t)) == 2
    bits = ends_in(0).cast("int") + 2 * ends_in(2).cast("int")
    return F.when(~F.contains(value, F.lit('"')), KEEP).otherwise(F.when(bits == KEEP, QUOTED).otherwise(bits))


def compose(kinds: np.ndarray) -> int:
    """One step for steps in order."""
    fixed = np.flatnonzero((kinds == OUT) | (kinds == IN))
    odd = int(np.count_nonzero(kinds[fixed[-1] + 1 if len(fixed) else 0:] == SWAP) & 1)
    if len(fixed):
        return IN if (kinds[fixed[-1]] == IN) ^ bool(odd) else OUT
    return SWAP if odd else KEEP


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """(file, block), first row and end of each run of lines of one split."""
    if not batch.num_rows:
        return
    file, block = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    code = file.indices.to_numpy()
    edge = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1
    for s, e in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows]):
        yield (file.dictionary[int(code[s])].as_py(), int(block[s])), s, e


def split_steps(marked: DataFrame) -> DataFrame:
    """``file, block, kind``: the composed step of each split that has quotes."""
    def run(batches):
        key, kind = None, KEEP
        for batch in batches:
            kinds = batch.column(2).to_numpy()
            for new, s, e in _runs(batch):
                if new != key:
                    if key is not None:
                        yield _one_step(key, kind)
                    key, kind = new, KEEP
                kind = compose(np.append(kind, kinds[s:e]))
        if key is not None:
            yield _one_step(key, kind)

    return marked.where(F.col("kind") != KEEP).select("file", "block", "kind").mapInArrow(run, "file string, block long, kind int")


def _one_step(key: tuple[str, int], kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([kind], pa.int32())], ["file", "block", "kind"])


def split_states(blocks: DataFrame, steps: DataFrame) -> DataFrame:
    """``file, block, starts_in, ends_in`` of each split: the steps before it, from outside quotes at the file's start."""
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.coalesce("kind", F.lit(KEEP))
    swaps = F.sum((kind == SWAP).cast("int")).over(w)
    fixed = F.last(F.when(kind.isin(OUT, IN), F.struct((kind == IN).cast("int").alias("state"), F.col("swaps").alias("swaps"))), True).over(w)
    both = blocks.join(steps, ["file", "block"], "left").withColumn("swaps", swaps).withColumn("fixed", fixed)
    ends = (F.coalesce("fixed.state", F.lit(0)) + F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0))) % 2 == 1
    before = F.coalesce(F.lag("ends_in").over(Window.partitionBy("file").orderBy("block")), F.lit(False))
    return both.select("file", "block", ends.alias("ends_in")).withColumn("starts_in", before)


# ---------------------------------------------------------------- records
def parse(values: list[str], sep: str) -> list[list[str]]:
    """Fields of whole records, without those that are in error."""
    csv.field_size_limit(sys.maxsize)
    out = []
    for v in values:
        try:
            out.append(next(csv.reader(io.StringIO(v, newline=""), delimiter=sep, strict=True)))
        except csv.Error:
            pass
    return out


class Cutter:
    """Cuts the lines of one split after the other into records."""

    def __init__(self, sep: str, fragments: bool):
        self.sep, self.fragments = sep, fragments
        self.key, self.open, self.head, self.lines, self.endings = None, False, False, [], []

    def begin(self, key, starts_in: bool) -> None:
        self.key, self.open, self.head, self.lines, self.endings = key, starts_in, starts_in, [], []

    def close(self) -> list[tuple]:
        """The fragment with which the split ends."""
        if not self.open or not self.lines:
            return []
        return self._fragment(MIDDLE if self.head else TAIL)

    def _fragment(self, part: int) -> list[tuple]:
        text = "".join(x for pair in zip(self.lines, [*self.endings[:-1], ""]) for x in pair)
        return [(part, text, self.endings[-1])] if self.fragments else []

    def add(self, kinds: np.ndarray, values: list[str], endings: list[str]) -> tuple[list[str], list[tuple]]:
        """Whole records with quotes or line ends, and fragments, of some lines in order that may change the state."""
        whole, parts = [], []
        for kind, value, ending in zip(kinds.tolist(), values, endings):
            self.lines.append(value)
            self.endings.append(ending)
            self.open = bool(kind >> self.open & 1)
            if not self.open:
                if self.head:
                    parts += self._fragment(HEAD)
                elif not self.fragments:
                    whole.append("".join(x for pair in zip(self.lines, [*self.endings[:-1], ""]) for x in pair))
                self.head, self.lines, self.endings = False, [], []
        return whole, parts


def _first(flags: np.ndarray) -> int:
    """Where the first true one stands (behind the end: none)."""
    return int(np.argmax(flags)) if flags.any() else len(flags)


def cut_records(marked: DataFrame, sep: str, fragments: bool) -> DataFrame:
    """``RECORD`` rows: whole records (lines without quotes as they are, others as fields), or the fragments alone."""
    def run(batches):
        cutter = Cutter(sep, fragments)
        for batch in batches:
            kinds = batch.column(2).to_numpy()
            plain = []  # rows that are records as they stand
            for key, s, e in _runs(batch):
                if key != cutter.key:
                    yield from _out(cutter.key, [], cutter.close())
                    cutter.begin(key, batch.column(5)[s].as_py())
                while s < e:
                    if cutter.open:  # up to the line that can close the field
                        stop = min(e, s + 1 + _first((kinds[s:e] == OUT) | (kinds[s:e] == SWAP)))
                    elif (stop := s + _first(kinds[s:e] != KEEP)) > s:
                        plain.append((s, stop))
                        s = stop
                        continue
                    else:
                        stop = s + _first(kinds[s:e] == KEEP)
                    whole, parts = cutter.add(kinds[s:stop], batch.column(3).slice(s, stop - s).to_pylist(), batch.column(4).slice(s, stop - s).to_pylist())
                    yield from _out(key, parse(whole, sep), parts)
                    s = stop
            if plain and not fragments:
                at = pa.array(np.concatenate([np.arange(s, e) for s, e in plain]))
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int32)), batch.column(3).take(at),
                                                  pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.string()))], [f.split()[0] for f in RECORD.split(", ")])
        yield from _out(cutter.key, [], cutter.close())

    return marked.select("file", "block", "kind", "value", "ending", "starts_in").mapInArrow(run, RECORD)


def _out(key, fields: list[list[str]], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    if fields or parts:
        n, m = len(fields), len(parts)
        part, value, ending = zip(*parts) if parts else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * (n + m), pa.string()), pa.array([key[1]] * (n + m), pa.int64()), pa.array([WHOLE] * n + list(part), pa.int32()),
             pa.array([None] * n + list(value), pa.string()), pa.array([None] * n + list(ending), pa.string()),
             pa.array(fields + [None] * m, pa.list_(pa.string()))], [f.split()[0] for f in RECORD.split(", ")])


def joined(fragments: DataFrame, sep: str) -> DataFrame:
    """``fields`` of the records that split borders cut: a tail, whole splits inside quotes, and a head."""
    order = Window.partitionBy("file").orderBy("block", F.col("part") != HEAD).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    piece = F.struct("block", "value", "ending")
    whole = fragments.withColumn("n", F.sum((F.col("part") == TAIL).cast("int")).over(order)).groupBy("file", "n").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    last = F.element_at("p", -1)
    text = F.concat(F.array_join(F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda x: F.concat(x["value"], x["ending"])), ""), last["value"])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(parse(batch.column(0).to_pylist(), sep), pa.list_(pa.string()))], ["fields"])

    return whole.select(text.alias("value")).mapInArrow(run, "fields array<string>")


def read_fields(spark: SparkSession, path: str, sep: str = "$", encoding: str = "ISO-8859-1") -> DataFrame:
    """``fields``: one row for each record of the files under ``path`` (headers too); blank records are left out."""
    all_lines = lines(spark, path, encoding)
    native = F.split("value", f"\\Q{sep}\\E", -1)
    quoted = F.max(F.contains("value", F.lit('"'))).alias("quoted")
    ensure_checkpoint_dir(spark)
    blocks = all_lines.groupBy("file", "block").agg(quoted).checkpoint()  # a row for each split
    if not blocks.agg(F.max("quoted")).first()[0]:
        return _without_blanks(all_lines.select(native.alias("fields")))
    marked = all_lines.withColumn("kind", step(F.col("value"), sep))
    states = split_states(blocks.select("file", "block"), split_steps(marked)).checkpoint()
    inside = states.where("starts_in").select("file", "block", "starts_in")
    placed = marked.join(F.broadcast(inside), ["file", "block"], "left").withColumn("starts_in", F.coalesce("starts_in", F.lit(False)))  # a row for a split at most
    got = cut_records(placed, sep, False).select(F.coalesce("fields", native).alias("fields"))
    if states.where("starts_in OR ends_in").limit(1).count():
        got = got.union(joined(cut_records(placed, sep, True).select("file", "block", "part", "value", "ending"), sep))
    return _without_blanks(got)


def _without_blanks(df: DataFrame) -> DataFrame:
    return df.where(~((F.size("fields") == 1) & F.col("fields")[0].rlike(r"(?U)^\s*$")))
