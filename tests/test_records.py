"""Quoted records over split borders against pandas on the same files; the state machine against Python's csv reader."""

import csv
import io
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casekit.sources import delimited as DL
from casekit.sources import records as RC


def by_pandas(path, encoding="latin1", sep="$"):
    df = pd.read_csv(path, sep=sep, encoding=encoding, engine="python", on_bad_lines="skip", dtype=str)
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=str)


def by_spark(spark, path, **kw):
    return sorted(map(tuple, DL.read_delimited(spark, path, **kw).collect()), key=str)


def field(rng):
    kind = rng.randrange(12)
    if kind < 5:
        return "".join(rng.choice("abc é12") for _ in range(rng.randrange(6)))
    if kind < 9:  # quoted, with line ends, separators and doubled quotes
        return '"' + "".join(rng.choice(["a", "$", "\n", "\r\n", '""', " ", "\r", "xyz"]) for _ in range(rng.randrange(9))) + '"'
    return rng.choice(['a"b', '"a"b', '"a"b"c', 'x""', '"NA"', "NA", '""', "  "])


@pytest.mark.parametrize("seed", [0, 1, 5])
@pytest.mark.parametrize("part", ["61b", "500b"])
def test_reader_matches_pandas_over_split_borders(spark, tmp_path, seed, part):
    rng = random.Random(seed)
    rows = ["$".join([str(i), *(field(rng) for _ in range(rng.choice([2, 3, 3, 3, 4])))]) for i in range(90)]
    ends = ["\n"] if seed % 2 else ["\n", "\r\n", "\n\n", "\r"]
    text = "id$a$b$c\n" + "1$x$y$z\n" + "".join(r + rng.choice(ends) for r in rows)
    if seed == 5:
        text += '7$"left open$x\ny$z'
    (tmp_path / "f.txt").write_bytes(text.encode("latin1"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", part)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        assert by_spark(spark, str(tmp_path / "f.txt")) == by_pandas(tmp_path / "f.txt")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_field_that_spans_many_splits_and_files_kept_apart(spark, tmp_path):
    body = "\n".join(f"line {i} $ and \"\" more" for i in range(400))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text(f'id$t\n1$"{body}"\n2$b\n3$c\n6$"open\nto the end', encoding="latin1")
    (tmp_path / "d" / "b.txt").write_text('id$t\n4$c\n5$"x\ny"', encoding="latin1")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
        df = DL.read_delimited(spark, str(tmp_path / "d"))
        assert df.rdd.getNumPartitions() > 10  # splits stay parallel
        got = {r.id: r.t for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {"1": body.replace('""', '"'), "2": "b", "3": "c", "4": "c", "5": "x\ny"}


def test_steps_of_lines_match_the_csv_reader(spark):
    """A line's step: whether a record goes on after it, from outside and from inside a quoted field."""
    def goes_on(text):
        try:
            return "END" in next(csv.reader(io.StringIO(text + "\nEND", newline=""), delimiter="$"))[-1] and not failed(text)
        except csv.Error:
            return False

    def failed(text):  # an error that no further line can mend
        for tail in ("", '"', '""'):
            try:
                next(csv.reader(io.StringIO(text + tail, newline=""), delimiter="$", strict=True))
                return False
            except csv.Error as e:
                if "unexpected end" in str(e):
                    return False
        return True

    rng = random.Random(3)
    values = ['"', '""', '"""', '$"', '"$', 'a"', '"a"b"', '"a"$"'] + ["a" + "".join(rng.choice('a"$ ') for _ in range(rng.randrange(9))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", RC.step(F.col("v"), "$").alias("k"))
    for r in df.collect():
        v = values[r.i]
        assert (r.k & 1, r.k >> 1 & 1) == (int(goes_on(v)), int(goes_on('"q\n' + v))), v


def test_composed_steps():
    rng = np.random.default_rng(2)
    for _ in range(200):
        kinds = rng.integers(0, 4, rng.integers(0, 6))
        want = []
        for state in (0, 1):
            for k in kinds:
                state = int(k) >> state & 1
            want.append(state)
        assert RC.compose(kinds) == want[0] + 2 * want[1]


def test_empty_and_header_only_files(spark, tmp_path):
    (tmp_path / "h.txt").write_text("a$b\n")
    assert DL.read_delimited(spark, str(tmp_path / "h.txt")).collect() == []
    (tmp_path / "e.txt").write_text("")
    with pytest.raises(ValueError):
        DL.read_delimited(spark, str(tmp_path / "e.txt"))
