"""Sample and split by counted hash cells: the same rows as a full sort by hash, also with repeated ids and rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from casekit.operators import sampling as S


def frame(spark, kind):
    n = {"unique": 700, "repeats": 400, "equal": 300}[kind]
    key = {"unique": F.col("id"), "repeats": F.col("id") % 7, "equal": F.lit(1)}[kind]
    return spark.range(n).select(key.cast("long").alias("primaryid"), (F.col("id") % 3 == 0).cast("int").alias("serious"),
                                 (F.col("id") % (1 if kind == "equal" else 11)).cast("double").alias("x"))


def by_sort(df, quotas):
    """Class, rows in order of (hash of the id, hash of the row), and the part of each place."""
    rows = [(r.serious, hashlib.md5(f"{r.primaryid}:42".encode()).hexdigest() + hashlib.md5(j.encode()).hexdigest(), (r.primaryid, r.serious, r.x))
            for r, j in ((r, r.j) for r in df.withColumn("j", F.to_json(F.struct("primaryid", "serious", "x"))).collect())]
    assert all(json.loads(json.dumps(r[2])) for r in rows)
    out = []
    for c in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == c)
        ends = quotas(len(own), len(rows))
        out += [(next((name for name, q in ends if i < q), None), row) for i, (_, row) in enumerate(own)]
    return sorted(out, key=str)


@pytest.mark.parametrize("last", [100_000, 5])
@pytest.mark.parametrize("kind", ["unique", "repeats", "equal"])
def test_split_and_sample_equal_a_sort_by_hash(spark, kind, last, monkeypatch):
    monkeypatch.setattr(S, "LAST_ROWS", last)
    df = frame(spark, kind).repartition(5).cache()
    half = lambda v: int(v + 0.5)
    got = sorted(((None if r.split == "train" else r.split, (r.primaryid, r.serious, r.x)) for r in S.split_assign(df).collect()), key=str)
    assert got == by_sort(df, lambda n, _: [("test", half(half(0.3 * n) * 0.5)), ("validation", half(0.3 * n))])
    for cap in (1, 50, 150):
        kept = sorted((("kept", tuple(r)) for r in S.stratified_sample(df, cap).collect()), key=str)
        assert kept == [r for r in by_sort(df, lambda n, all_n: [("kept", min(n, max(1, int(cap * (n / all_n)))))]) if r[0]]
    assert S.stratified_sample(df, 10_000).count() == df.count()


def test_rows_are_not_shuffled(spark, monkeypatch):
    df = frame(spark, "unique").checkpoint()
    plan = S.split_assign(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
