"""Copies of a lone document beside a large corpus are made by many tasks, and are the same copies."""

import pytest
from pyspark.sql import functions as F

from casekit.llm import mixing


def corpus(spark, n=20_000):
    rest = spark.range(n).select((F.col("id") + 2).alias("doc_id"), F.lit("some words of a usual text").alias("text"), F.lit("big").alias("source"))
    return spark.createDataFrame([(1, "some words of a usual text", "small")], "doc_id long, text string, source string").union(rest)


@pytest.mark.parametrize("many", [256, 16, 7])
def test_copies_of_a_lone_document_are_dealt_over_tasks(spark, monkeypatch, many):
    docs = corpus(spark)
    monkeypatch.setattr(mixing, "MANY", 10 ** 9)
    whole = mixing.replicate(docs).where("doc_id = 1").select("copy_no", "n_copies", "shuffle_key").collect()
    monkeypatch.setattr(mixing, "MANY", many)
    steps = mixing.replicate(docs)
    got = steps.where("doc_id = 1").select("copy_no", "n_copies", "shuffle_key").collect()
    assert len(got) == got[0].n_copies > 9_000 and sorted(got) == sorted(whole)
    assert steps.where("doc_id > 1").groupBy("doc_id").agg((F.count("*") == F.max("n_copies")).alias("ok"), F.max("copy_no").alias("top"),
                                                           F.max("n_copies").alias("n")).where("NOT ok OR top <> n").count() == 0
    rows = [r["count"] for r in steps.groupBy(F.spark_partition_id()).count().collect()]
    assert max(rows) < 2 * sum(rows) / len(rows)
    made = mixing.unfolded(docs.where("doc_id = 1").select("doc_id", F.lit("k").alias("mix_key"), F.lit(9_000).alias("n_copies")), 10_000)
    made = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 9_000 and len(made) >= 4
