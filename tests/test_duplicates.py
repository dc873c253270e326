"""Repeated case ids, repeated rows, constant and NaN columns, upload headers in any order."""

import csv

import pytest
from pyspark.sql import functions as F

from casekit import api
from casekit import config as C
from casekit.operators import cohort as K
from casekit.operators import models as M
from casekit.operators import sampling as SM
from casekit.operators import scoring as S
from casekit.operators import prepare as P
from casekit.sources import delimited as DL
from casekit.streaming import score_stream as SS


def test_what_if_keeps_one_row_per_case_and_scenario(spark):
    cases = spark.createDataFrame([(1, 40.0, "F", 2, 1), (1, 50.0, "F", 2, 1), (1, 50.0, "F", 2, 1), (2, 70.0, "M", 8, 4)],
                                  "primaryid long, age double, sex string, drug_count int, reaction_count int")
    scen = spark.createDataFrame([(1, 120.0, 9, 5), (1, 120.0, 9, 5), (2, 70.0, 8, 4)],
                                 "primaryid long, new_age double, new_drug_count int, new_reaction_count int")
    out = S.what_if(cases, scen).collect()
    assert sorted(r["primaryid"] for r in out) == [1, 1, 1, 2]
    assert len({r["current_probability"] for r in out if r["primaryid"] == 1}) == 2
    assert {r["new_age"] for r in out if r["primaryid"] == 1} == {120.0}  # the range rule is for uploads


def _repeated(spark, n=100, ids=10):
    return spark.range(n).select((F.col("id") % ids).alias("primaryid"), F.lit(1).alias("serious"),
                                 (F.col("id") % 4).cast("double").alias("x"))


def test_split_and_sample_quotas_hold_for_repeated_ids_and_rows(spark):
    df = _repeated(spark)
    split = SM.split_assign(df)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 70, "validation": 15, "test": 15}
    assert split.drop("split").exceptAll(df.select(*split.drop("split").columns)).count() == 0
    assert SM.stratified_sample(df, 25).count() == 25


def test_shuffles_are_permutations():
    for n in (1, 2, 7, 30, 1000):
        for _, _, a, b in M._shuffles(n, ["x", "y"], 3, C.RANDOM_STATE):
            assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


def test_permutation_importance_uses_all_rows_of_repeated_ids(spark, monkeypatch):
    df = spark.range(200).select((F.col("id") % 100).alias("primaryid"), (F.col("id") % 2).cast("int").alias("serious"),
                                 *[((F.col("id") % (i + 2)) * 1.0).alias(c) for i, c in enumerate(C.FEATURE_COLS)])
    seen = {}

    def scores(model, frame, keep):
        seen["rows"] = frame.groupBy("feature", "rep").count().collect()
        seen["x"] = frame.where("rep <= 0").groupBy("feature").agg(
            *[F.array_sort(F.collect_list(c)).alias(c) for c in C.FEATURE_COLS]).collect()
        return frame.select(*keep, (F.col(C.FEATURE_COLS[0]) * 1.0).alias("p"))

    monkeypatch.setattr(M, "positive_probability", scores)

    class Plain:
        cols = C.FEATURE_COLS

        def transform(self, frame):
            return frame

    out = {r["feature"]: r["importance"] for r in M.permutation_importance(None, "m", df, Plain()).collect()}
    assert {r["count"] for r in seen["rows"]} == {200}
    assert all(len({tuple(r[c]) for r in seen["x"]}) == 1 for c in C.FEATURE_COLS)  # same values, other places
    assert out[C.FEATURE_COLS[0]] > 0.2 and all(abs(v) < 1e-12 for f, v in out.items() if f != C.FEATURE_COLS[0])


@pytest.mark.parametrize("n", [1, 5, 8, 50])
def test_block_permutations_equal_brute_force(spark, monkeypatch, n):
    """Each variant: block t gets from block (a t + b) mod the full ones, turned; the last block from itself."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 8)
    df = spark.range(n).select(F.col("id").alias("primaryid"), (F.col("id") % 2).cast("int").alias("serious"), (F.col("id") * 1.0).alias("x"), (F.col("id") * 10.0).alias("y"))
    order = [r.primaryid for r in df.orderBy(F.md5(F.concat(F.lit("7:"), F.to_json(F.struct("primaryid", "serious", "x", "y"))))).collect()]
    got = {}
    for r in M.permuted(df, ["x", "y"], ["primaryid", "serious"], 3, 7).collect():
        got.setdefault((r.feature, r.rep), {})[r.primaryid] = (r.serious, r.x, r.y)
    full, turns = n // 8, M._rotations(min(n, 8), ["x", "y"], 3, 7)
    assert got.pop(("__baseline__", -1)) == {i: (i % 2, i * 1.0, i * 10.0) for i in range(n)}
    shuffles = M._shuffles(max(1, full), ["x", "y"], 3, 7)
    assert len(got) == len(shuffles) == 6
    for f, r, a, b in shuffles:
        for place, i in enumerate(order):
            t, at = divmod(place, 8)
            source, size = (t, n - full * 8) if t == full else ((a * t + b) % full, 8)
            j = order[source * 8 + (at + turns[f, r]) % size]
            assert got[f, r][i] == (i % 2, (j if f == "x" else i) * 1.0, (j if f == "y" else i) * 10.0)


def test_kde_and_histogram_of_constant_and_nan_columns(spark):
    one = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert K.kde(one, "x").count() == 0 and K.kde(one.limit(0), "x").count() == 0
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    h = K.histogram(odd, "x").collect()
    assert sum(r["count"] for r in h) == 2 and min(r["bin_start"] for r in h) == 1.0
    assert K.kde(odd, "x").count() == 200


def test_stream_reads_columns_by_header(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    with open(src / "a.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["age", "sex", "drug_count", "reaction_count", "risk_score", "note"])
        for i in range(15):
            w.writerow([30 + i, "FM"[i % 2], i, "NA" if i == 3 else i % 4, 10 + i, 'say "hi", ok\nbye'])
    batch = S.batch_score(DL.read_upload(spark, str(src)))
    SS.run_to_parquet(SS.scored_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert "primaryid" not in got.columns and got.count() == batch.count() == 14
    assert sorted(r[0] for r in got.select("risk_score").collect()) == [10.0 + i for i in range(15) if i != 3]


def test_csv_round_trip_keeps_texts(spark, tmp_path):
    rows = [(' a "q" \\ b ', "1"), ("x, y", "2"), ("line\nfeed", "3"), ('say ""hi""', "4")]
    DL.write_csv(spark.createDataFrame(rows, "t string, n string"), str(tmp_path / "o"))
    assert sorted((r.t, r.n) for r in DL.read_upload(spark, str(tmp_path / "o")).collect()) == sorted(rows)


def test_labelled_upload_is_validated(spark):
    bad = spark.createDataFrame([("150", "F", "2", "1")], "age string, sex string, drug_count string, serious string")
    with pytest.raises(ValueError):
        api.prepare_uploaded_analysis_data(bad)
    good = bad.withColumn("age", F.lit("50"))
    assert api.prepare_uploaded_analysis_data(good).count() == 1


def test_own_cut_of_a_classifier_is_exclusive(spark):
    feats = P.prepare_external(spark.createDataFrame([(1, 50.0, "F", 2)], "primaryid int, age double, sex string, drug_count int"))
    half = lambda d: d.withColumn("probability", F.lit(0.5))
    assert S.score_cases(feats, half, 0.5).first()["predicted_label"] == "Serious"
    assert S.score_cases(feats, half, 0.4, label_threshold=0.5).first()["predicted_label"] == "Non-serious"


def test_rows_a_task_joins_do_not_grow_with_the_case_table(spark, tmp_path, monkeypatch):
    from casekit.plans import catalog as CT
    ids = spark.range(500).select((F.col("id") % 450).alias("o_orderkey"), (F.col("id") % 60).alias("o_custkey"))
    ids.write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1500).select((F.col("id") % 480).alias("l_orderkey"), (F.col("id") % 40).alias("l_partkey"), (F.col("id") % 5).cast("int").alias("l_linenumber"),
                             (F.col("id") % 50).cast("double").alias("l_quantity"), F.lit("R").alias("l_returnflag"), F.lit("O").alias("l_linestatus")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(40).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), F.col("id").cast("string")).alias("p_name"), F.lit("t").alias("p_type")).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(CT, "TASK_CASES", 50)
    got, plain = CT.cases(spark, str(tmp_path)), CT.build_cases(spark, str(tmp_path))
    sizes = [r["count"] for r in got.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 5 and max(sizes) < 120
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
