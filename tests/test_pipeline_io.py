"""Entry contract, sinks, streaming scorer and a (small) end-to-end training run."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from casekit import config as C
from casekit.operators import models as M
from casekit.plans import training as TR
from casekit.plans.catalog import cases
from casekit.sources import delimited as DL
from casekit.streaming import score_stream as SS

from .conftest import SF001


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.columns == C.CASE_COLUMNS
    assert df.count() == 1269
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def test_csv_sink_roundtrip(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "cohort_csv")
    cs = cases(spark, SF001)
    DL.write_csv(cs, out)
    back = DL.read_upload(spark, out)
    assert back.count() == cs.count()
    assert set(back.columns) == set(C.CASE_COLUMNS)


def test_stream_scores_uploaded_files(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "incoming")
    up = cases(spark, SF001).select(F.col("primaryid").cast("string").alias("primaryid"),
                                    *[F.col(c).cast("string").alias(c) for c in ("age", "sex", "drug_count", "reaction_count")])
    up.repartition(3).write.option("header", True).csv(src)
    sink, ckpt = os.path.join(tmpdir_path, "scored"), os.path.join(tmpdir_path, "ckpt")
    q = SS.run_to_parquet(SS.scored_stream(spark, src), sink, ckpt)
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    assert got.count() == up.count()
    assert {r[0] for r in got.select("risk_level").distinct().collect()} <= {"Low", "Medium", "High"}


def test_training_end_to_end_small(spark):
    split = TR.prepare_split(cases(spark, SF001))
    res = TR.train_candidates(split, M.ModelSettings.fast(), names=["Logistic Regression", "Decision Tree"])
    ev = res.eval_df.collect()
    assert len(ev) == 2 and all(0.0 <= r["f1"] <= 1.0 for r in ev)
    assert res.best_model_name in ("Logistic Regression", "Decision Tree")
    assert 0.2 <= res.best_threshold <= 0.8
    imp = TR.importance_tables(res, permutation=True)
    assert imp["tree_feature_importance"].count() == 9
    assert imp["model_explainability"].count() == 9
    cl = TR.clustering(split.drop("split"), split.filter("split = 'train'"), restarts=2)
    assert cl["cluster_summary"].count() == 3
    assert cl["pca_variance"].count() == 3


def test_api_facade_end_to_end(spark, tmpdir_path):
    """Reference-style calls: files -> case table -> quality -> metrics -> model -> scoring."""
    from casekit import api
    from casekit.plans import q_files

    base = q_files.write_report_files(spark, SF001)
    src = api.load_data(spark, base)
    ct = api.preprocess_data(src["demo"], src["drug"], src["outc"], src["reac"])
    assert ct.count() == 1269
    rep = api.build_data_quality_report(processed=ct, **src)
    assert rep["source_rows"].count() == 4
    assert api.calculate_risk_deltas(ct).count() == 1
    assert api.build_top_risk_segments(ct).count() == 10
    res = TR.train_candidates(TR.prepare_split(ct), M.ModelSettings.fast(), names=["Decision Tree"])
    up = ct.select("primaryid", "age", "sex", "drug_count", "reaction_count").limit(50)
    scored = api.predict_cases(up, res).collect()
    assert len(scored) == 50 and all(r["risk_level"] in ("Low", "Medium", "High") for r in scored)
    ok, msg = api.validate_upload_data(up).first()
    assert ok is True
