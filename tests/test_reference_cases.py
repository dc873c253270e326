"""The reference's own five example tests, on Spark tables."""


from casekit import config as C
from casekit.functions import columns as X
from casekit.operators import cohort as K
from casekit.operators import prepare as P
from casekit.operators import scoring as S


def test_risk_categorization(spark):
    df = spark.createDataFrame([(0.15,), (0.45,), (0.75,)], "p double")
    got = [r[0] for r in df.select(X.risk_level("p")).collect()]
    assert got == ["Low", "Medium", "High"]


def test_ai_story_flow(spark):
    df = spark.createDataFrame([(70.0, 8.0, "High"), (30.0, 2.0, "Low")], "age double, drug_count double, risk string")
    rows = df.select(S.story_flow("age", "drug_count", "risk").alias("s")).select("s.*").collect()
    flow, reason = rows[0]
    assert "70" in flow and "8" in flow
    assert "high medication load" in reason and "age-related vulnerability" in reason
    flow2, reason2 = rows[1]
    assert "30" in flow2 and "2" in flow2
    assert "balanced age and medication profile" in reason2


def test_data_validation(spark):
    valid = spark.createDataFrame([(45, "M", 3, 1), (67, "F", 6, 4)],
                                  "age int, sex string, drug_count int, reaction_count int")
    ok, msg = P.validate_upload(valid).first()
    assert ok is True and msg == "Data validation passed."
    invalid = spark.createDataFrame([(45, "M", 1), (67, "F", 4)], "age int, sex string, reaction_count int")
    ok2, msg2 = P.validate_upload(invalid).first()
    assert ok2 is False and "drug_count" in msg2


def test_feature_engineering_prep(spark):
    up = spark.createDataFrame([(50.0, "M", 6.0, 2.0), (75.0, "F", 3.0, 4.0)],
                               "age double, sex string, drug_count double, reaction_count double")
    feats = P.prepare_external(up, C.FEATURE_COLS)
    assert feats.count() == 2
    for c in ("sex_code", "polypharmacy", "elderly", "risk_score"):
        assert c in feats.columns


def test_calculate_risk_deltas(spark):
    cohort = spark.createDataFrame([(70, 1, 1, 8, 1), (75, 1, 0, 4, 1), (30, 0, 1, 6, 0), (25, 0, 0, 2, 0)],
                                   "age int, elderly int, polypharmacy int, drug_count int, serious int")
    d = K.risk_deltas(cohort).first().asDict()
    assert d["elderly_risk_delta"] == 100.0
    assert d["polypharmacy_risk_delta"] == 0.0
    assert d["drug_count_gap"] == 2.0


def test_sample_upload_scores(spark):
    rows = [(45, "M", 3, 1), (67, "F", 8, 4), (23, "M", 1, 2), (78, "F", 12, 6), (52, "M", 5, 3)]
    up = spark.createDataFrame(rows, "age int, sex string, drug_count int, reaction_count int")
    out = S.batch_score(up).collect()
    assert len(out) == 5
    assert {r["risk_category"] for r in out} <= {"Low", "Medium", "High"}
    assert all(0.0 <= r["predicted_probability"] <= 1.0 for r in out)
