"""Edge cases the generated tables do not cover."""

import math
import os

import numpy as np
import pytest

from casekit import config as C
from casekit.functions import columns as X
from casekit.operators import cohort as K
from casekit.operators import prepare as P
from casekit.operators import scoring as S
from casekit.sources import delimited as DL

RAGGED = (b"primaryid$caseid$age$sex\n"
          b"1$11$45$M\n"
          b"2$12$50\n"
          b"3$13$60$F$extra\n"
          b"4$14$$F\n"
          b"5$15$NA$m \n"
          b"6$16$33$F$\n"
          b'7$17$"a$b"$F\n'
          b"8$18$21$caf\xe9\n"
          b"9$19$20$F$$\n"
          b"10$19$20$F$$x\n"
          b"11$20$30$\n"
          b'12$20$30$"F"\n')


def test_ragged_latin1_reader(spark, tmpdir_path):
    """T1/T2/T3: long rows skipped, short rows padded, NA null, quotes, Latin-1."""
    path = os.path.join(tmpdir_path, "DEMO.txt")
    with open(path, "wb") as f:
        f.write(RAGGED)
    df = DL.read_delimited(spark, path)
    assert df.columns == ["primaryid", "caseid", "age", "sex"]
    rows = {int(r["primaryid"]): r for r in df.collect()}
    assert sorted(rows) == [1, 2, 4, 5, 7, 8, 11, 12]
    assert rows[2]["sex"] is None and rows[11]["sex"] is None
    assert rows[4]["age"] is None and rows[5]["age"] is None
    assert rows[7]["age"] == "a$b"
    assert rows[12]["sex"] == "F"
    assert rows[8]["sex"] == "café"
    assert rows[5]["sex"] == "m "
    # the reader feeds the cleaner unchanged; column pruning keeps the row rule
    assert df.select("primaryid").count() == 8


def test_numeric_coercion(spark):
    """T3: pandas-like to_numeric; Java suffixes are not numbers."""
    vals = [" 45 ", "45d", "1e2", "abc", "-3.5", ".5", None, "7f", "\t12\n"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(X.to_number("s")).collect()]
    assert got == [45.0, None, 100.0, None, -3.5, 0.5, None, None, 12.0]


def test_rounding_rules(spark):
    """T4: table columns round like NumPy; scalar paths like Python's round."""
    vals = [0.125, 2.675, 1.005, 0.35, 12.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    np_rule = [r[0] for r in df.select(X.rint_round("x", 2)).collect()]
    py_rule = [r[0] for r in df.select(X.py_round("x", 2)).collect()]
    assert np_rule == [float(np.round(v, 2)) for v in vals]
    assert py_rule == [round(v, 2) for v in vals]
    txt = [r[0] for r in df.select(X.fmt_fixed("x", 1)).collect()]
    assert txt == [f"{v:.1f}" for v in vals]


def test_strip_all_whitespace(spark):
    """T5: Python strip removes tabs and newlines too."""
    df = spark.createDataFrame([("\tm\n",), (" F ",), ("x",)], "s string")
    assert [r[0] for r in df.select(X.norm_upper("s")).collect()] == ["M", "F", "X"]


def _sources(spark, with_reac=True):
    demo = spark.createDataFrame(
        [("1", "45", "M"), ("1", "45", "M"), ("2", "70.5", " f"), ("3", "45d", "M"), (None, "30", "F"),
         ("4", "0", "F"), ("5", "119.9", "m\t"), ("6", "120", "F"), ("7", "50", "X")],
        "PRIMARYID string, Age string, GENDER string")
    drugs = [("1", "aspirin"), ("1", " ASPIRIN "), ("1", "unk"), ("1", None)]
    drugs += [("2", f"D{i}") for i in range(25)]
    drugs += [(None, "x")]
    drug = spark.createDataFrame(drugs, "primaryid string, drugname string")
    outc = spark.createDataFrame([("2", "DE"), ("2", "HO")], "primaryid string, outc_cod string")
    reac = spark.createDataFrame([("2", f"R{i}") for i in range(12)], "primaryid string, pt string")
    return demo, drug, outc, (reac if with_reac else None)


def test_case_table_edge_rows(spark):
    """Duplicate DEMO ids kept, null ids dropped, case-insensitive columns,
    fractional ages, clipping above 20 drugs / 10 reactions, UNK names raise the repeat flag."""
    demo, drug, outc, reac = _sources(spark)
    ct = P.case_table(demo, drug, outc, reac)
    assert ct.columns == C.CASE_COLUMNS
    rows = sorted(ct.collect(), key=lambda r: r["primaryid"])
    assert [r["primaryid"] for r in rows] == [1, 1, 2, 5]
    r1, r2, r5 = rows[0], rows[2], rows[3]
    assert (r1["drug_count"], r1["unique_drug_count"], r1["drug_repeat_flag"]) == (4, 1, 1)
    assert r1["risk_score"] == 21.0  # 11.25 + 6 + 0.75 + 0 + 3
    assert (r2["drug_count"], r2["unique_drug_count"], r2["reaction_count"], r2["serious"]) == (25, 25, 12, 1)
    assert r2["sex"] == "F" and r2["age_group"] == "Senior" and r2["elderly"] == 1
    assert r2["risk_score"] == 89.62  # 17.625 + 30 + 15 + 20 + 7 = 89.625, half to even
    assert r5["age_group"] == "Elderly" and r5["sex"] == "M" and r5["drug_count"] == 0
    assert r5["severity_label"] == "Non-serious"


def test_missing_reac_gives_zero(spark):
    """T14: no REAC source -> reaction_count 0 everywhere."""
    demo, drug, outc, _ = _sources(spark, with_reac=False)
    ct = P.case_table(demo, drug, outc, None)
    assert {r["reaction_count"] for r in ct.collect()} == {0}


def test_age_band_edges(spark):
    """O-11: right-closed bins, 0 included, 65 is 'Older Adult' while elderly=1."""
    ages = [0.0, 12.0, 12.5, 18.0, 65.0, 65.5, 80.0, 120.0, 120.5, -1.0]
    df = spark.createDataFrame([(a,) for a in ages], "age double")
    got = [r[0] for r in df.select(X.age_group("age")).collect()]
    assert got == ["Child", "Child", "Teen", "Teen", "Older Adult", "Senior", "Senior", "Elderly", None, None]


def test_constant_column_correlation_is_null(spark):
    """T17: zero variance gives null, not a division error under ANSI."""
    df = spark.createDataFrame([(1, 0, 3), (1, 1, 5), (1, 0, 4)], "a int, b int, c int")
    out = {(r["row"], r["col"]): r["corr"] for r in K.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert out[("a", "b")] is None and out[("a", "a")] is None
    assert out[("b", "b")] == 1.0
    assert abs(out[("b", "c")] - float(np.corrcoef([0, 1, 0], [3, 5, 4])[0, 1])) < 1e-12


def test_empty_side_rates(spark):
    """T13: deltas use 0 for an empty side, final stats stay null."""
    df = spark.createDataFrame([(70, 1, 1, 8, 1), (75, 1, 1, 4, 0)],
                               "age int, elderly int, polypharmacy int, drug_count int, serious int")
    d = K.risk_deltas(df).first()
    assert d["elderly_risk_delta"] == 50.0
    fs = K.final_stats(df).first()
    assert fs["elderly_rate"] == 50.0


def test_validation_messages(spark):
    cases = [
        ([("x", "M", "1")], "age string, sex string, drug_count string",
         "Age and drug_count must contain numeric values."),
        ([("0", "M", "1"), ("130", "F", "2")], "age string, sex string, drug_count string",
         "Age values must be between 1 and 119."),
        ([("40", "M", "-1")], "age string, sex string, drug_count string", "Drug count cannot be negative."),
        ([("40", "Q", "1")], "age string, sex string, drug_count string",
         "Sex values must contain at least one valid 'F' or 'M' entry."),
        ([("40", "1")], "age string, drug_count string", "Must include either 'sex' or 'sex_code' column."),
    ]
    for rows, schema, msg in cases:
        ok, got = P.validate_upload(spark.createDataFrame(rows, schema)).first()
        assert ok is False and got == msg


def test_prepare_external_defaults(spark):
    """O-15: defaults for missing inputs; supplied flags trusted (an empty one drops
    the row in the required-feature null drop); bad sex rows dropped."""
    up = spark.createDataFrame([("40", "f", "6", None), ("50", "Q", "2", None), ("70", "M", "3", "1")],
                               "age string, sex string, drug_count string, polypharmacy string")
    out = {r["age"]: r for r in P.prepare_external(up).collect()}
    assert sorted(out) == [70.0]
    r70 = out[70.0]
    assert r70["polypharmacy"] == 1 and r70["elderly"] == 1
    assert r70["risk_score"] == round((70 / 100) * 25 + (3 / 20) * 30 + (3 / 20) * 15 + 0 + 0 + 0, 2)
    up2 = spark.createDataFrame([("40", "f", "6"), ("50", "Q", "2")], "age string, sex string, drug_count string")
    rows = P.prepare_external(up2).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["unique_drug_count"], r["drug_repeat_flag"], r["reaction_count"], r["polypharmacy"],
            r["sex_code"]) == (6.0, 0, 0.0, 1, 0)


def test_prepare_labelled_severity_and_ids(spark):
    up = spark.createDataFrame([("45", "m", "3", "1", "Serious"), ("60", "F", "6", "2", "non serious"),
                                ("30", "F", "1", "0", "unknown")],
                               "age string, sex string, drug_count string, reaction_count string, severity_label string")
    out = P.prepare_labelled(up).collect()
    assert len(out) == 2
    assert {r["severity_label"] for r in out} == {"Serious", "Non-serious"}
    assert len({r["primaryid"] for r in out}) == 2
    assert all(r["sex"] in ("M", "F") for r in out)


def test_what_if_direction(spark):
    cases = spark.createDataFrame([(1, 40.0, "F", 2, 1), (2, 70.0, "M", 8, 4)],
                                  "primaryid long, age double, sex string, drug_count int, reaction_count int")
    scen = spark.createDataFrame([(1, 80.0, 9, 5), (2, 70.0, 8, 4)],
                                 "primaryid long, new_age double, new_drug_count int, new_reaction_count int")
    out = {r["primaryid"]: r for r in S.what_if(cases, scen).collect()}
    assert out[1]["direction"] == "Increase" and out[1]["delta_pp"] > 0
    assert out[2]["direction"] == "No material change" and out[2]["risk_changed"] is False


def test_action_and_confidence(spark):
    df = spark.createDataFrame([("High", 0.9), ("medium ", 0.5), ("other", 0.41)], "lv string, p double")
    rows = df.select(S.action_for("lv").alias("a"), S.confidence("p", 0.38).alias("c")).collect()
    assert [r["a"]["action"] for r in rows] == ["Immediate attention", "Review", "Monitor"]

    got = [(c["level"], c["score"], c["threshold_distance"], c["certainty"]) for c in (r["c"] for r in rows)]
    assert got == [("High", 91.0, 0.52, 0.8), ("Low", 18.9, 0.12, 0.0), ("Low", 12.8, 0.03, 0.18)]  # worked by hand


def test_nan_probability_is_high(spark):
    df = spark.createDataFrame([(float("nan"),), (None,)], "p double")
    assert [r[0] for r in df.select(X.risk_level("p")).collect()] == ["High", "High"]


@pytest.mark.parametrize("value", [0.0, 5.0, 80.75])
def test_risk_score_bounds(spark, value):
    df = spark.createDataFrame([(value, 50, 50, 50, 1, 1)], "a double, d int, u int, r int, p int, f int")
    got = df.select(X.risk_score("a", "d", "u", "r", "p", "f")).first()[0]
    assert 0.0 <= got <= 100.0
    assert not math.isnan(got)


def test_resolve_column_rules(spark):
    """O-2: case-insensitive candidates in order; the last of duplicate lower-case names wins; miss -> KeyError."""
    df = spark.createDataFrame([(1, "M", "F")], "PrimaryID int, Gender string, SEX string")
    assert P.resolve_column(df, ["primaryid"]) == "PrimaryID"
    assert P.resolve_column(df, ["sex", "gender"]) == "SEX"
    with pytest.raises(KeyError):
        P.resolve_column(df, ["age"])


def test_single_class_guard(spark):
    """O-38: training needs both classes."""
    from casekit.operators import sampling as SM
    df = spark.createDataFrame([(1, 0), (2, 0)], "primaryid long, serious int")
    with pytest.raises(ValueError):
        SM.require_two_classes(df)
