"""The split as it is stored: the same rows, and a part is read without the others."""

from pyspark.sql import functions as F

from casekit import config as C
from casekit.operators import sampling as S
from casekit.plans import training as TR


def cases(spark, n=400):
    k = F.col("id")
    cols = {"primaryid": F.when(k % 50 != 0, k % 390), "age": (k * 7 % 90).cast("double"), "sex_code": (k % 2).cast("int"),
            "drug_count": (k % 9).cast("int"), "unique_drug_count": (k % 7).cast("int"), "drug_repeat_flag": (k % 3 == 0).cast("int"),
            "reaction_count": (k % 5).cast("int"), "polypharmacy": (k % 9 > 4).cast("int"), "elderly": (k * 7 % 90 > 64).cast("int"),
            "risk_score": (k * 13 % 1000) / 10.0, "age_group": F.lit("a"), "serious": (k % 4 == 0).cast("int")}
    return spark.range(n).select(*[v.alias(c) for c, v in cols.items()])


def test_the_stored_split_keeps_every_row(spark):
    got, want = TR.prepare_split(cases(spark)), S.split_assign(S.model_frame(cases(spark)))
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_a_part_of_the_split_is_read_alone(spark):
    """A checkpoint was read whole, row by row, for each part and each column asked for."""
    plan = TR.prepare_split(cases(spark)).filter(F.col("split") == "test").select(C.FEATURE_COLS[0])._jdf.queryExecution().executedPlan().toString()
    read = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "split" in read.split("PartitionFilters: [")[1].split("]")[0]
    assert read.split("ReadSchema: ")[1] == f"struct<{C.FEATURE_COLS[0]}:double>"
