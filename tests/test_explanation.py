"""The explanation's generated code: no method that the JVM would interpret, the same values."""

from pyspark.sql import functions as F

from casekit import config as C
from casekit.functions import columns as X
from casekit.operators import scoring as S


def table(spark, n=200):
    k = F.col("id")
    cols = {"primaryid": k, "age": F.when(k % 11 == 0, None).otherwise((k * 7 % 90).cast("double")), "sex_code": (k % 2).cast("int"),
            "drug_count": (k % 9).cast("int"), "unique_drug_count": (k % 7).cast("int"), "drug_repeat_flag": (k % 3 == 0).cast("int"),
            "reaction_count": (k % 5).cast("int"), "polypharmacy": (k % 9 > 4).cast("int"), "elderly": (k * 7 % 90 > 64).cast("int"),
            "risk_score": (k * 13 % 1000) / 10.0}
    return spark.range(n).select(*[v.alias(c) for c, v in cols.items()])


def test_no_method_of_the_explanation_is_too_long_for_the_compiler(spark):
    """Beyond 8,000 bytes of bytecode (HotSpot's limit) a method of whole-stage code is interpreted on every row."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan as it runs, before its first stage
    try:
        imp = spark.createDataFrame([(f, 0.05 * (i + 1), "t") for i, f in enumerate(C.FEATURE_COLS)], "feature string, importance double, source string")
        scored = S.score_cases(table(spark), S.proxy_scorer, 0.4, imp, label_threshold=0.5).select(
            "primaryid", F.col("confidence.level"), F.col("explanation.summary"))
        assert len(scored.collect()) == 200
        seq = scored._jdf.queryExecution().debug().codegenToSeq()
        sizes = [seq.apply(i)._3().maxMethodCodeSize() for i in range(seq.size())]
        assert sizes and max(sizes) <= 8000, sizes
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_a_column_apart_is_the_column(spark):
    df = spark.range(4).select(F.when(F.col("id") > 0, F.col("id") / 2).alias("d"), F.when(F.col("id") > 1, F.col("id").cast("string")).alias("s"),
                               F.struct("id").alias("t"))
    out = df.select(*[X.apart(c).alias(c) for c in df.columns])
    assert out.dtypes == df.dtypes and out.collect() == df.collect()


def test_messages_are_made_after_the_ranking(spark):
    """No number is formatted for a driver that is not kept."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        imp = spark.createDataFrame([("age", 0.7, "t"), ("sex_code", 0.3, "t")], "feature string, importance double, source string")
        plan = S.explain(S.proxy_scorer(table(spark)).withColumn("risk_level", F.lit("High")), importance=imp)._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    before_ranking = plan[plan.index(" AS _cand"):]  # a plan's inputs follow it
    assert "format_string" in plan and "format_string" not in before_ranking


def test_numbers_by_their_digits_read_as_python_prints_them(spark):
    values = [0.0, -0.0, 0.04, 0.05, 0.25, 0.5, 0.96, 1.0, 1.05, 1.5, 2.5, 9.95, 16.65, 99.95, 100.0, 1e6 + 0.15, 123456789.25, 2.0 ** 53, 1e12, 1e15, -1.25, -7.5, None]
    rows = spark.createDataFrame([(v,) for v in values + [k / 20 for k in range(2100)]], "v double").select(
        "v", *[X.fmt_fixed("v", d, bind=b, digits_only=True).alias(f"d{d}{int(b)}") for d in (0, 1, 3) for b in (True, False)]).collect()
    for r in rows:
        for d in (0, 1, 3):
            want = None if r.v is None else f"{r.v:.{d}f}"
            assert r[f"d{d}0"] == r[f"d{d}1"] == want, (r.v, d)
