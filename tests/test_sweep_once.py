"""The threshold sweep evaluates what gives the scores once a row."""

from pyspark.sql import functions as F

from casekit.operators import evaluate as E


def test_a_score_is_evaluated_once_a_row(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(k):
        seen.add(1)
        return None if k == 7 else float("nan") if k == 8 else k / 100

    plain = spark.range(100).select(F.lit("m").alias("model"), (F.col("id") % 2).alias("y"), F.col("id").alias("k"))
    grid = [0.2, 0.5, 0.8]
    got = {r.threshold: (r.precision, r.recall) for r in E.threshold_sweep(plain.select("model", "y", score("k").alias("p")), grid).collect()}
    for t in grid:
        hit = [k for k in range(100) if k == 8 or (k != 7 and k / 100 >= t)]
        tp = sum(k % 2 for k in hit)
        assert got[t] == (tp / len(hit), tp / 50)
    assert seen.value == 100


def test_the_grid_holds_no_model(spark):
    """The expression behind ``p`` stands in no lambda, which would evaluate it for each threshold."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    scored = spark.createDataFrame([(Vectors.dense([1 - k / 10, k / 10]), k % 2) for k in range(10)], ["v", "y"]).select(
        F.lit("m").alias("model"), "y", vector_to_array("v")[1].alias("p"))
    plan = E.threshold_sweep(scored)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
