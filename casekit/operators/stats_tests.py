"""Statistical tests on the model frame (O-42, O-62..O-67).

Each test reduces the table to sufficient statistics in one aggregation
(counts, sums, sums of squares, a 2x2 crosstab, per-group moments, rank
tables over distinct values). The test statistic is column arithmetic on
that summary, and so is the p-value (tail probabilities as folds of fixed
length, see ``functions/tails``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casekit import config as C
from casekit.functions import tails
from casekit.operators import ranking as R

TESTS = [
    ("t-test (age: serious vs non-serious)", "t"),
    ("chi-square (sex vs serious)", "chi2"),
    ("chi-square (polypharmacy vs serious)", "chi2"),
    ("ANOVA (drug_count across age groups)", "f"),
    ("Pearson (drug_count vs serious)", "r"),
    ("Spearman (drug_count vs serious)", "r"),
]


def _d(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# ---------------------------------------------------------------- O-62
def welch_t(df: DataFrame, value: str = "age", group: str = "serious") -> DataFrame:
    """One row: statistic (group 1 minus group 0), Welch degrees of freedom."""
    g1, g0 = F.col(group) == 1, F.col(group) == 0
    s = df.agg(F.count(F.when(g1, F.col(value))).alias("n1"), F.count(F.when(g0, F.col(value))).alias("n0"),
               F.avg(F.when(g1, _d(value))).alias("m1"), F.avg(F.when(g0, _d(value))).alias("m0"),
               F.var_samp(F.when(g1, _d(value))).alias("v1"), F.var_samp(F.when(g0, _d(value))).alias("v0"))
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b))
    dof = F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))
    return s.select(t.alias("statistic"), dof.alias("df1"), F.lit(None).cast("double").alias("df2"))


# ---------------------------------------------------------------- O-63
def chi2_yates(df: DataFrame, row: str, col: str = "serious") -> DataFrame:
    """Chi-square of the row x col crosstab, Yates-corrected when it is 2x2 (dof 1).

    The crosstab covers every observed level pair (missing pairs count 0);
    levels come from one aggregate of the (categorical, bounded) level sets.
    """
    t = df.groupBy(row, col).agg(F.count(F.lit(1)).cast("double").alias("o"))
    levels = df.agg(F.collect_set(row).alias("rl"), F.collect_set(col).alias("cl"))
    grid = (levels.select(F.explode("rl").alias(row), "cl", F.size("rl").alias("nr"), F.size("cl").alias("nc"))
            .select(row, F.explode("cl").alias(col), "nr", "nc"))
    full = grid.join(t, [row, col], "left").select(row, col, "nr", "nc", F.coalesce("o", F.lit(0.0)).alias("o"))
    tot = Window.partitionBy()  # <= 4 cells
    e = (full.withColumns({"r": F.sum("o").over(Window.partitionBy(row)),
                           "c": F.sum("o").over(Window.partitionBy(col)),
                           "n": F.sum("o").over(tot)})
         .withColumn("e", F.col("r") * F.col("c") / F.col("n"))
         .withColumn("dof", (F.col("nr") - 1) * (F.col("nc") - 1)))
    diff = F.col("e") - F.col("o")
    corrected = F.col("o") + F.least(F.lit(0.5), F.abs(diff)) * F.signum(diff)
    o_used = F.when(F.col("dof") == 1, corrected).otherwise(F.col("o"))
    return e.agg(F.sum((o_used - F.col("e")) * (o_used - F.col("e")) / F.col("e")).alias("statistic"),
                 F.max("dof").cast("double").alias("df1")).select(
        F.when(F.col("df1") > 0, F.col("statistic")).otherwise(F.lit(0.0)).alias("statistic"), "df1",
        F.lit(None).cast("double").alias("df2"))


# ---------------------------------------------------------------- O-64
def anova_f(df: DataFrame, value: str = "drug_count", group: str = "age_group") -> DataFrame:
    """One-way ANOVA over groups with more than one row; null when fewer than 2 such groups."""
    g = (df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(_d(value)).alias("s"),
                               F.sum(_d(value) * _d(value)).alias("ss"))
         .filter(F.col("n") > 1))
    tot = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum("s").alias("S"),
                F.sum("ss").alias("SS"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"))
    ssb = F.col("B") - F.col("S") * F.col("S") / F.col("N")
    ssw = F.col("SS") - F.col("B")
    f = F.try_divide(ssb / (F.col("k") - 1), ssw / (F.col("N") - F.col("k")))
    return tot.select(F.when(F.col("k") >= 2, f).alias("statistic"),
                      F.when(F.col("k") >= 2, (F.col("k") - 1).cast("double")).alias("df1"),
                      F.when(F.col("k") >= 2, (F.col("N") - F.col("k")).cast("double")).alias("df2"))


# ---------------------------------------------------------------- O-65
def pearson(df: DataFrame, x: str = "drug_count", y: str = "serious") -> DataFrame:
    s = df.agg(F.try_divide(F.covar_pop(_d(x), _d(y)), F.stddev_pop(_d(x)) * F.stddev_pop(_d(y))).alias("r"),
               F.count(F.lit(1)).alias("n"))
    return s.select(F.col("r").alias("statistic"), (F.col("n") - 2).cast("double").alias("df1"),
                    F.lit(None).cast("double").alias("df2"))


# ---------------------------------------------------------------- O-66
def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """(value, mean 1-based rank) over distinct values, ties averaged; exact and distributed."""
    r = R.rank_distinct(df.select(col), col)
    return r.select(col, (F.col("before") + (F.col("cnt") + 1) / 2.0).alias(f"_rank_{col}"))


def spearman(df: DataFrame, x: str = "drug_count", y: str = "serious") -> DataFrame:
    """Pearson correlation of average ranks, computed on the (x, y) pair counts."""
    pairs = df.groupBy(x, y).agg(F.count(F.lit(1)).cast("double").alias("w"))
    j = pairs.join(average_ranks(df, x), x).join(average_ranks(df, y), y)
    rx, ry, w = F.col(f"_rank_{x}"), F.col(f"_rank_{y}"), F.col("w")
    s = j.agg(F.sum(w).alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"),
              F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"), F.sum(w * rx * ry).alias("sxy"))
    cov = F.col("sxy") / F.col("n") - (F.col("sx") / F.col("n")) * (F.col("sy") / F.col("n"))
    vx = F.col("sxx") / F.col("n") - (F.col("sx") / F.col("n")) * (F.col("sx") / F.col("n"))
    vy = F.col("syy") / F.col("n") - (F.col("sy") / F.col("n")) * (F.col("sy") / F.col("n"))
    rho = F.try_divide(cov, F.sqrt(vx * vy))
    return s.select(rho.alias("statistic"), (F.col("n") - 2).alias("df1"), F.lit(None).cast("double").alias("df2"))


# ---------------------------------------------------------------- O-67
def stats_statistics(ml: DataFrame) -> DataFrame:
    """Six rows (ord, test, kind, statistic, df1, df2)."""
    parts = [welch_t(ml), chi2_yates(ml, "sex_code"), chi2_yates(ml, "polypharmacy"), anova_f(ml),
             pearson(ml), spearman(ml)]
    out = None
    for i, ((name, kind), p) in enumerate(zip(TESTS, parts)):
        r = p.select(F.lit(i + 1).alias("ord"), F.lit(name).alias("test"), F.lit(kind).alias("kind"),
                     F.col("statistic").cast("double").alias("statistic"), F.col("df1").cast("double").alias("df1"),
                     F.col("df2").cast("double").alias("df2"))
        out = r if out is None else out.unionByName(r)
    return out


def stats_tests(ml: DataFrame) -> DataFrame:
    """(ord, test, statistic, p_value, significant_0_05); the p-value is NaN where the test is undefined."""
    st, d1, d2 = F.col("statistic"), F.col("df1"), F.col("df2")
    # a correlation coefficient is judged by t with n - 2 degrees of freedom
    inner = st * F.sqrt(d1 / (1.0 - st * st))
    r = F.when(F.isnan(st) | st.isNull() | d1.isNull() | (d1 <= 0), None).when(F.abs(st) >= 1.0, 0.0).otherwise(tails.t_two_sided(inner, d1))
    p = (F.when(F.col("kind") == "t", tails.t_two_sided(st, d1))
         .when(F.col("kind") == "chi2", F.when(d1 > 0, tails.chi2_tail(st, d1)).otherwise(1.0))
         .when(F.col("kind") == "f", tails.f_tail(st, d1, d2)).otherwise(r))
    out = stats_statistics(ml).select("ord", "test", "statistic", F.coalesce(p, F.lit(float("nan"))).alias("p_value"))
    return out.withColumn("significant_0_05", F.when(F.isnan("p_value"), False).otherwise(F.col("p_value") < 0.05))


# ---------------------------------------------------------------- O-42
def mutual_information(df: DataFrame, features: list[str] | None = None, label: str = "serious") -> DataFrame:
    """Plug-in mutual information (nats) of each feature with the label, ranked.

    Features here are discrete (counts, flags, integer ages, 2-decimal
    scores), so the empirical joint distribution is used directly: one
    long-form ``groupBy(feature, value, label)``.
    """
    features = features or C.FEATURE_COLS
    kv = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                             for f in features]))
    lf = df.select(F.col(label).alias("y"), kv.alias("e")).select("e.feature", "e.value", "y")
    joint = lf.groupBy("feature", "value", "y").agg(F.count(F.lit(1)).cast("double").alias("nxy"))
    nx = joint.groupBy("feature", "value").agg(F.sum("nxy").alias("nx"))
    ny = F.broadcast(df.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("ny")))
    n = df.select(F.count(F.lit(1)).cast("double")).scalar()
    # the total is projected first: an aggregate's arguments may not hold a subquery
    t = joint.join(nx, ["feature", "value"]).join(ny, "y").withColumn("_n", n)
    nn = F.col("_n")
    mi = t.groupBy("feature").agg(F.sum((F.col("nxy") / nn) * F.log((F.col("nxy") * nn) / (F.col("nx") * F.col("ny"))))
                                  .alias("score"))
    return mi
