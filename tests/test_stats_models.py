"""Closed-form checks of the statistics, scaler and sampling against NumPy / pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casekit import config as C
from casekit.functions import distributions as Dist
from casekit.functions import tails
from casekit.operators import models as M
from casekit.operators import ranking as R
from casekit.operators import sampling as S
from casekit.operators import stats_tests as T
from casekit.plans.catalog import cases

from .conftest import SF001


@pytest.fixture(scope="module")
def ml(spark):
    return S.model_frame(cases(spark, SF001)).cache()


@pytest.fixture(scope="module")
def pdf(ml):
    return ml.toPandas()


def test_tail_probabilities():
    assert abs(Dist.t_two_sided(2.0, 10) - 0.07338803477074) < 1e-9
    assert abs(Dist.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(Dist.chi2_sf(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(Dist.f_sf(3.492828476735632, 2, 20) - 0.05) < 1e-9
    assert abs(Dist.t_two_sided(1.959963984540054, 1e7) - 0.05) < 1e-6


def test_welch_t(ml, pdf):
    a = pdf.loc[pdf.serious == 1, "age"].to_numpy(float)
    b = pdf.loc[pdf.serious == 0, "age"].to_numpy(float)
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    t = (a.mean() - b.mean()) / math.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va ** 2 / (len(a) - 1) + vb ** 2 / (len(b) - 1))
    r = T.welch_t(ml).first()
    assert abs(r["statistic"] - t) < 1e-9 and abs(r["df1"] - dof) < 1e-6


def _yates(tab):
    tab = np.asarray(tab, float)
    e = tab.sum(1, keepdims=True) * tab.sum(0, keepdims=True) / tab.sum()
    diff = e - tab
    o = tab + np.minimum(0.5, np.abs(diff)) * np.sign(diff)
    return float(((o - e) ** 2 / e).sum())


@pytest.mark.parametrize("row", ["sex_code", "polypharmacy"])
def test_chi2_yates(ml, pdf, row):
    tab = pd.crosstab(pdf[row], pdf["serious"]).to_numpy()
    r = T.chi2_yates(ml, row).first()
    assert abs(r["statistic"] - _yates(tab)) < 1e-9 and r["df1"] == 1.0


def test_anova(ml, pdf):
    groups = [g["drug_count"].to_numpy(float) for _, g in pdf.groupby("age_group") if len(g) > 1]
    allv = np.concatenate(groups)
    k, n = len(groups), len(allv)
    ssb = sum(len(g) * (g.mean() - allv.mean()) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    f = (ssb / (k - 1)) / (ssw / (n - k))
    r = T.anova_f(ml).first()
    assert abs(r["statistic"] - f) < 1e-9


def test_pearson_spearman(ml, pdf):
    r = T.pearson(ml).first()["statistic"]
    assert abs(r - np.corrcoef(pdf.drug_count, pdf.serious)[0, 1]) < 1e-12
    rx = pdf.drug_count.rank(method="average")
    ry = pdf.serious.rank(method="average")
    rho = T.spearman(ml).first()["statistic"]
    assert abs(rho - np.corrcoef(rx, ry)[0, 1]) < 1e-12


def test_stats_table_has_six_rows(ml):
    rows = T.stats_tests(ml).orderBy("ord").collect()
    assert [r["ord"] for r in rows] == [1, 2, 3, 4, 5, 6]
    assert all(r["p_value"] is None or 0.0 <= r["p_value"] <= 1.0 for r in rows)


def test_standardizer_population_std(ml, pdf):
    sc = M.Standardizer.fit(ml)
    for c in C.FEATURE_COLS:
        v = pdf[c].to_numpy(float)
        assert abs(sc.means[c] - v.mean()) < 1e-9
        exp = v.std(ddof=0) or 1.0
        assert abs(sc.stds[c] - exp) < 1e-9


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.integers(0, 50, 500), np.full(300, 17), rng.normal(0, 1, 200)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    q = R.exact_quantiles(df, "v", [0.25, 0.5, 0.75, 0.9]).first()["q"]
    assert np.allclose(q, np.percentile(vals, [25, 50, 75, 90]), rtol=0, atol=1e-12)


def test_rank_distinct_running_totals(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 40, 2000)
    grp = rng.integers(0, 3, 2000)
    df = spark.createDataFrame([(int(g), int(v), int(v % 2)) for g, v in zip(grp, vals)], "g int, v int, w int")
    r = R.rank_distinct(df, "v", keys=["g"], weight_cols=["w"], num_partitions=5).toPandas()
    for _, row in r.sample(50, random_state=1).iterrows():
        sel = (grp == row.g)
        assert row.before == int((vals[sel] < row.v).sum())
        assert row.cnt == int((vals[sel] == row.v).sum())
        assert row.w_before == int(((vals[sel] < row.v) & (vals[sel] % 2 == 1)).sum())
        assert row.idx == len(set(vals[sel][vals[sel] < row.v]))


def test_split_quotas_and_determinism(spark, ml, pdf):
    sp = S.split_assign(ml)
    got = sp.groupBy("serious", "split").count().toPandas()
    for cls, n_c in pdf.serious.value_counts().items():
        temp = math.floor(0.3 * n_c + 0.5)
        test = math.floor(temp * 0.5 + 0.5)
        sizes = dict(got[got.serious == cls][["split", "count"]].values)
        assert sizes.get("test", 0) == test
        assert sizes.get("validation", 0) == temp - test
        assert sizes.get("train", 0) == n_c - temp
    a = sorted((r[0], r[1]) for r in sp.select("primaryid", "split").collect())
    b = sorted((r[0], r[1]) for r in S.split_assign(ml.repartition(3)).select("primaryid", "split").collect())
    assert a == b


def test_stratified_sample_quota(spark, ml, pdf):
    cap = 500
    out = S.stratified_sample(ml, cap).groupBy("serious").count().toPandas()
    n = len(pdf)
    for cls, n_c in pdf.serious.value_counts().items():
        quota = min(n_c, max(1, int(cap * (n_c / n))))
        assert int(out[out.serious == cls]["count"].iloc[0]) == quota


def test_class_weights(ml, pdf):
    w = {r["serious"]: r["weight"] for r in S.class_weights(ml).collect()}
    counts = pdf.serious.value_counts()
    for cls, n_c in counts.items():
        assert abs(w[cls] - len(pdf) / (2 * n_c)) < 1e-12


def test_mutual_information_plugin(ml, pdf):
    got = {r["feature"]: r["score"] for r in T.mutual_information(ml).collect()}
    n = len(pdf)
    for f in ("drug_count", "polypharmacy", "sex_code"):
        joint = pdf.groupby([f, "serious"]).size() / n
        px = pdf[f].value_counts() / n
        py = pdf["serious"].value_counts() / n
        mi = sum(p * math.log(p / (px[x] * py[y])) for (x, y), p in joint.items())
        assert abs(got[f] - mi) < 1e-12


def test_tail_columns_equal_the_scalar_functions(spark):
    """Folds of fixed length against loops to convergence, from tiny to very large samples."""
    t = [(x, d, Dist.t_two_sided(x, d)) for x in (0.0, 0.3, 1.0, 2.5, 8.0, -1.7) for d in (1.0, 2.5, 30.0, 1e4, 1e7)]
    f = [(x, a, b, Dist.f_sf(x, a, b)) for x in (0.0, 0.4, 1.0, 3.5, 40.0) for a in (1.0, 6.0, 40.0) for b in (3.0, 200.0, 1e5)]
    c = [(x, d, Dist.chi2_sf(x, d)) for x in (0.0, 0.2, 1.0, 5.0, 60.0) for d in (1.0, 2.0, 7.0, 100.0)]
    for rows, names, got in ((t, "x a p", lambda: tails.t_two_sided(F.col("x"), F.col("a"))), (f, "x a b p", lambda: tails.f_tail(F.col("x"), F.col("a"), F.col("b"))),
                             (c, "x a p", lambda: tails.chi2_tail(F.col("x"), F.col("a")))):
        df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names.split()))
        for r in df.select("p", got().alias("q")).collect():
            assert abs(r.p - r.q) < 1e-9, r
    odd = spark.createDataFrame([(None, 3.0), (float("nan"), 3.0), (1.0, 0.0), (float("inf"), 3.0)], "x double, a double")
    assert [r[0] for r in odd.select(tails.t_two_sided(F.col("x"), F.col("a"))).collect()] == [None, None, None, 0.0]
