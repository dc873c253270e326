"""Registered modelling queries (O-38..O-45, O-48, O-55..O-67, O-79/O-80 with a model).

Split, sample, weights, scaling, mutual information and test statistics
are exact and carry a DuckDB oracle. Model fits (network, forest, tree,
logistic, k-means, PCA) are not SQL-shaped: they are registered without
an oracle, with the library's default settings and 10 k-means restarts.
"""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from casekit import config as C
from casekit.functions import columns as X
from casekit.operators import evaluate as E
from casekit.operators import models as M
from casekit.operators import neighbours as NB
from casekit.operators import sampling as S
from casekit.operators import scoring as SC
from casekit.operators import stats_tests as T
from casekit.plans import oracle as O
from casekit.plans import training as TR
from casekit.plans.catalog import cases, register

D, RE = O.D, O.sql_round_even
_MF_COLS = ["primaryid"] + C.FEATURE_COLS + ["age_group", "serious"]
_MF = ", ".join(_MF_COLS)


def r6(df, cols):
    return df.withColumns({c: X.rint_round(c, 6) for c in cols})


_MEMO: dict = {}
_LOCK = threading.RLock()


def _mf(spark, sf):
    return S.model_frame(cases(spark, sf))


def _split(spark, sf):
    return S.split_assign(_mf(spark, sf))


def _split_cut(spark, sf):
    """The split, checkpointed once per session and shared by the keys that only read it."""
    key = (spark.sparkContext.applicationId, sf, "split")
    with _LOCK:
        if key not in _MEMO:
            _MEMO[key] = TR.prepare_split(cases(spark, sf))
        return _MEMO[key]


def _train(spark, sf):
    return _split_cut(spark, sf).filter(F.col("split") == "train")


MODEL_CTES = {
    "mf": f"SELECT {_MF} FROM cases WHERE {' AND '.join(c + ' IS NOT NULL' for c in _MF_COLS[1:])}",
    "rk": """
SELECT *, rank() OVER (PARTITION BY serious ORDER BY md5(CAST(primaryid AS VARCHAR) || ':42')) - 1 AS before,
       count(*) OVER (PARTITION BY serious) AS n_c FROM mf""",
    "sp": f"""
SELECT {_MF}, CASE WHEN before < CAST(round(CAST(CAST(round({D(0.3)} * n_c) AS BIGINT) AS DOUBLE) * {D(0.5)}) AS BIGINT)
                   THEN 'test'
                   WHEN before < CAST(round({D(0.3)} * n_c) AS BIGINT) THEN 'validation' ELSE 'train' END AS split
FROM rk""",
    "train": "SELECT * FROM sp WHERE split = 'train'",
}

# ---------------------------------------------------------------- O-38 / O-39 / O-40
register("model_frame", O.with_ctes("SELECT * FROM mf", MODEL_CTES))(_mf)
register("split_assign", O.with_ctes("SELECT * FROM sp", MODEL_CTES))(_split)
register("stratified_sample", O.with_ctes(f"""
SELECT {_MF} FROM rk
WHERE (SELECT count(*) FROM mf) <= {C.MAX_TRAIN_ROWS}
   OR before < least(n_c, greatest(1, CAST(floor({D(C.MAX_TRAIN_ROWS)} * (n_c / (SELECT count(*) FROM mf))) AS BIGINT)))""",
    MODEL_CTES))(lambda spark, sf: S.stratified_sample(_mf(spark, sf), C.MAX_TRAIN_ROWS))

# ---------------------------------------------------------------- O-45 / O-41
register("class_weights", O.with_ctes("""
SELECT serious, count(*) AS n_c,
       (SELECT count(*) FROM train) / CAST((SELECT count(DISTINCT serious) FROM train) * count(*) AS DOUBLE) AS weight
FROM train GROUP BY serious""", MODEL_CTES))(lambda spark, sf: S.class_weights(_train(spark, sf)))


def q_standardize(spark, sf):
    sp = _split_cut(spark, sf)
    sc = M.Standardizer.fit(sp.filter(F.col("split") == "train"))
    return r6(sp.select("primaryid", "split", *sc.scaled_columns()), [f"z_{c}" for c in C.FEATURE_COLS])


_STD = ", ".join(
    f"{RE(f'(CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM train)) / coalesce(nullif((SELECT stddev_pop(CAST({c} AS DOUBLE)) FROM train), 0), {D(1)})', 6)} AS z_{c}"
    for c in C.FEATURE_COLS)
register("standardize", O.with_ctes(f"SELECT primaryid, split, {_STD} FROM sp", MODEL_CTES))(q_standardize)

# ---------------------------------------------------------------- O-42
_MI_LF = "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, serious AS y FROM train"
                              for c in C.FEATURE_COLS)
register("mutual_information", O.with_ctes(f"""
SELECT j.feature, {RE('sum((CAST(nxy AS DOUBLE) / n) * ln((CAST(nxy AS DOUBLE) * n) / (CAST(nx AS DOUBLE) * CAST(ny AS DOUBLE))))', 6)} AS score
FROM (SELECT feature, value, y, count(*) AS nxy FROM lf GROUP BY ALL) j
JOIN (SELECT feature, value, count(*) AS nx FROM lf GROUP BY ALL) x USING (feature, value)
JOIN (SELECT serious AS y, count(*) AS ny FROM train GROUP BY 1) yy USING (y),
     (SELECT CAST(count(*) AS DOUBLE) AS n FROM train) nn
GROUP BY j.feature""", {**MODEL_CTES, "lf": _MI_LF}))(
    lambda spark, sf: r6(T.mutual_information(_train(spark, sf)), ["score"]))


register("mutual_information_knn")(lambda spark, sf: NB.mutual_information_knn(_train(spark, sf)))


# ---------------------------------------------------------------- O-62 .. O-67 (statistics)
def _chi2_sql(row: str) -> str:
    return f"""
SELECT sum((ou - e) * (ou - e) / e) AS stat, max(dof) AS dof FROM (
  SELECT *, CASE WHEN dof = 1 THEN o + least({D(0.5)}, abs(e - o)) * sign(e - o) ELSE o END AS ou FROM (
    SELECT g.r_l, g.c_l, CAST(coalesce(t.o, 0) AS DOUBLE) AS o,
           sum(CAST(coalesce(t.o, 0) AS DOUBLE)) OVER (PARTITION BY g.r_l) * sum(CAST(coalesce(t.o, 0) AS DOUBLE)) OVER (PARTITION BY g.c_l)
             / sum(CAST(coalesce(t.o, 0) AS DOUBLE)) OVER () AS e,
           ((SELECT count(DISTINCT {row}) FROM mf) - 1) * ((SELECT count(DISTINCT serious) FROM mf) - 1) AS dof
    FROM (SELECT a.r_l, b.c_l FROM (SELECT DISTINCT {row} AS r_l FROM mf) a, (SELECT DISTINCT serious AS c_l FROM mf) b) g
    LEFT JOIN (SELECT {row} AS r_l, serious AS c_l, count(*) AS o FROM mf GROUP BY 1, 2) t USING (r_l, c_l)) x) y"""


_STATS_SQL = f"""
SELECT 1 AS ord, 't-test (age: serious vs non-serious)' AS test,
       {RE('(m1 - m0) / sqrt(v1 / n1 + v0 / n0)', 6)} AS statistic
FROM (SELECT count(*) FILTER (WHERE serious = 1) AS n1, count(*) FILTER (WHERE serious = 0) AS n0,
             avg(age) FILTER (WHERE serious = 1) AS m1, avg(age) FILTER (WHERE serious = 0) AS m0,
             var_samp(age) FILTER (WHERE serious = 1) AS v1, var_samp(age) FILTER (WHERE serious = 0) AS v0 FROM mf) w
UNION ALL SELECT 2, 'chi-square (sex vs serious)', {RE('CASE WHEN dof > 0 THEN stat ELSE 0 END', 6)} FROM ({_chi2_sql('sex_code')}) c1
UNION ALL SELECT 3, 'chi-square (polypharmacy vs serious)', {RE('CASE WHEN dof > 0 THEN stat ELSE 0 END', 6)} FROM ({_chi2_sql('polypharmacy')}) c2
UNION ALL SELECT 4, 'ANOVA (drug_count across age groups)',
       {RE('CASE WHEN k >= 2 THEN ((B - S * S / N) / (k - 1)) / ((SS - B) / (N - k)) END', 6)}
FROM (SELECT count(*) AS k, sum(n) AS N, sum(s) AS S, sum(ss) AS SS, sum(s * s / n) AS B FROM (
        SELECT age_group, count(*) AS n, sum(CAST(drug_count AS DOUBLE)) AS s,
               sum(CAST(drug_count AS DOUBLE) * CAST(drug_count AS DOUBLE)) AS ss
        FROM mf GROUP BY age_group HAVING count(*) > 1) g) a
UNION ALL SELECT 5, 'Pearson (drug_count vs serious)',
       {RE('covar_pop(CAST(drug_count AS DOUBLE), CAST(serious AS DOUBLE)) / nullif(stddev_pop(CAST(drug_count AS DOUBLE)) * stddev_pop(CAST(serious AS DOUBLE)), 0)', 6)}
FROM mf
UNION ALL SELECT 6, 'Spearman (drug_count vs serious)',
       {RE('covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0)', 6)}
FROM (SELECT rank() OVER (ORDER BY drug_count) + (count(*) OVER (PARTITION BY drug_count) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY serious) + (count(*) OVER (PARTITION BY serious) - 1) / 2.0 AS ry FROM mf) r"""
register("stats_tests", O.with_ctes(_STATS_SQL, MODEL_CTES))(
    lambda spark, sf: r6(T.stats_statistics(_mf(spark, sf)).select("ord", "test", "statistic"), ["statistic"]))
# p-values by integrating the densities (Simpson's rule), apart from the fractions and series of the operator
_PVALUE_CTES = {
    "raw": f"""
SELECT 1 AS ord, 't-test (age: serious vs non-serious)' AS test, 't' AS kind, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS st,
       (v1 / n1 + v0 / n0) * (v1 / n1 + v0 / n0) / (v1 / n1 * v1 / n1 / (n1 - 1) + v0 / n0 * v0 / n0 / (n0 - 1)) AS d1, NULL AS d2
FROM (SELECT CAST(count(*) FILTER (WHERE serious = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE serious = 0) AS DOUBLE) AS n0,
             avg(age) FILTER (WHERE serious = 1) AS m1, avg(age) FILTER (WHERE serious = 0) AS m0,
             var_samp(age) FILTER (WHERE serious = 1) AS v1, var_samp(age) FILTER (WHERE serious = 0) AS v0 FROM mf) w
UNION ALL SELECT 2, 'chi-square (sex vs serious)', 'chi2', stat, CAST(dof AS DOUBLE), NULL FROM ({_chi2_sql('sex_code')}) c1
UNION ALL SELECT 3, 'chi-square (polypharmacy vs serious)', 'chi2', stat, CAST(dof AS DOUBLE), NULL FROM ({_chi2_sql('polypharmacy')}) c2
UNION ALL SELECT 4, 'ANOVA (drug_count across age groups)', 'f', ((B - S * S / N) / (k - 1)) / ((SS - B) / (N - k)), CAST(k - 1 AS DOUBLE), CAST(N - k AS DOUBLE)
FROM (SELECT count(*) AS k, sum(n) AS N, sum(s) AS S, sum(ss) AS SS, sum(s * s / n) AS B FROM (
        SELECT age_group, count(*) AS n, sum(CAST(drug_count AS DOUBLE)) AS s,
               sum(CAST(drug_count AS DOUBLE) * CAST(drug_count AS DOUBLE)) AS ss
        FROM mf GROUP BY age_group HAVING count(*) > 1) g) a
UNION ALL SELECT 5, 'Pearson (drug_count vs serious)', 'r', corr(CAST(drug_count AS DOUBLE), CAST(serious AS DOUBLE)), CAST(count(*) - 2 AS DOUBLE), NULL FROM mf
UNION ALL SELECT 6, 'Spearman (drug_count vs serious)', 'r', corr(rx, ry), CAST(count(*) - 2 AS DOUBLE), NULL
FROM (SELECT rank() OVER (ORDER BY drug_count) + (count(*) OVER (PARTITION BY drug_count) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY serious) + (count(*) OVER (PARTITION BY serious) - 1) / 2.0 AS ry FROM mf) r""",
    "lim": """
SELECT ord, test, kind, st, d1, d2,
       CASE kind WHEN 't' THEN abs(st) WHEN 'r' THEN abs(st) * sqrt(d1 / (1 - st * st)) WHEN 'chi2' THEN sqrt(st) ELSE st END AS u FROM raw""",
    "dens": """
SELECT ord, i, CASE
    WHEN kind IN ('t', 'r') THEN 2 * exp(lgamma((d1 + 1) / 2) - lgamma(d1 / 2) - ln(d1 * pi()) / 2 - (d1 + 1) / 2 * ln(1 + x * x / d1))
    WHEN kind = 'chi2' THEN CASE WHEN x = 0 AND d1 > 1 THEN 0 ELSE exp(ln(2) + (d1 - 1) * ln(greatest(x, 1e-300)) - x * x / 2 - d1 / 2 * ln(2) - lgamma(d1 / 2)) END
    WHEN x = 0 THEN 0
    ELSE exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) + d1 / 2 * ln(d1 / d2) + (d1 / 2 - 1) * ln(x) - (d1 + d2) / 2 * ln(1 + d1 * x / d2)) END AS f
FROM (SELECT lim.*, i, u * i / 20000 AS x FROM lim, range(0, 20001) AS t(i)) z""",
    "area": "SELECT ord, sum(f * CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) / 60000 AS a FROM dens GROUP BY ord",
}
register("stats_pvalues", O.with_ctes(f"""
SELECT ord, test, {RE('st', 6)} AS statistic, {RE('greatest(1 - a * u, 0)', 6)} AS p_value, greatest(1 - a * u, 0) < 0.05 AS significant_0_05
FROM lim JOIN area USING (ord)""", {**MODEL_CTES, **_PVALUE_CTES}))(
    lambda spark, sf: r6(T.stats_tests(_mf(spark, sf)), ["statistic", "p_value"]))


# ---------------------------------------------------------------- model fits (rows-only checks)


def _trained(spark, sf):
    """Training shared by the model keys of one session (fit once per sf)."""
    key = (spark.sparkContext.applicationId, sf)
    with _LOCK:
        if key not in _MEMO:
            _MEMO[key] = TR.train_candidates(_split_cut(spark, sf), M.ModelSettings())
        return _MEMO[key]


register("train_models")(lambda spark, sf: _trained(spark, sf).eval_df)
register("refit_test_scores")(lambda spark, sf: _trained(spark, sf).test_scores)
register("validation_sweep")(lambda spark, sf: _trained(spark, sf).extras["validation_sweep"])
register("tuned_thresholds")(lambda spark, sf: _trained(spark, sf).thresholds)
register("model_roc_curve")(lambda spark, sf: E.roc_curve(_trained(spark, sf).test_scores, ranks=_trained(spark, sf).extras["score_ranks"]))
register("model_calibration")(lambda spark, sf: E.calibration_curve(
    _trained(spark, sf).test_scores.filter(F.col("model") == _trained(spark, sf).best_model_name)))
register("imbalance_comparison")(lambda spark, sf: TR.imbalance_comparison(_trained(spark, sf)))
register("tree_importance")(lambda spark, sf: TR.importance_tables(_trained(spark, sf), False)["tree_feature_importance"])
register("permutation_importance")(
    lambda spark, sf: TR.importance_tables(_trained(spark, sf), True)["model_explainability"])


def _clusters(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "clusters")
    with _LOCK:
        if key in _MEMO:
            return _MEMO[key]
        sp = _split_cut(spark, sf)
        _MEMO[key] = TR.clustering(sp.drop("split"), sp.filter(F.col("split") == "train"))
    return _MEMO[key]


register("pca_variance")(lambda spark, sf: _clusters(spark, sf)["pca_variance"])
register("cluster_assign")(lambda spark, sf: _clusters(spark, sf)["cluster_viz"])
register("cluster_summary")(lambda spark, sf: _clusters(spark, sf)["cluster_summary"])
register("silhouette")(lambda spark, sf: _clusters(spark, sf)["silhouette"])


def _model_scorer(spark, sf):
    tr = _trained(spark, sf)
    model, scaler = tr.best_model, tr.scaler

    def run(df):
        return M.positive_probability(model, scaler.transform(df), df.columns).withColumnRenamed("p", "probability")
    return run, tr


def q_batch_score_model(spark, sf):
    """O-79 with the trained champion and its tuned threshold."""
    scorer, tr = _model_scorer(spark, sf)
    up = cases(spark, sf).select("age", "sex", "drug_count", "reaction_count")
    return SC.batch_score(up, scorer, tr.best_threshold)


def q_score_cases_model(spark, sf):
    """O-80 with the trained champion, explained with its native importance."""
    scorer, tr = _model_scorer(spark, sf)
    imp = TR.importance_tables(tr, False).get("tree_feature_importance")
    scored = SC.score_cases(cases(spark, sf), scorer, tr.best_threshold, imp, label_threshold=0.5)
    return scored.select("primaryid", "probability", "risk_level", "predicted_label",
                         F.col("confidence.level").alias("confidence_level"),
                         F.col("explanation.summary").alias("explanation"))


register("batch_score_model")(q_batch_score_model)
register("score_cases_model")(q_score_cases_model)
