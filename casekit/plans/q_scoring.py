"""Registered scoring / explanation / evaluation queries (O-46..O-54, O-68..O-84).

Without a trained model, probabilities come from *proxy scorers*: score
columns derived from the case table (``risk_score / 100`` and a few
burden ratios), each evaluated as if it were a model. The evaluation and
explanation operators are the same ones that run on real model output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit import config as C
from casekit.functions import columns as X
from casekit.functions import text as TX
from casekit.operators import evaluate as E
from casekit.operators import prepare as P
from casekit.operators import scoring as S
from casekit.plans import oracle as O
from casekit.plans.catalog import cases, register

D, RE, PR = O.D, O.sql_round_even, O.sql_py_round
H = D(100.0)

# proxy scorers: (name, Spark expression, SQL expression)
PROXIES = [
    ("Composite risk score", lambda: F.col("risk_score").cast("double") / F.lit(100.0),
     f"CAST(risk_score AS DOUBLE) / {D(100)}"),
    ("Drug burden", lambda: F.least(F.col("drug_count").cast("double") / F.lit(15.0), F.lit(1.0)),
     f"least(CAST(drug_count AS DOUBLE) / {D(15)}, {D(1)})"),
    ("Reaction burden", lambda: F.least(F.col("reaction_count").cast("double") / F.lit(10.0), F.lit(1.0)),
     f"least(CAST(reaction_count AS DOUBLE) / {D(10)}, {D(1)})"),
    ("Age", lambda: F.col("age") / F.lit(120.0), f"age / {D(120)}"),
]


def proxy_scores(cs: DataFrame) -> DataFrame:
    """Long (model, primaryid, y, p) table: every case scored by every proxy."""
    e = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), f().alias("p")) for n, f, _ in PROXIES]))
    return cs.select("primaryid", F.col("serious").alias("y"), e.alias("s")).select(
        "s.model", "primaryid", "y", "s.p")


def r6(df, cols):
    return df.withColumns({c: X.rint_round(c, 6) for c in cols})


_SCORED = "\nUNION ALL\n".join(
    f"SELECT '{n}' AS model, primaryid, serious AS y, {sql} AS p FROM cases" for n, _, sql in PROXIES)
_GRID = "SELECT * FROM (VALUES " + ", ".join(f"({D(t)})" for t in C.threshold_grid()) + ") g(threshold)"
_SWEEP = f"""
SELECT model, threshold,
       CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE {D(0)} END AS precision,
       CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE {D(0)} END AS recall,
       CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE)
            ELSE {D(0)} END AS f1
FROM (SELECT s.model, g.threshold,
             count(*) FILTER (WHERE s.p >= g.threshold AND s.y = 1) AS tp,
             count(*) FILTER (WHERE s.p >= g.threshold AND s.y = 0) AS fp,
             count(*) FILTER (WHERE s.p < g.threshold AND s.y = 1) AS fn
      FROM scored s, grid g GROUP BY s.model, g.threshold) c"""
_BEST = "SELECT model, arg_max(threshold, (f1, -threshold)) AS threshold, max(f1) AS best_f1 FROM sweep GROUP BY model"
EVAL_CTES = {"scored": _SCORED, "grid": _GRID, "sweep": _SWEEP, "best": _BEST}
_DIST = """
SELECT model, p, count(*) AS cnt, CAST(sum(y) AS BIGINT) AS pos FROM scored GROUP BY model, p"""


def _scored(spark, sf):
    return proxy_scores(cases(spark, sf))


def _best(spark, sf):
    return E.best_threshold(E.threshold_sweep(_scored(spark, sf)))


# ---------------------------------------------------------------- O-46 / O-47
register("threshold_sweep", O.with_ctes("SELECT * FROM sweep", EVAL_CTES))(
    lambda spark, sf: E.threshold_sweep(_scored(spark, sf)))
register("best_threshold", O.with_ctes("SELECT * FROM best", EVAL_CTES))(_best)

# ---------------------------------------------------------------- O-49 / O-50 / O-51
_ROC = O.with_ctes(f"""
SELECT model, CAST(fps AS DOUBLE) / nullif(n_neg, 0) AS fpr, CAST(tps AS DOUBLE) / nullif(n_pos, 0) AS tpr,
       p AS threshold
FROM k
WHERE last < 2 OR idx = 0 OR idx = last OR fps_prev - 2 * fps + fps_next <> 0 OR tps_prev - 2 * tps + tps_next <> 0
UNION ALL
SELECT model, CAST(0 AS DOUBLE) / nullif(n_neg, 0), CAST(0 AS DOUBLE) / nullif(n_pos, 0), CAST('inf' AS DOUBLE)
FROM t""",
    {**EVAL_CTES, "d": _DIST,
     "c": """
SELECT model, p, CAST(sum(pos) OVER w AS BIGINT) AS tps, CAST(sum(cnt) OVER w - sum(pos) OVER w AS BIGINT) AS fps,
       row_number() OVER w - 1 AS idx
FROM d WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""",
     "t": "SELECT model, max(idx) AS last, max(tps) AS n_pos, max(fps) AS n_neg FROM c GROUP BY model",
     "k": """
SELECT c.*, t.last, t.n_pos, t.n_neg, lag(fps) OVER o AS fps_prev, lead(fps) OVER o AS fps_next,
       lag(tps) OVER o AS tps_prev, lead(tps) OVER o AS tps_next
FROM c JOIN t USING (model) WINDOW o AS (PARTITION BY c.model ORDER BY idx)"""})
register("roc_curve", _ROC)(lambda spark, sf: E.roc_curve(_scored(spark, sf)))

register("pr_curve", O.with_ctes(f"""
SELECT c.model, CAST(c.tps AS DOUBLE) / CAST(c.ps AS DOUBLE) AS precision,
       CASE WHEN t.n_pos = 0 THEN {D(1)} ELSE CAST(c.tps AS DOUBLE) / CAST(t.n_pos AS DOUBLE) END AS recall, c.p AS threshold
FROM c JOIN t USING (model)
UNION ALL SELECT model, {D(1)}, {D(0)}, {D(1)} FROM t""",
    {**EVAL_CTES, "d": _DIST,
     "c": """
SELECT model, p, CAST(sum(pos) OVER w AS BIGINT) AS tps, CAST(sum(cnt) OVER w AS BIGINT) AS ps
FROM d WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""",
     "t": "SELECT model, CAST(sum(y) AS BIGINT) AS n_pos FROM scored GROUP BY model"}))(
    lambda spark, sf: E.pr_curve(_scored(spark, sf)))

_AUC_CTES = {**EVAL_CTES, "d": _DIST,
             "a": """
SELECT model, p, cnt, pos, sum(cnt) OVER w - cnt AS before, sum(pos) OVER w - pos AS pos_before
FROM d WINDOW w AS (PARTITION BY model ORDER BY p ROWS UNBOUNDED PRECEDING)""",
             "auc": f"""
SELECT model, CASE WHEN sum(pos) > 0 AND sum(cnt - pos) > 0 THEN
         sum(CAST(pos AS DOUBLE) * (CAST(before - pos_before AS DOUBLE) + {D(0.5)} * CAST(cnt - pos AS DOUBLE)))
         / CAST(sum(pos) * sum(cnt - pos) AS DOUBLE) END AS roc_auc
FROM a GROUP BY model"""}
register("roc_auc", O.with_ctes("SELECT * FROM auc", _AUC_CTES))(
    lambda spark, sf: E.roc_auc(_scored(spark, sf)))

# ---------------------------------------------------------------- O-52 / O-53 / O-54 / O-68
_METRICS = f"""
SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, model) AS INTEGER) AS rank FROM (
  SELECT m.model, CAST(correct AS DOUBLE) / CAST(n AS DOUBLE) AS accuracy,
         CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE {D(0)} END AS precision,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE {D(0)} END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE)
              ELSE {D(0)} END AS f1,
         auc.roc_auc, m.threshold, brier_score
  FROM (SELECT s.model, b.threshold, count(*) AS n,
               count(*) FILTER (WHERE s.p >= b.threshold AND s.y = 1) AS tp,
               count(*) FILTER (WHERE s.p >= b.threshold AND s.y = 0) AS fp,
               count(*) FILTER (WHERE s.p < b.threshold AND s.y = 1) AS fn,
               count(*) FILTER (WHERE CAST(s.p >= b.threshold AS INTEGER) = s.y) AS correct,
               {RE('avg((s.p - s.y) * (s.p - s.y))', 6)} AS brier_score
        FROM scored s JOIN best b USING (model) GROUP BY s.model, b.threshold) m
  LEFT JOIN auc USING (model)) x"""


def _metrics(spark, sf):
    sc = _scored(spark, sf)
    return r6(E.model_metrics(sc, E.best_threshold(E.threshold_sweep(sc))), ["brier_score"])


register("model_metrics", O.with_ctes("SELECT * FROM metrics", {**_AUC_CTES, "metrics": _METRICS}))(_metrics)

register("confusion_matrix", O.with_ctes("""
SELECT g.model, g.actual, g.predicted, coalesce(c.count, 0) AS count
FROM (SELECT model, a.actual, b.predicted FROM best, (VALUES (0), (1)) a(actual), (VALUES (0), (1)) b(predicted)) g
LEFT JOIN (SELECT s.model, s.y AS actual, CAST(s.p >= b.threshold AS INTEGER) AS predicted, count(*) AS count
           FROM scored s JOIN best b USING (model) GROUP BY ALL) c
  ON c.model = g.model AND c.actual = g.actual AND c.predicted = g.predicted""", EVAL_CTES))(
    lambda spark, sf: E.confusion_matrix(_scored(spark, sf), _best(spark, sf)))

_CAL_BIN = " + ".join(f"CAST(p > {D(k * 0.1)} AS INTEGER)" for k in range(1, 10))
register("calibration_curve", O.with_ctes(f"""
SELECT model, {_CAL_BIN} AS bin, {RE('avg(p)', 6)} AS mean_predicted, avg(CAST(y AS DOUBLE)) AS fraction_positive,
       count(*) AS count FROM scored GROUP BY model, bin""", EVAL_CTES))(
    lambda spark, sf: r6(E.calibration_curve(_scored(spark, sf)), ["mean_predicted"]))


def _f3(x):
    return O.sql_fmt(x, 3)


def _digest_row(i: int, kind: str) -> str:
    who = f"arg_max(model, ({kind}, -rank))"
    return (f"SELECT {i} AS ord, '{kind}' AS kind, {who} AS model, "
            f"{TX.render_sql(C.MODEL_DIGEST[kind], model=who, value=f'max({kind})')} AS text FROM metrics")


_LOW = f"string_agg(model, ', ' ORDER BY rank) FILTER (WHERE threshold < {D(0.35)})"
register("model_digest", O.with_ctes(
    "SELECT * FROM (" + "\nUNION ALL\n".join(
        [_digest_row(i + 1, k) for i, k in enumerate(["f1", "recall", "precision", "roc_auc"])]
        + [f"SELECT 5, 'low_threshold', NULL, {TX.render_sql(C.MODEL_DIGEST['low_threshold'], models=_LOW)} "
           f"FROM metrics"]) + ") x WHERE text IS NOT NULL",
    {**_AUC_CTES, "metrics": _METRICS}))(
    lambda spark, sf: E.model_digest(_metrics(spark, sf)))


# ---------------------------------------------------------------- O-69 .. O-75
def _proxy_cases(spark, sf):
    return S.proxy_scorer(cases(spark, sf))


_P = f"(CAST(risk_score AS DOUBLE) / {D(100)})"
_LEVEL = O.sql_risk_level(_P)

register("risk_levels", O.with_ctes(f"SELECT primaryid, {_P} AS probability, {_LEVEL} AS risk_level FROM cases"))(
    lambda spark, sf: _proxy_cases(spark, sf).select("primaryid", "probability",
                                                     X.risk_level("probability").alias("risk_level")))


def _sql_action(i: int, level: str) -> str:
    lv = f"lower(trim({level}))"
    h, m, lo = C.ACTIONS["High"][i], C.ACTIONS["Medium"][i], C.ACTIONS["Low"][i]
    return f"CASE WHEN {lv} = 'high' THEN '{h}' WHEN {lv} = 'medium' THEN '{m}' ELSE '{lo}' END"


register("risk_actions", O.with_ctes(f"""
SELECT primaryid, risk_level, {_sql_action(0, 'risk_level')} AS action, {_sql_action(1, 'risk_level')} AS priority,
       {_sql_action(2, 'risk_level')} AS rationale
FROM (SELECT primaryid, {_LEVEL} AS risk_level FROM cases) t"""))(
    lambda spark, sf: _proxy_cases(spark, sf).withColumn("risk_level", X.risk_level("probability")).select(
        "primaryid", "risk_level", S.action_for("risk_level").alias("a")).select("primaryid", "risk_level", "a.*"))

_T = 0.5
_PC = f"least(greatest({_P}, {D(0)}), {D(1)})"
_DIST_SQL = f"abs({_PC} - {D(_T)})"
_CERT = f"(abs({_PC} - {D(0.5)}) * {D(2)})"
_CSCORE = f"least({D(1)}, {D(0.55)} * least({_DIST_SQL} / {D(0.35)}, {D(1)}) + {D(0.45)} * {_CERT})"
register("confidence", O.with_ctes(f"""
SELECT primaryid, {_P} AS probability,
       CASE WHEN {_CSCORE} >= {D(0.7)} THEN 'High' WHEN {_CSCORE} >= {D(0.4)} THEN 'Moderate' ELSE 'Low' END AS level,
       {PR(f'{_CSCORE} * {H}', 1)} AS score, {PR(_DIST_SQL, 3)} AS threshold_distance, {PR(_CERT, 3)} AS certainty
FROM cases"""))(
    lambda spark, sf: _proxy_cases(spark, sf).select(
        "primaryid", "probability", S.confidence("probability", _T).alias("c")).select(
        "primaryid", "probability", "c.*"))

register("patient_profile", O.with_ctes(f"""
SELECT primaryid,
       CASE WHEN age >= {D(65)} THEN 'Elderly' WHEN age >= {D(40)} THEN 'Adult' ELSE 'Young' END AS age_group,
       CASE WHEN drug_count >= 5 THEN 'Yes' ELSE 'No' END AS polypharmacy,
       CASE WHEN drug_count >= 5 THEN 'High' ELSE 'Normal' END AS drug_burden
FROM cases"""))(lambda spark, sf: cases(spark, sf).select("primaryid", S.patient_profile().alias("p")).select(
    "primaryid", "p.*"))

_POLY, _OLD = "drug_count >= 5", f"age >= {D(65)}"
_PARTS = (f"concat_ws(' and ', CASE WHEN {_POLY} THEN {TX.sql_literal(S.HIGH_BURDEN_PART)} END, "
          f"CASE WHEN {_OLD} THEN {TX.sql_literal(S.ELDERLY_PART)} END)")
_INTERP_SENTENCE = (
    f"CASE WHEN NOT ({_POLY}) AND NOT ({_OLD}) "
    f"THEN {TX.render_sql(C.INTERPRETATION_TEXT['lower'], part=TX.sql_literal(S.NO_FLAGS_PART))} "
    f"ELSE {TX.render_sql(C.INTERPRETATION_TEXT['elevated'], parts=_PARTS)} END")
_INTERP_DRIVERS = f"concat_ws(', ', CASE WHEN {_POLY} THEN 'drug_count' END, CASE WHEN {_OLD} THEN 'age' END)"
register("interpretation", O.with_ctes(f"""
SELECT primaryid, {_INTERP_SENTENCE} AS sentence, {_INTERP_DRIVERS} AS drivers FROM cases"""))(
    lambda spark, sf: cases(spark, sf).select("primaryid", S.interpretation().alias("i")).select(
        "primaryid", "i.sentence", F.array_join("i.drivers", ", ").alias("drivers")))

_STORY_FLOW = TX.render_sql(C.STORY_TEXT["flow"], age="CAST(trunc(age) AS BIGINT)",
                            drug_count="CAST(drug_count AS BIGINT)", risk=_LEVEL)
_BECAUSE = (f"CASE WHEN NOT ({_POLY}) AND NOT ({_OLD}) THEN {TX.sql_literal(C.STORY_TEXT['balanced'])} "
            f"ELSE concat_ws(' + ', CASE WHEN {_POLY} THEN {TX.sql_literal(C.STORY_TEXT['high_load'])} END, "
            f"CASE WHEN {_OLD} THEN {TX.sql_literal(C.STORY_TEXT['age_vulnerability'])} END) END")
register("story_flow", O.with_ctes(f"SELECT primaryid, {_STORY_FLOW} AS flow, {_BECAUSE} AS because FROM cases"))(
    lambda spark, sf: _proxy_cases(spark, sf).select(
        "primaryid", S.story_flow("age", "drug_count", X.risk_level("probability")).alias("s")).select(
        "primaryid", "s.*"))

_LABEL = f"CASE WHEN {_P} >= {D(_T)} THEN 'Serious' ELSE 'Non-serious' END"
_KEY_DRIVERS = (f"CASE WHEN {_INTERP_DRIVERS} = '' THEN {TX.sql_literal(C.NO_DRIVERS_TEXT)} "
                f"ELSE {_INTERP_DRIVERS} END")
register("ai_texts", O.with_ctes(f"""
SELECT primaryid,
       {TX.render_sql(C.INSIGHT_TEXT, risk=f'lower({_LEVEL})', because=_BECAUSE)} AS insight,
       {TX.render_sql(C.DECISION_TEXT, risk=_LEVEL, label=_LABEL, confidence=f'{_P} * {H}', drivers=_KEY_DRIVERS,
                      interpretation=_INTERP_SENTENCE)} AS decision
FROM cases"""))(lambda spark, sf: _ai_texts(spark, sf))


def _ai_texts(spark, sf):
    s = _proxy_cases(spark, sf)
    lvl = X.risk_level("probability")
    label = F.when(F.col("probability") >= F.lit(_T), F.lit("Serious")).otherwise(F.lit("Non-serious"))
    st = S.story_flow("age", "drug_count", lvl)
    it = S.interpretation()
    return s.select("primaryid", S.insight_text(lvl, st["because"]).alias("insight"),
                    S.decision_text(lvl, label, "probability", it["drivers"], it["sentence"]).alias("decision"))


# ---------------------------------------------------------------- O-76 .. O-78
IMPORTANCE_FEATURES = C.FEATURE_COLS


def proxy_importance(cs: DataFrame) -> DataFrame:
    """Data-derived stand-in for model importance: |corr(feature, serious)| (6 decimals)."""
    aggs = [F.try_divide(F.covar_pop(F.col(f).cast("double"), F.col("serious").cast("double")),
                         F.stddev_pop(F.col(f).cast("double")) * F.stddev_pop(F.col("serious").cast("double")))
            .alias(f) for f in IMPORTANCE_FEATURES]
    row = cs.agg(*aggs)
    kv = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), X.rint_round(F.abs(F.col(f)), 6).alias("importance"))
                             for f in IMPORTANCE_FEATURES]))
    return row.select(kv.alias("e")).select("e.feature", "e.importance")


_IMP = "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, {i} AS ford, {RE(f'abs(covar_pop(CAST({f} AS DOUBLE), CAST(serious AS DOUBLE)) / nullif(stddev_pop(CAST({f} AS DOUBLE)) * stddev_pop(CAST(serious AS DOUBLE)), 0))', 6)} AS importance FROM cases"
    for i, f in enumerate(IMPORTANCE_FEATURES))
_IMPN = f"""
SELECT feature, ford, CASE WHEN (SELECT sum(abs(importance)) FROM imp) > 0
                      THEN abs(importance) / (SELECT sum(abs(importance)) FROM imp) ELSE {D(0)} END AS w FROM imp"""


def _sql_intensity(f: str, v: str) -> str:
    scaled = {"age": f"(({v} - {D(40)}) / {D(50)})", "drug_count": f"({v} / {D(15)})",
              "unique_drug_count": f"({v} / {D(12)})", "reaction_count": f"({v} / {D(10)})",
              "risk_score": f"({v} / {D(80)})"}
    if f in scaled:
        return f"least(greatest({scaled[f]}, {D(0)}), {D(1)})"
    if f in ("polypharmacy", "elderly", "drug_repeat_flag"):
        return f"CASE WHEN CAST({v} AS INTEGER) = 1 THEN {D(1)} ELSE {D(0)} END"
    return f"least(greatest({v}, {D(0)}), {D(1)})"


def _sql_message(f: str, v: str) -> str:
    if f in C.DRIVER_MESSAGES:
        return TX.render_sql(C.DRIVER_MESSAGES[f], value=v)
    return TX.render_sql(C.DRIVER_MESSAGE_OTHER, label=TX.sql_literal(C.FEATURE_LABELS.get(f, f)), value=v)


_TRIG = {"drug_count": "drug_count >= 5", "unique_drug_count": "unique_drug_count >= 5",
         "reaction_count": "reaction_count >= 3", "polypharmacy": "polypharmacy = 1", "elderly": "elderly = 1",
         "drug_repeat_flag": "drug_repeat_flag = 1", "risk_score": f"risk_score >= {D(50)}",
         "age": f"age >= {D(65)}"}


def _cand_sql() -> str:
    parts = []
    for i, (f, _, rw) in enumerate(S.RULES):
        v = f"CAST(c.{f} AS DOUBLE)"
        w = f"coalesce(n.w, {D(0)})"
        parts.append(
            f"SELECT c.primaryid, {i} AS ord, '{f}' AS feature, '{C.FEATURE_LABELS[f]}' AS label, {v} AS value, "
            f"{w} AS wt, {_sql_intensity(f, v)} AS intensity, "
            f"({w} + {D(0.05)}) * {_sql_intensity(f, v)} + {D(rw)} AS score, {_sql_message(f, v)} AS message "
            f"FROM cases c LEFT JOIN impn n ON n.feature = '{f}' WHERE c.{_TRIG[f]}")
    return "\nUNION ALL\n".join(parts)


def _case_expr(fn, alias_v: str = "v") -> str:
    return "CASE k.feature " + " ".join(
        f"WHEN '{f}' THEN {fn(f, f'CAST(c.{f} AS DOUBLE)')}" for f in IMPORTANCE_FEATURES) + " END"


_FB = f"""
SELECT c.primaryid, 100 + k.ford AS ord, k.feature,
       CASE k.feature {' '.join(f"WHEN '{f}' THEN '{C.FEATURE_LABELS[f]}'" for f in IMPORTANCE_FEATURES)} END AS label,
       {_case_expr(lambda f, v: v)} AS value, k.w AS wt, {_case_expr(_sql_intensity)} AS intensity,
       k.w * greatest({_case_expr(_sql_intensity)}, {D(0.1)}) AS score, {_case_expr(_sql_message)} AS message
FROM cases c JOIN (SELECT * FROM impn ORDER BY w DESC, ford LIMIT {C.EXPLAIN_TOP_N}) k ON true
WHERE c.primaryid NOT IN (SELECT primaryid FROM cand)"""
EXPLAIN_CTES = {
    "imp": _IMP, "impn": _IMPN, "cand": _cand_sql(), "fb": _FB,
    "rk": """
SELECT *, row_number() OVER (PARTITION BY primaryid ORDER BY score DESC, ord) AS rank
FROM (SELECT * FROM cand UNION ALL SELECT * FROM fb) a""",
    "topd": f"SELECT * FROM rk WHERE rank <= {C.EXPLAIN_TOP_N}",
    "tt": f"SELECT primaryid, sum(greatest(score, {D(0)})) AS tot FROM topd GROUP BY primaryid",
    "ex": f"""
SELECT t.*, CASE WHEN tt.tot > 0 THEN {PR(f'(greatest(t.score, {D(0)}) / tt.tot) * {H}', 1)} ELSE {D(0)} END AS impact_pct
FROM topd t JOIN tt USING (primaryid)""",
    "exq": f"""
SELECT *, {TX.render_sql(C.QUANTIFIED_MESSAGE, message='message', impact='impact_pct')} AS quantified_message FROM ex""",
}


_SUMMARY_YES = TX.render_sql(C.EXPLANATION_SUMMARY, risk=f"lower({_LEVEL})", drivers="sm.qm")
_SUMMARY_NO = TX.render_sql(C.EXPLANATION_NO_DRIVERS, risk=f"lower({_LEVEL})")


def _explained(spark, sf):
    cs = _proxy_cases(spark, sf).withColumn("risk_level", X.risk_level("probability"))
    return S.explain(cs, "risk_level", proxy_importance(cases(spark, sf)))


register("explain_cases", O.with_ctes(f"""
SELECT primaryid, CAST(rank AS INTEGER) AS rank, feature, label, value, {PR('wt', 4)} AS importance,
       {PR('intensity', 3)} AS feature_intensity, {RE('score', 6)} AS score, message, impact_pct, quantified_message
FROM exq""", EXPLAIN_CTES))(
    lambda spark, sf: r6(S.explain_long(_explained(spark, sf)), ["score"]))

register("explain_summary", O.with_ctes(f"""
SELECT c.primaryid,
       CASE WHEN coalesce(sm.n, 0) > 0 THEN {_SUMMARY_YES}
            ELSE {_SUMMARY_NO}
       END AS summary,
       CAST(coalesce(sm.n, 0) AS INTEGER) AS n_drivers
FROM cases c LEFT JOIN (SELECT primaryid, string_agg(quantified_message, '; ' ORDER BY rank) AS qm, count(*) AS n
                        FROM exq GROUP BY primaryid) sm USING (primaryid)""", EXPLAIN_CTES))(
    lambda spark, sf: _explained(spark, sf).select(
        "primaryid", "explanation.summary", "explanation.n_drivers"))


# ---------------------------------------------------------------- O-79 / O-80
def _upload(spark, sf):
    """The case rows in the upload layout (age, sex, drug_count, reaction_count)."""
    return cases(spark, sf).select("primaryid", "age", "sex", "drug_count", "reaction_count")


def _prep_sql(src: str) -> str:
    """prepare_external over an upload with age, sex, drug_count, reaction_count (strings or numbers)."""
    a, dc, rc = O.sql_to_number("age"), O.sql_to_number("drug_count"), O.sql_to_number("reaction_count")
    return f"""
SELECT primaryid, age, CAST(CASE WHEN sex = 'F' THEN 0 ELSE 1 END AS INTEGER) AS sex_code, drug_count,
       drug_count AS unique_drug_count, CAST(0 AS INTEGER) AS drug_repeat_flag, reaction_count,
       CAST(CASE WHEN drug_count >= {D(5)} THEN 1 ELSE 0 END AS INTEGER) AS polypharmacy,
       CAST(CASE WHEN age >= {D(65)} THEN 1 ELSE 0 END AS INTEGER) AS elderly,
       {O.sql_risk_score('age', 'drug_count', 'drug_count', 'reaction_count',
                         f'CASE WHEN drug_count >= {D(5)} THEN 1 ELSE 0 END', '0', rounding='python')} AS risk_score
FROM (SELECT primaryid, {a} AS age, upper(trim(sex)) AS sex, {dc} AS drug_count, {rc} AS reaction_count
      FROM {src}) u
WHERE sex IN ('F', 'M') AND age > 0 AND age < 120 AND drug_count >= 0 AND reaction_count >= 0
  AND age IS NOT NULL AND drug_count IS NOT NULL AND reaction_count IS NOT NULL"""


_FEATS = ", ".join(C.FEATURE_COLS)
register("batch_score", O.with_ctes(f"""
SELECT {_FEATS}, CASE WHEN risk_score / {D(100)} >= {D(_T)} THEN 'Serious' ELSE 'Non-serious' END AS predicted_label,
       {RE(f'risk_score / {D(100)}', 4)} AS predicted_probability, {O.sql_risk_level(f'risk_score / {D(100)}')} AS risk_category
FROM prep""", {"prep": _prep_sql("cases")}))(
    lambda spark, sf: S.batch_score(_upload(spark, sf).drop("primaryid"), threshold=_T))

register("score_cases", O.with_ctes(f"""
SELECT c.primaryid, {_P} AS probability, {_LEVEL} AS risk_level, {_LABEL} AS predicted_label,
       CASE WHEN age >= {D(65)} THEN 'Elderly' WHEN age >= {D(40)} THEN 'Adult' ELSE 'Young' END AS profile_age_group,
       {_INTERP_SENTENCE} AS interpretation, {_sql_action(0, _LEVEL)} AS action,
       CASE WHEN {_CSCORE} >= {D(0.7)} THEN 'High' WHEN {_CSCORE} >= {D(0.4)} THEN 'Moderate' ELSE 'Low' END AS confidence_level,
       {PR(f'{_CSCORE} * {H}', 1)} AS confidence_score, s.summary AS explanation
FROM cases c JOIN (SELECT c.primaryid,
       CASE WHEN coalesce(sm.n, 0) > 0 THEN {_SUMMARY_YES}
            ELSE {_SUMMARY_NO}
       END AS summary
  FROM cases c LEFT JOIN (SELECT primaryid, string_agg(quantified_message, '; ' ORDER BY rank) AS qm, count(*) AS n
                          FROM exq GROUP BY primaryid) sm USING (primaryid)) s USING (primaryid)""", EXPLAIN_CTES))(
    lambda spark, sf: S.score_cases(cases(spark, sf), S.proxy_scorer, _T, proxy_importance(cases(spark, sf))).select(
        "primaryid", "probability", "risk_level", "predicted_label", F.col("profile.age_group").alias("profile_age_group"),
        F.col("interpretation.sentence").alias("interpretation"), F.col("action.action").alias("action"),
        F.col("confidence.level").alias("confidence_level"), F.col("confidence.score").alias("confidence_score"),
        F.col("explanation.summary").alias("explanation")))


# ---------------------------------------------------------------- O-81
def scenarios(cs: DataFrame) -> DataFrame:
    """One what-if scenario per case: ten years older (at most 119), three more drugs."""
    return cs.select("primaryid", F.least(F.col("age") + 10.0, F.lit(119.0)).alias("new_age"),
                     (F.col("drug_count") + 3).alias("new_drug_count"),
                     F.col("reaction_count").alias("new_reaction_count"))


_CUR = _prep_sql("(SELECT primaryid, age, sex, drug_count, reaction_count FROM cases)")
_ADJ = _prep_sql(f"(SELECT primaryid, least(age + {D(10)}, {D(119)}) AS age, sex, drug_count + 3 AS drug_count, "
                 f"reaction_count FROM cases)")
register("what_if", O.with_ctes(f"""
SELECT cur.primaryid, adj.age AS new_age, adj.drug_count AS new_drug_count, adj.reaction_count AS new_reaction_count,
       cur.risk_score / {D(100)} AS current_probability, adj.risk_score / {D(100)} AS adjusted_probability,
       {O.sql_risk_level(f'cur.risk_score / {D(100)}')} AS current_risk,
       {O.sql_risk_level(f'adj.risk_score / {D(100)}')} AS adjusted_risk,
       (adj.risk_score / {D(100)} - cur.risk_score / {D(100)}) * {H} AS delta_pp,
       CASE WHEN (adj.risk_score / {D(100)} - cur.risk_score / {D(100)}) * {H} > {D(0.05)} THEN 'Increase'
            WHEN (adj.risk_score / {D(100)} - cur.risk_score / {D(100)}) * {H} < {D(-0.05)} THEN 'Decrease'
            ELSE 'No material change' END AS direction,
       {O.sql_risk_level(f'cur.risk_score / {D(100)}')} <> {O.sql_risk_level(f'adj.risk_score / {D(100)}')} AS risk_changed
FROM cur JOIN adj USING (primaryid)""", {"cur": _CUR, "adj": _ADJ}))(
    lambda spark, sf: S.what_if(cases(spark, sf), scenarios(cases(spark, sf))))


# ---------------------------------------------------------------- O-82 / O-83 / O-84
def _pred_output(spark, sf):
    cs = cases(spark, sf)
    t = _best(spark, sf).filter(F.col("model") == PROXIES[0][0]).select("threshold").scalar()
    return S.prediction_output(S.proxy_scorer(cs), t)


_PO_COLS = ["primaryid", "age", "drug_count", "unique_drug_count", "reaction_count", "drug_repeat_flag",
            "polypharmacy", "elderly", "actual_serious", "predicted_serious", "predicted_probability",
            "predicted_risk_level", "prediction_match", "actual_label", "predicted_label", "confidence_pct", "result"]
_PO = f"""
SELECT primaryid, age, drug_count, unique_drug_count, reaction_count, drug_repeat_flag, polypharmacy, elderly,
       risk_score, serious AS actual_serious, pred AS predicted_serious, {_P} AS predicted_probability,
       {_LEVEL} AS predicted_risk_level, serious = pred AS prediction_match,
       CASE WHEN serious = 0 THEN 'Non-serious' WHEN serious = 1 THEN 'Serious' END AS actual_label,
       CASE WHEN pred = 0 THEN 'Non-serious' WHEN pred = 1 THEN 'Serious' END AS predicted_label,
       {RE(f'{_P} * {H}', 2)} AS confidence_pct,
       CASE WHEN serious = pred THEN 'Correct' ELSE 'Mismatch' END AS result
FROM (SELECT *, CAST({_P} >= (SELECT threshold FROM best WHERE model = '{PROXIES[0][0]}') AS INTEGER) AS pred
      FROM cases) x"""
register("prediction_output", O.with_ctes(f"SELECT {', '.join(_PO_COLS)} FROM po", {**EVAL_CTES, "po": _PO}))(
    lambda spark, sf: _pred_output(spark, sf).select(*_PO_COLS))

_YN = "CASE WHEN {c} = 1 THEN 'Yes' WHEN {c} = 0 THEN 'No' END"
register("prediction_view", O.with_ctes(f"""
SELECT primaryid, {', '.join(c if c not in ('polypharmacy', 'elderly', 'drug_repeat_flag') else _YN.format(c=c) + ' AS ' + c for c in S.VIEW_COLS)}
FROM po WHERE NOT prediction_match ORDER BY primaryid LIMIT 50""", {**EVAL_CTES, "po": _PO}))(
    lambda spark, sf: S.prediction_view(_pred_output(spark, sf), "Only Mismatch", 50))

_SEG_FEATS = C.DRIVER_FEATURES
_SEG = f"""
SELECT d.seg_ord, d.risk_segment, coalesce(g.patients, 0) AS patients,
       CASE WHEN g.patients IS NOT NULL THEN {PR(f'(CAST(g.patients AS DOUBLE) / (SELECT count(*) FROM po)) * {H}', 2)} ELSE {D(0)} END AS share_pct,
       CASE WHEN g.patients IS NOT NULL THEN {RE(f'g._p * {H}', 2)} ELSE {D(0)} END AS avg_probability_pct,
       CASE WHEN g.patients IS NOT NULL THEN kd.key_drivers ELSE {TX.sql_literal(C.EMPTY_SEGMENT_TEXT)} END AS key_drivers,
       {', '.join(f"{PR(f'g._m_{c}', 2)} AS avg_{c}" for c in _SEG_FEATS)}
FROM (VALUES (0, 'Low'), (1, 'Medium'), (2, 'High')) d(seg_ord, risk_segment)
LEFT JOIN (SELECT predicted_risk_level AS risk_segment, count(*) AS patients, avg(predicted_probability) AS _p,
                  {', '.join(f'avg(CAST({c} AS DOUBLE)) AS _m_{c}' for c in _SEG_FEATS)}
           FROM po GROUP BY 1) g USING (risk_segment)
LEFT JOIN (SELECT risk_segment, string_agg(name, ', ' ORDER BY gap DESC, ord) AS key_drivers FROM (
             SELECT *, row_number() OVER (PARTITION BY risk_segment ORDER BY gap DESC, ord) AS r FROM (
               {' UNION ALL '.join(f"SELECT g2.risk_segment, {i} AS ord, '{c}' AS name, abs(g2._m_{c} - o._o_{c}) AS gap FROM g2, o" for i, c in enumerate(_SEG_FEATS))}
             ) u) v WHERE r <= 3 GROUP BY risk_segment) kd USING (risk_segment)"""
register("risk_segmentation", O.with_ctes(_SEG, {
    **EVAL_CTES, "po": _PO,
    "g2": f"SELECT predicted_risk_level AS risk_segment, {', '.join(f'avg(CAST({c} AS DOUBLE)) AS _m_{c}' for c in _SEG_FEATS)} FROM po GROUP BY 1",
    "o": f"SELECT {', '.join(f'avg(CAST({c} AS DOUBLE)) AS _o_{c}' for c in _SEG_FEATS)} FROM po"}))(
    lambda spark, sf: S.risk_segmentation(_pred_output(spark, sf)))


# ---------------------------------------------------------------- O-15 / O-14 / O-16 on the case rows
register("prepare_external", O.with_ctes(f"SELECT {_FEATS}, primaryid FROM prep", {"prep": _prep_sql("cases")}))(
    lambda spark, sf: P.prepare_external(_upload(spark, sf)).select(*C.FEATURE_COLS, "primaryid"))
_VA, _VD = O.sql_to_number("age"), O.sql_to_number("drug_count")


def _VM(key: str) -> str:
    return TX.sql_literal(C.VALIDATION_MESSAGES[key])



register("validate_upload", O.with_ctes(f"""
SELECT msg IS NULL AS is_valid, coalesce(msg, {_VM('passed')}) AS message FROM (
  SELECT CASE WHEN bool_and(a IS NULL) OR bool_and(dc IS NULL) THEN {_VM('not_numeric')}
              WHEN bool_and(coalesce(a <= 0 OR a >= 120, false)) THEN {_VM('age_range')}
              WHEN bool_and(coalesce(dc < 0, false)) THEN {_VM('negative_drugs')}
              WHEN NOT bool_or(coalesce(upper(trim(sex)), 'NAN') IN ('F', 'M')) THEN {_VM('no_valid_sex')} END AS msg
  FROM (SELECT {_VA} AS a, {_VD} AS dc, sex FROM cases) u) t"""))(
    lambda spark, sf: P.validate_upload(_upload(spark, sf)))
register("prepare_labelled", O.with_ctes(f"""
SELECT CAST(primaryid AS VARCHAR) AS primaryid, age, sex, CAST(drug_count AS DOUBLE) AS drug_count,
       CAST(unique_drug_count AS DOUBLE) AS unique_drug_count, drug_repeat_flag,
       CAST(reaction_count AS DOUBLE) AS reaction_count, serious, polypharmacy, elderly,
       {O.sql_age_group('age')} AS age_group, sex_code, risk_score, severity_label FROM cases"""))(
    lambda spark, sf: P.prepare_labelled(cases(spark, sf)))
register("build_feature_frame", O.with_ctes(f"SELECT {_FEATS} FROM prep", {"prep": _prep_sql("cases")}))(
    lambda spark, sf: P.build_feature_frame(_upload(spark, sf).drop("primaryid")))
