"""Row-wise scoring and explanation over tables of cases (O-69..O-84).

Everything here is a column expression or a small aggregate: scoring a
table is one narrow (map-only) stage, so the same functions run on a
batch DataFrame or a streaming one. The explanation is built with arrays
of structs and higher-order functions (``filter``, ``array_sort``,
``slice``, ``aggregate``) instead of a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit import config as C
from casekit.functions import columns as X
from casekit.functions import text as T

Scorer = Callable[[DataFrame], DataFrame]


# ---------------------------------------------------------------- O-69
def with_risk_level(df: DataFrame, prob_col: str = "probability", out: str = "risk_level") -> DataFrame:
    return df.withColumn(out, X.risk_level(prob_col))


# ---------------------------------------------------------------- O-70
def action_for(level: str | Column) -> Column:
    """struct(action, priority, rationale); anything but High/Medium -> Monitor."""
    lv = F.lower(X.py_strip(X.col_(level).cast("string")))

    def pick(i: int) -> Column:
        return (F.when(lv == "high", F.lit(C.ACTIONS["High"][i]))
                .when(lv == "medium", F.lit(C.ACTIONS["Medium"][i]))
                .otherwise(F.lit(C.ACTIONS["Low"][i])))
    return F.struct(pick(0).alias("action"), pick(1).alias("priority"), pick(2).alias("rationale"))


# ---------------------------------------------------------------- O-71
def confidence(p: str | Column, t: str | Column | float) -> Column:
    """struct(level, score %, threshold_distance, certainty)."""
    p = X.clip(X.col_(p), 0.0, 1.0)
    t = X.clip(F.lit(float(t)) if isinstance(t, (int, float)) else X.col_(t), 0.0, 1.0)
    dist = F.abs(p - t)
    cert = F.abs(p - F.lit(0.5)) * F.lit(2.0)
    score = F.least(F.lit(1.0), F.lit(0.55) * F.least(dist / F.lit(0.35), F.lit(1.0)) + F.lit(0.45) * cert)
    level = (F.when(score >= 0.70, F.lit("High")).when(score >= 0.40, F.lit("Moderate"))
             .otherwise(F.lit("Low")))
    # inputs are short arithmetic on one column: used directly (codegen shares the subexpressions)
    return F.struct(level.alias("level"), X.py_round(score * F.lit(100.0), 1, bind=False).alias("score"),
                    X.py_round(dist, 3, bind=False).alias("threshold_distance"),
                    X.py_round(cert, 3, bind=False).alias("certainty"))


# ---------------------------------------------------------------- O-72
def patient_profile(age: str | Column = "age", drug_count: str | Column = "drug_count") -> Column:
    a, d = X.col_(age), X.col_(drug_count)
    poly = d >= C.POLYPHARMACY_THRESHOLD
    return F.struct(
        F.when(a >= C.ELDERLY_THRESHOLD, F.lit("Elderly")).when(a >= C.ADULT_THRESHOLD, F.lit("Adult"))
         .otherwise(F.lit("Young")).alias("age_group"),
        F.when(poly, F.lit("Yes")).otherwise(F.lit("No")).alias("polypharmacy"),
        F.when(poly, F.lit("High")).otherwise(F.lit("Normal")).alias("drug_burden"))


# ---------------------------------------------------------------- O-73
HIGH_BURDEN_PART = C.INTERPRETATION_TEXT["high_burden"]
ELDERLY_PART = C.INTERPRETATION_TEXT["elderly"]
NO_FLAGS_PART = C.INTERPRETATION_TEXT["no_flags"]


def interpretation(age: str | Column = "age", drug_count: str | Column = "drug_count") -> Column:
    """struct(sentence, drivers array<string>)."""
    a, d = X.col_(age), X.col_(drug_count)
    poly, old = d >= C.POLYPHARMACY_THRESHOLD, a >= C.ELDERLY_THRESHOLD
    parts = F.array_compact(F.array(F.when(poly, F.lit(HIGH_BURDEN_PART)), F.when(old, F.lit(ELDERLY_PART))))
    drivers = F.array_compact(F.array(F.when(poly, F.lit("drug_count")), F.when(old, F.lit("age"))))
    sentence = F.when(F.size(parts) == 0, T.render(C.INTERPRETATION_TEXT["lower"], part=F.lit(NO_FLAGS_PART))) \
        .otherwise(T.render(C.INTERPRETATION_TEXT["elevated"], parts=F.array_join(parts, " and ")))
    return F.struct(sentence.alias("sentence"), drivers.alias("drivers"))


# ---------------------------------------------------------------- O-74 / O-75
def story_flow(age: str | Column, drug_count: str | Column, risk: str | Column) -> Column:
    """struct(flow, because): 'Age 70 + Drug Count 8 → High Risk', reasons joined by ' + '."""
    a, d, r = X.col_(age), X.col_(drug_count), X.col_(risk)
    flow = T.render(C.STORY_TEXT["flow"], age=a.cast("double").cast("bigint"),
                    drug_count=d.cast("double").cast("bigint"), risk=r)
    parts = F.array_compact(F.array(
        F.when(d.cast("double") >= C.POLYPHARMACY_THRESHOLD, F.lit(C.STORY_TEXT["high_load"])),
        F.when(a.cast("double") >= C.ELDERLY_THRESHOLD, F.lit(C.STORY_TEXT["age_vulnerability"]))))
    because = F.when(F.size(parts) == 0, F.lit(C.STORY_TEXT["balanced"])).otherwise(F.array_join(parts, " + "))
    return F.struct(flow.alias("flow"), because.alias("because"))


def insight_text(risk: str | Column, because: str | Column) -> Column:
    return T.render(C.INSIGHT_TEXT, risk=F.lower(X.col_(risk)), because=X.col_(because))


def decision_text(risk: str | Column, label: str | Column, prob: str | Column,
                  drivers: str | Column, interp_sentence: str | Column) -> Column:
    dr = X.col_(drivers)
    key = F.when(F.size(dr) > 0, F.array_join(dr, ", ")).otherwise(F.lit(C.NO_DRIVERS_TEXT))
    return T.render(C.DECISION_TEXT, bind=False, risk=X.col_(risk), label=X.col_(label),
                    confidence=X.col_(prob) * F.lit(100.0), drivers=key, interpretation=X.col_(interp_sentence))


# ---------------------------------------------------------------- O-76 .. O-78
FLAGS = ("polypharmacy", "elderly", "drug_repeat_flag")
#: (feature, trigger, rule weight)
RULES = [(f, (lambda v, at=at: v.cast("int") == at) if f in FLAGS else (lambda v, at=at: v >= at), w) for f, at, w in C.RULES]


def feature_intensity(feature: str, v: Column) -> Column:
    v = v.cast("double")
    if feature in C.INTENSITY:
        start, span = C.INTENSITY[feature]
        return X.clip((v - start) / span if start else v / span, 0.0, 1.0)
    if feature in FLAGS:
        return F.when(v.cast("int") == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    return X.clip(v, 0.0, 1.0)


def driver_message(feature: str, v: Column) -> Column:
    v = v.cast("double")
    if feature in C.DRIVER_MESSAGES:
        return T.render(C.DRIVER_MESSAGES[feature], bind=False, digits=True, value=v)
    return T.render(C.DRIVER_MESSAGE_OTHER, label=F.lit(C.FEATURE_LABELS.get(feature, feature)), value=v)


def _apart(cols: dict[str, Column]) -> dict[str, Column]:
    """The columns of one projection, the first (a cheap one) ``apart``."""
    first = next(iter(cols), None)
    return cols if first is None else {**cols, first: X.apart(cols[first])}


def importance_map(importance: DataFrame | None) -> Column | None:
    """Normalised |importance| per feature as a ``map`` (one scalar subquery over <= 9 rows).

    The total comes from a window over the (bounded) importance table, so the
    map is built by a single aggregate."""
    if importance is None:
        return None
    from pyspark.sql import Window
    a = importance.select("feature", F.abs(F.col("importance").cast("double")).alias("a"))
    tot = F.sum("a").over(Window.partitionBy())  # one row per feature
    norm = a.select("feature", F.when(tot > 0, F.col("a") / tot).otherwise(F.lit(0.0)).alias("w"))
    # the weight and its displayed (Python-rounded) form, computed once per query, not per row
    entry = F.struct(F.col("w"), X.py_round(F.col("w"), 4, bind=False).alias("w4"))
    return norm.select(F.map_from_entries(F.collect_list(F.struct("feature", entry)))).scalar()


_CANDIDATE_TYPE = "struct<k1:double,ord:int,at:int,score:double>"


def _candidate(key: Column, ord_: int, at: int, score: Column) -> Column:
    """A candidate driver: feature ``at`` (from 1) with its score; ``k1`` (then ``ord``) is its sort key, so plain
    ``sort_array`` ranks candidates. What a kept driver shows is looked up after the ranking."""
    return F.struct(key.alias("k1"), F.lit(ord_).alias("ord"), F.lit(at).alias("at"), score.alias("score"))


def explain(df: DataFrame, risk_col: str = "risk_level", importance: DataFrame | None = None,
            top_n: int = C.EXPLAIN_TOP_N, importance_order: list[str] | None = None) -> DataFrame:
    """Adds ``explanation`` = struct(summary, drivers array<struct>, n_drivers) per case.

    Up to 8 rule-triggered drivers weighted by model importance, else the
    top importances; ranked by score (stable on the rule order), top N,
    impact % of the kept scores, one sentence.

    The candidate list is bounded (8 rules, top N), so the ranking is
    ``sort_array`` over short structs keyed (-score, rule order); values,
    messages and roundings are made for the kept drivers only, spelled out per
    position. Fused into whole-stage code these projections are methods too
    long for the JVM's compiler, so each long one stands ``apart``.
    """
    imap_q = importance_map(importance)
    cols = set(df.columns)
    if imap_q is not None:
        df = df.withColumn("_imp", imap_q)
    imap = F.col("_imp") if imap_q is not None else None

    def weight(f, field="w"):
        return F.coalesce(imap[F.lit(f)][field], F.lit(0.0)) if imap is not None else F.lit(0.0)

    order = importance_order or C.FEATURE_COLS
    rule_feats = [f for f, _, _ in RULES if f in cols]
    fb_feats = [f for f in order if f in cols] if imap is not None else []
    staged = {}
    feats = list(dict.fromkeys(rule_feats + fb_feats))
    for f in feats:
        staged[f"_w_{f}"] = weight(f)
        staged[f"_in_{f}"] = feature_intensity(f, F.col(f))
    df = df.withColumns(_apart(staged))
    at = {f: i for i, f in enumerate(feats, 1)}
    df = df.withColumns(_apart({**{f"_rs_{f}": (F.col(f"_w_{f}") + F.lit(0.05)) * F.col(f"_in_{f}") + F.lit(rw)
                            for f, _, rw in RULES if f in cols},
                         **{f"_fs_{f}": F.col(f"_w_{f}") * F.greatest(F.col(f"_in_{f}"), F.lit(0.1))
                            for f in fb_feats}}))
    cands, flags = [], []
    for i, (feat, trig, rw) in enumerate(RULES):
        if feat not in cols:
            continue
        sc = F.col(f"_rs_{feat}")
        hit = F.coalesce(trig(F.col(feat).cast("double")), F.lit(False))
        cands.append(F.when(hit, _candidate(-sc, i, at[feat], sc)))
        flags.append(hit.cast("int"))
    if cands:
        out = df.withColumns(_apart({"_ntrig": sum(flags[1:], flags[0]),
                                     "_cand": F.sort_array(F.array(*cands))}))  # nulls (untriggered) first
        top_trig = F.slice(F.col("_cand"), F.lit(len(cands)) - F.col("_ntrig") + 1, F.lit(top_n))
    else:
        out = df.withColumns({"_cand": F.array().cast(f"array<{_CANDIDATE_TYPE}>"), "_ntrig": F.lit(0)})
        top_trig = F.col("_cand")

    if imap is not None:
        fb = [_candidate(-F.col(f"_w_{f}"), 100 + i, at[f], F.col(f"_fs_{f}"))
              for i, f in enumerate(order) if f in cols]
        # the top importances (ties: table order), then re-keyed by score
        out = out.withColumns(_apart({"_nimp": F.size(F.map_keys(imap)),
                                      "_fbw": F.slice(F.sort_array(F.array(*fb)), 1, top_n)}))
        rekeyed = [F.try_element_at(F.col("_fbw"), F.lit(j)) for j in range(1, top_n + 1)]
        rekeyed = [F.when(x.isNotNull(), x.withField("k1", -x["score"])) for x in rekeyed]
        n_fb = F.size("_fbw")
        fb_sorted = F.slice(F.sort_array(F.array(*rekeyed)), F.lit(top_n) - n_fb + 1, n_fb)
        chosen = F.when(X.apart("_ntrig") > 0, top_trig).when(F.col("_nimp") > 0, fb_sorted).otherwise(top_trig)
    else:
        chosen = top_trig
    out = out.withColumn("_drv", chosen)
    pos = range(1, top_n + 1)
    out = out.withColumns({f"_d{j}": F.try_element_at(F.col("_drv"), F.lit(j)) for j in pos})
    total = F.lit(0.0)
    for j in pos:  # Python's sum order over the ranked drivers
        total = total + F.coalesce(F.greatest(F.col(f"_d{j}.score"), F.lit(0.0)), F.lit(0.0))
    out = out.withColumn("_tot", total)

    def shown(j: int, what: Callable[[str], Column]) -> Column:
        """``what`` of the feature of driver ``j``."""
        which = F.col(f"_d{j}.at")
        return reduce(lambda case, f: case.when(which == at[f], what(f)), feats[1:], F.when(which == at[feats[0]], what(feats[0]))) \
            if feats else F.lit(None)

    def named(j: int, names: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(f"_d{j}.at")) if names else F.lit(None).cast("string")

    out = out.withColumns({**{f"_i{j}": F.when((X.apart("_tot") if j == 1 else F.col("_tot")) > 0, X.py_round(
        (F.greatest(F.col(f"_d{j}.score"), F.lit(0.0)) / F.col("_tot")) * F.lit(100.0), 1, bind=False))
        .otherwise(F.lit(0.0)) for j in pos},
        **{f"_m{j}": shown(j, lambda f: driver_message(f, F.col(f))).cast("string") for j in pos},
        **{f"_x{j}": shown(j, lambda f: F.col(f"_in_{f}")).cast("double") for j in pos}})
    # _i<j> is already Python-rounded to 1 decimal: '%.1f' prints it verbatim, no second rounding needed
    out = out.withColumns({f"_q{j}": T.render(C.QUANTIFIED_MESSAGE, rounded=True, digits=True, message=F.col(f"_m{j}"),
                                               impact=F.col(f"_i{j}")) for j in pos})
    drivers = F.slice(F.array(*[
        F.when(F.col(f"_d{j}").isNotNull(), F.struct(
            named(j, feats).alias("feature"), named(j, [C.FEATURE_LABELS.get(f, f) for f in feats]).alias("label"),
            shown(j, lambda f: F.col(f).cast("double")).cast("double").alias("value"),
            shown(j, lambda f: weight(f, "w4")).cast("double").alias("importance"),
            X.py_round(F.col(f"_x{j}"), 3, bind=False).alias("feature_intensity"),
            F.col(f"_d{j}.score").alias("score"), F.col(f"_m{j}").alias("message"), F.col(f"_i{j}").alias("impact_pct"),
            F.col(f"_q{j}").alias("quantified_message"))) for j in pos]), 1, F.size("_drv"))
    risk = F.lower(F.col(risk_col))
    summary = F.when(X.apart(F.size("_drv")) > 0, T.render(
        C.EXPLANATION_SUMMARY, risk=risk, drivers=F.array_join(F.array(*[F.col(f"_q{j}") for j in pos]), "; "))
    ).otherwise(T.render(C.EXPLANATION_NO_DRIVERS, risk=risk))
    temp = ["_cand", "_ntrig", "_nimp", "_fbw", "_drv", "_tot", "_imp"] + [f"_{p}{j}" for p in "dimqx" for j in pos] \
        + [c for c in out.columns if c.startswith(("_w_", "_in_", "_rs_", "_fs_"))]
    return (out.withColumn("explanation", F.struct(summary.alias("summary"), drivers.alias("drivers"),
                                                   F.size("_drv").alias("n_drivers")))
            .drop(*[c for c in temp if c in out.columns]))


def explain_long(explained: DataFrame, key: str = "primaryid") -> DataFrame:
    """One row per (case, driver rank): the unnested explanation.

    The rank is stamped into each struct and the array is expanded with
    ``inline`` (struct fields become columns directly), so no per-field
    extraction sits above the generator.
    """
    ranked = F.transform("explanation.drivers", lambda x, i: F.struct((i + 1).alias("rank"), *[
        x[f].alias(f) for f in ("feature", "label", "value", "importance", "feature_intensity", "score",
                                "message", "impact_pct", "quantified_message")]))
    return explained.select(key, F.inline(ranked))


# ---------------------------------------------------------------- scorers
def proxy_scorer(df: DataFrame) -> DataFrame:
    """Probability proxy p = risk_score / 100 (exact in every engine)."""
    return df.withColumn("probability", F.col("risk_score").cast("double") / F.lit(100.0))


def model_scorer(model, prob_index: int = 1) -> Scorer:
    """Wrap a fitted Spark ML ``PipelineModel`` producing a ``probability`` vector."""
    from pyspark.ml.functions import vector_to_array

    def run(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        p = vector_to_array(F.col("probability"))[prob_index]
        keep = [c for c in df.columns]
        return out.select(*keep, p.alias("probability"))
    return run


# ---------------------------------------------------------------- O-79 / O-80
def score_cases(cases: DataFrame, scorer: Scorer = proxy_scorer, threshold: float = 0.5,
                importance: DataFrame | None = None, label_threshold: float | None = None) -> DataFrame:
    """Full case scoring: probability, level, label, profile, interpretation,
    explanation, action and confidence, for every row of ``cases``.

    ``threshold`` feeds the confidence score; ``label_threshold`` (default:
    the same, inclusive) decides the predicted label; a given one is a classifier's
    own cut, which a probability must exceed. Stateless, so ``cases`` may be a
    streaming DataFrame.
    """
    p = F.col("probability")
    serious = p >= F.lit(float(threshold)) if label_threshold is None else p > F.lit(float(label_threshold))
    s = scorer(cases)
    s = (s.withColumn("risk_level", X.risk_level("probability"))
          .withColumn("predicted_label", F.when(serious, F.lit("Serious"))
                      .otherwise(F.lit("Non-serious")))
          .withColumn("profile", patient_profile())
          .withColumn("interpretation", interpretation())
          .withColumn("action", action_for("risk_level"))
          .withColumn("confidence", confidence("probability", threshold)))
    return explain(s, "risk_level", importance)


def batch_score(upload: DataFrame, scorer: Scorer = proxy_scorer, threshold: float = 0.5) -> DataFrame:
    """O-79: uploaded rows -> features -> probability, label, risk category.

    Validation is the caller's gate (``prepare.validate_upload``); rows that
    cannot be prepared are dropped row by row (never shifted).
    """
    from casekit.operators.prepare import prepare_external
    feats = prepare_external(upload, C.FEATURE_COLS)
    s = scorer(feats)
    return s.select(*C.FEATURE_COLS,
                    F.when(F.col("probability") >= F.lit(float(threshold)), F.lit("Serious"))
                     .otherwise(F.lit("Non-serious")).alias("predicted_label"),
                    X.rint_round("probability", 4).alias("predicted_probability"),
                    X.risk_level("probability").alias("risk_category"))


# ---------------------------------------------------------------- O-81
def what_if(cases: DataFrame, scenarios: DataFrame, scorer: Scorer = proxy_scorer,
            key: str = "primaryid") -> DataFrame:
    """Rescore each case under its scenario (new age / drugs / reactions).

    One join carries each case's inputs next to its scenario, and both are scored
    in the same row, so cases that share an id each keep their own result. Every
    distinct scenario of an id is applied to every case of that id. Both sides are
    rebuilt from the hand-entered inputs only (unique drugs = drug count), without
    the upload's range rule, as the single-case form does.
    """
    from casekit.operators.prepare import prepare_external
    news = ["new_age", "new_drug_count", "new_reaction_count"]
    both = (cases.select(key, "age", "sex", "drug_count", "reaction_count")
            .join(scenarios.select(key, *news).distinct(), key))
    now = scorer(prepare_external(both, bounded=False)).select(
        key, "sex", *[F.col(c).alias(c.removeprefix("new_")) for c in news],
        F.col("probability").alias("current_probability"), X.risk_level("probability").alias("current_risk"))
    j = scorer(prepare_external(now, bounded=False)).select(
        key, F.col("age").alias("new_age"), F.col("drug_count").alias("new_drug_count"),
        F.col("reaction_count").alias("new_reaction_count"), "current_probability", "current_risk",
        F.col("probability").alias("adjusted_probability"), X.risk_level("probability").alias("adjusted_risk"))
    delta = (F.col("adjusted_probability") - F.col("current_probability")) * F.lit(100.0)
    return j.select(key, "new_age", "new_drug_count", "new_reaction_count", "current_probability",
                    "adjusted_probability", "current_risk", "adjusted_risk", delta.alias("delta_pp"),
                    F.when(delta > 0.05, F.lit("Increase")).when(delta < -0.05, F.lit("Decrease"))
                     .otherwise(F.lit("No material change")).alias("direction"),
                    (F.col("current_risk") != F.col("adjusted_risk")).alias("risk_changed"))


# ---------------------------------------------------------------- O-82 / O-83
def prediction_output(scored: DataFrame, threshold: float | Column, prob_col: str = "probability",
                      actual_col: str = "serious") -> DataFrame:
    t = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    pred = (F.col(prob_col) >= t).cast("int")
    out = scored.withColumns({
        "actual_serious": F.col(actual_col).cast("int"),
        "predicted_serious": pred,
        "predicted_probability": F.col(prob_col),
        "predicted_risk_level": X.risk_level(prob_col)})
    match = F.col("actual_serious") == F.col("predicted_serious")
    return out.withColumns({
        "prediction_match": match,
        "actual_label": X.severity_label("actual_serious"),
        "predicted_label": X.severity_label("predicted_serious"),
        "confidence_pct": X.rint_round(F.col(prob_col) * F.lit(100.0), 2),
        "result": F.when(match, F.lit("Correct")).otherwise(F.lit("Mismatch"))})


VIEW_COLS = ["actual_label", "predicted_label", "predicted_risk_level", "confidence_pct", "result", "age",
             "drug_count", "unique_drug_count", "reaction_count", "drug_repeat_flag", "polypharmacy", "elderly"]


def prediction_view(output: DataFrame, mode: str = "All", row_limit: int = 50,
                    order_by: str = "primaryid") -> DataFrame:
    """Filtered, readable prediction rows (flags as Yes/No), first ``row_limit`` in key order."""
    if row_limit not in (25, 50, 100, 200):
        raise ValueError("row_limit must be one of 25, 50, 100, 200")
    v = output
    if mode == "Only Mismatch":
        v = v.filter(~F.col("prediction_match"))
    elif mode == "Only Correct":
        v = v.filter(F.col("prediction_match"))
    cols = [c for c in VIEW_COLS if c in v.columns]
    flags = {"polypharmacy", "elderly", "drug_repeat_flag"}
    return (v.orderBy(order_by).limit(row_limit)
            .select(order_by, *[X.yes_no(c).alias(c) if c in flags else F.col(c) for c in cols]))


# ---------------------------------------------------------------- O-84
SEGMENTS = ["Low", "Medium", "High"]


def risk_segmentation(pred: DataFrame, prob_col: str = "predicted_probability") -> DataFrame:
    """Per Low/Medium/High segment (empty ones kept): size, share, mean
    probability, mean of each driver feature and the 3 features whose
    segment mean is furthest from the overall mean.

    One ``rollup`` pass yields the segment rows and the overall row; the
    overall values are spread to the (<= 3) segment rows with a window over
    that 4-row result.
    """
    from pyspark.sql import Window
    feats = [c for c in C.DRIVER_FEATURES if c in pred.columns]
    s = pred.withColumn("risk_segment", X.risk_level(prob_col))
    g = s.rollup("risk_segment").agg(
        F.grouping("risk_segment").alias("_all"), F.count(F.lit(1)).alias("patients"), F.avg(prob_col).alias("_p"),
        *[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in feats])
    whole = Window.partitionBy()  # the rollup result has at most 4 rows

    def overall(c: str) -> Column:
        return F.max(F.when(F.col("_all") == 1, F.col(c))).over(whole)
    g = (g.withColumns({"_n_all": overall("patients"), **{f"_o_{c}": overall(f"_m_{c}") for c in feats}})
         .filter(F.col("_all") == 0))
    dim = s.sparkSession.createDataFrame([(i, n) for i, n in enumerate(SEGMENTS)], "seg_ord int, risk_segment string")
    j = F.broadcast(dim).join(g, "risk_segment", "left")
    gaps = F.array(*[F.struct(F.abs(F.col(f"_m_{c}") - F.col(f"_o_{c}")).alias("gap"), F.lit(i).alias("ord"),
                              F.lit(c).alias("name")) for i, c in enumerate(feats)])
    top3 = F.slice(F.array_sort(gaps, lambda l, r: F.when(l["gap"] > r["gap"], -1).when(l["gap"] < r["gap"], 1)
                                .otherwise(l["ord"] - r["ord"])), 1, 3)
    has = F.col("patients").isNotNull()
    return j.select(
        "seg_ord", "risk_segment", F.coalesce(F.col("patients"), F.lit(0)).alias("patients"),
        F.when(has, X.py_round((F.col("patients") / F.col("_n_all")) * F.lit(100.0), 2)).otherwise(F.lit(0.0))
         .alias("share_pct"),
        F.when(has, X.rint_round(F.col("_p") * F.lit(100.0), 2)).otherwise(F.lit(0.0)).alias("avg_probability_pct"),
        F.when(has, F.array_join(F.transform(top3, lambda x: x["name"]), ", "))
         .otherwise(F.lit(C.EMPTY_SEGMENT_TEXT)).alias("key_drivers"),
        *[X.py_round(F.col(f"_m_{c}"), 2).alias(f"avg_{c}") for c in feats])
