"""Registered cohort-analytics queries (O-13, O-17..O-37) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from casekit import config as C
from casekit.functions import columns as X
from casekit.functions import text as TX
from casekit.operators import cohort as K
from casekit.operators import prepare as P
from casekit.plans import oracle as O
from casekit.plans.catalog import cases, register
from casekit.sources import fixtures as FX

D, RE = O.D, O.sql_round_even
H = D(100.0)


def r6(df, cols):
    """Round non-exact doubles (summation-order dependent) to 6 decimals, NumPy rule."""
    return df.withColumns({c: X.rint_round(c, 6) for c in cols})


def agg_if(cond: str, value: str, fn: str = "avg") -> str:
    return f"{fn}(CASE WHEN {cond} THEN {value} END)"


# ---------------------------------------------------------------- O-13 (default bounds)
register("cohort_default_bounds", O.with_ctes(
    "SELECT * FROM cases WHERE age >= (SELECT CAST(trunc(min(age)) AS INTEGER) FROM cases) "
    "AND age <= (SELECT CAST(trunc(max(age)) AS INTEGER) FROM cases)"))(
    lambda spark, sf: P.cohort_filter(cases(spark, sf)))


# ---------------------------------------------------------------- O-17
register("key_metrics", O.with_ctes(f"""
SELECT count(*) AS total_records, avg(age) AS avg_age, avg(drug_count) AS avg_drug_count,
       avg(serious) * {H} AS serious_pct FROM cases"""))(
    lambda spark, sf: K.key_metrics(cases(spark, sf)))

# ---------------------------------------------------------------- O-18
register("executive_summary", O.with_ctes(f"""
SELECT coalesce(avg(serious), {D(0)}) * {H} AS serious_pct, median(age) AS median_age,
       median(drug_count) AS median_drug_count,
       coalesce(avg(polypharmacy), {D(0)}) * {H} AS polypharmacy_pct,
       coalesce(avg(elderly), {D(0)}) * {H} AS elderly_pct, count(*) AS cases FROM cases"""))(
    lambda spark, sf: K.executive_summary(cases(spark, sf)))

# ---------------------------------------------------------------- O-19
register("final_stats", O.with_ctes(f"""
SELECT avg(serious) * {H} AS overall_rate, {agg_if('elderly = 1', 'serious')} * {H} AS elderly_rate,
       {agg_if('polypharmacy = 1', 'serious')} * {H} AS poly_rate,
       median(age) AS median_age, median(drug_count) AS median_drug FROM cases"""))(
    lambda spark, sf: K.final_stats(cases(spark, sf)))

# ---------------------------------------------------------------- O-20
register("risk_deltas", O.with_ctes(f"""
SELECT coalesce({agg_if('elderly = 1', 'serious')}, {D(0)}) * {H}
         - coalesce({agg_if('elderly = 0', 'serious')}, {D(0)}) * {H} AS elderly_risk_delta,
       coalesce({agg_if('polypharmacy = 1', 'serious')}, {D(0)}) * {H}
         - coalesce({agg_if('polypharmacy = 0', 'serious')}, {D(0)}) * {H} AS polypharmacy_risk_delta,
       coalesce({agg_if('serious = 1', 'drug_count')}, {D(0)})
         - coalesce({agg_if('serious = 0', 'drug_count')}, {D(0)}) AS drug_count_gap
FROM cases"""))(lambda spark, sf: K.risk_deltas(cases(spark, sf)))

# ---------------------------------------------------------------- O-21
_AGES = ", ".join(f"({i}, '{g}')" for i, g in enumerate(C.AGE_LABELS))
register("top_risk_segments", O.with_ctes(f"""
SELECT age_group, sex, CASE WHEN polypharmacy = 1 THEN 'Yes' WHEN polypharmacy = 0 THEN 'No' END AS polypharmacy,
       cases, serious_rate_pct
FROM (
  SELECT g.age_ord, g.age_group, g.sex, g.polypharmacy, coalesce(t.cases, 0) AS cases,
         {RE(f't.serious_rate * {H}', 1)} AS serious_rate_pct
  FROM (SELECT * FROM (VALUES {_AGES}) a(age_ord, age_group),
                      (SELECT DISTINCT sex FROM cases) s, (SELECT DISTINCT polypharmacy FROM cases) p) g
  LEFT JOIN (SELECT age_group, sex, polypharmacy, count(primaryid) AS cases, avg(serious) AS serious_rate
             FROM cases GROUP BY age_group, sex, polypharmacy) t
    ON t.age_group = g.age_group AND t.sex = g.sex AND t.polypharmacy = g.polypharmacy
  ORDER BY serious_rate_pct DESC NULLS LAST, cases DESC, age_ord, sex, polypharmacy
  LIMIT 10) x"""))(lambda spark, sf: K.top_risk_segments(cases(spark, sf)))

# ---------------------------------------------------------------- O-22
register("severity_stats", O.with_ctes(f"""
SELECT severity_label, count(primaryid) AS cases, median(age) AS median_age,
       {RE('avg(drug_count)', 2)} AS avg_drug_count, {RE('avg(reaction_count)', 2)} AS avg_reaction_count,
       {RE(f'avg(serious) * {H}', 2)} AS serious_rate
FROM cases GROUP BY severity_label"""))(lambda spark, sf: K.severity_stats(cases(spark, sf)))

# ---------------------------------------------------------------- O-23
register("value_counts", O.with_ctes("""
SELECT 'sex' AS dimension, sex AS value, count(*) AS count FROM cases WHERE sex IS NOT NULL GROUP BY sex
UNION ALL
SELECT 'polypharmacy', CASE WHEN polypharmacy = 1 THEN 'Yes' ELSE 'No' END, count(*) FROM cases
  GROUP BY CASE WHEN polypharmacy = 1 THEN 'Yes' ELSE 'No' END
UNION ALL
SELECT 'severity', severity_label, count(*) FROM cases GROUP BY severity_label"""))(
    lambda spark, sf: K.value_counts(cases(spark, sf)))


# ---------------------------------------------------------------- O-24
def sql_histogram(col: str, bins: int = K.HIST_BINS) -> str:
    v = f"CAST({col} AS DOUBLE)"
    lo = "(CASE WHEN b.lo0 = b.hi0 THEN b.lo0 - 0.5 ELSE b.lo0 END)"
    hi = "(CASE WHEN b.lo0 = b.hi0 THEN b.hi0 + 0.5 ELSE b.hi0 END)"
    step = f"(({hi} - {lo}) / {D(bins)})"

    def edge(i):
        return f"(CASE WHEN ({i}) >= {bins} THEN {hi} ELSE CAST({i} AS DOUBLE) * {step} + {lo} END)"
    raw = f"CAST(floor((({v} - {lo}) / ({hi} - {lo})) * {D(bins)}) AS INTEGER)"
    idx0 = f"(CASE WHEN {raw} = {bins} THEN {raw} - 1 ELSE {raw} END)"
    idx1 = f"(CASE WHEN {v} < {edge(idx0)} THEN {idx0} - 1 ELSE {idx0} END)"
    idx = f"(CASE WHEN {v} >= {edge(idx1 + ' + 1')} AND {idx1} <> {bins - 1} THEN {idx1} + 1 ELSE {idx1} END)"
    return f"""
SELECT '{col}' AS feature, g.bin, g.bin_start, g.bin_end, coalesce(c.count, 0) AS count
FROM (SELECT CAST(r.range AS INTEGER) AS bin, {edge('CAST(r.range AS INTEGER)')} AS bin_start,
             {edge('CAST(r.range AS INTEGER) + 1')} AS bin_end
      FROM range({bins}) r, (SELECT min({v}) AS lo0, max({v}) AS hi0 FROM cases) b) g
LEFT JOIN (SELECT {idx} AS bin, count(*) AS count
           FROM cases, (SELECT min({v}) AS lo0, max({v}) AS hi0 FROM cases) b
           WHERE {col} IS NOT NULL GROUP BY 1) c ON c.bin = g.bin"""


def q_histogram(spark, sf):
    cs = cases(spark, sf)
    out = None
    for c in K.BOX_FEATURES:
        h = K.histogram(cs, c).select(F.lit(c).alias("feature"), "*")
        out = h if out is None else out.unionByName(h)
    return out


register("histogram", O.with_ctes("\nUNION ALL\n".join(sql_histogram(c) for c in K.BOX_FEATURES)))(q_histogram)


# ---------------------------------------------------------------- O-25
def sql_kde(col: str, bins: int = K.HIST_BINS, grid: int = K.KDE_GRID) -> str:
    v = f"CAST({col} AS DOUBLE)"
    gx = f"(CASE WHEN p.point = {grid - 1} THEN s.hi ELSE CAST(p.point AS DOUBLE) * ((s.hi - s.lo) / {D(grid - 1)}) + s.lo END)"
    h = f"(s.sd * pow(s.n, {D(-0.2)}))"
    scale = f"(((s.hi - s.lo) / {D(bins)}) / ({h} * {D((2.0 * 3.141592653589793) ** 0.5)}))"
    return f"""
SELECT '{col}' AS feature, p.point, {RE(gx, 6)} AS x_grid,
       {RE(f'sum(d.m * exp({D(-0.5)} * (({gx} - d.x) / {h}) * (({gx} - d.x) / {h}))) * {scale}', 6)} AS count_density
FROM (SELECT {v} AS x, CAST(count(*) AS DOUBLE) AS m FROM cases WHERE {col} IS NOT NULL GROUP BY 1) d,
     (SELECT CAST(range AS INTEGER) AS point FROM range({grid})) p,
     (SELECT CAST(count({v}) AS DOUBLE) AS n, stddev_samp({v}) AS sd, min({v}) AS lo, max({v}) AS hi FROM cases) s
GROUP BY p.point, s.lo, s.hi, s.sd, s.n"""


def q_kde(spark, sf):
    cs = cases(spark, sf)
    out = None
    for c in K.BOX_FEATURES:
        k = r6(K.kde(cs, c), ["x_grid", "count_density"]).select(F.lit(c).alias("feature"), "*")
        out = k if out is None else out.unionByName(k)
    return out


register("kde", O.with_ctes("\nUNION ALL\n".join(sql_kde(c) for c in K.BOX_FEATURES)))(q_kde)

# ---------------------------------------------------------------- O-26 / O-26b
_BOX_CTES = {
    "lf": "\nUNION ALL\n".join(
        f"SELECT primaryid, severity_label, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM cases"
        for c in K.BOX_FEATURES),
    "bq": f"""
SELECT severity_label, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
       quantile_cont(value, 0.75) AS q3 FROM lf GROUP BY severity_label, feature""",
    "bf": f"SELECT *, q1 - {D(1.5)} * (q3 - q1) AS lo_fence, q3 + {D(1.5)} * (q3 - q1) AS hi_fence FROM bq",
    "bw": """
SELECT l.severity_label, l.feature, any_value(f.q1) AS q1, any_value(f.median) AS median, any_value(f.q3) AS q3,
       coalesce(min(CASE WHEN l.value >= f.lo_fence THEN l.value END), any_value(f.q1)) AS whisker_low,
       coalesce(max(CASE WHEN l.value <= f.hi_fence THEN l.value END), any_value(f.q3)) AS whisker_high,
       count(*) AS n
FROM lf l JOIN bf f ON f.severity_label = l.severity_label AND f.feature = l.feature
GROUP BY l.severity_label, l.feature""",
}
register("box_stats", O.with_ctes("""
SELECT w.severity_label, w.feature, w.n, w.q1, w.median, w.q3, w.whisker_low, w.whisker_high,
       count(*) FILTER (WHERE l.value < w.whisker_low OR l.value > w.whisker_high) AS outliers
FROM bw w JOIN lf l ON l.severity_label = w.severity_label AND l.feature = w.feature
GROUP BY ALL""", _BOX_CTES))(lambda spark, sf: K.box_stats(cases(spark, sf)))
register("outlier_rows", O.with_ctes("""
SELECT l.primaryid, l.severity_label, l.feature, l.value
FROM lf l JOIN bw w ON l.severity_label = w.severity_label AND l.feature = w.feature
WHERE l.value < w.whisker_low OR l.value > w.whisker_high""", _BOX_CTES))(
    lambda spark, sf: K.outlier_rows(cases(spark, sf)))

# ---------------------------------------------------------------- O-27 .. O-29
register("severity_means", O.with_ctes(f"""
SELECT {agg_if('serious = 1', 'age')} AS avg_age_serious, {agg_if('serious = 0', 'age')} AS avg_age_non_serious,
       {agg_if('serious = 1', 'drug_count')} AS avg_drug_serious,
       {agg_if('serious = 0', 'drug_count')} AS avg_drug_non_serious FROM cases"""))(
    lambda spark, sf: K.severity_means(cases(spark, sf)))
register("sex_severity_pivot", O.with_ctes("""
SELECT sex, count(*) FILTER (WHERE severity_label = 'Non-serious') AS "Non-serious",
       count(*) FILTER (WHERE severity_label = 'Serious') AS "Serious" FROM cases GROUP BY sex"""))(
    lambda spark, sf: K.sex_severity_pivot(cases(spark, sf)))
register("serious_by_sex", O.with_ctes(f"""
SELECT sex, {RE(f'avg(serious) * {H}', 1)} AS serious_pct FROM cases GROUP BY sex"""))(
    lambda spark, sf: K.serious_by_sex(cases(spark, sf)))


# ---------------------------------------------------------------- O-30
def sql_correlation() -> str:
    cols = C.CORRELATION_COLS
    nm = {c: ("sex" if c == "sex_code" else c) for c in cols}
    sel = [f"stddev_pop(CAST({c} AS DOUBLE)) AS sd_{c}" for c in cols]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    sel += [f"covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS cv_{a}__{b}" for a, b in pairs]
    parts = []
    for a, b in pairs:
        r = RE(f"cv_{a}__{b} / nullif(sd_{a} * sd_{b}, 0)", 6)
        parts.append(f"SELECT '{nm[a]}' AS row, '{nm[b]}' AS col, {r} AS corr FROM m")
        parts.append(f"SELECT '{nm[b]}' AS row, '{nm[a]}' AS col, {r} AS corr FROM m")
    for c in cols:
        parts.append(f"SELECT '{nm[c]}', '{nm[c]}', CASE WHEN sd_{c} > 0 THEN {D(1.0)} END FROM m")
    return O.with_ctes("\nUNION ALL\n".join(parts), {"m": "SELECT " + ", ".join(sel) + " FROM cases"})


register("correlation_matrix", sql_correlation())(
    lambda spark, sf: r6(K.correlation_matrix(cases(spark, sf)), ["corr"]))


# ---------------------------------------------------------------- O-31
def _phrase(t: str, f: str) -> str:
    return (f"CASE WHEN {f} <= 0 THEN {TX.sql_literal(C.UNDEFINED_RELATIVE_PHRASE)} "
            f"ELSE {TX.render_sql(C.RELATIVE_PHRASE, rel=f'(({t} - {f}) / {f}) * {H}')} END")


def _insight_sql(name: str, t: str | None = None, f: str | None = None) -> str:
    fields = {"overall": "overall", "cutoff": "cutoff", "share": "rep_share"}
    if t:
        fields.update(rate_true=t, rate_false=f, delta=f"{t} - {f}", phrase=_phrase(t, f))
    return TX.render_sql(C.CLINICAL_INSIGHTS[name], **fields) if t else \
        TX.render_sql(C.CLINICAL_INSIGHTS[name], **{k: v for k, v in fields.items()})


def _shown(t: str, f: str) -> str:
    return f"(coalesce({t} <> 0, true) OR coalesce({f} <> 0, true))"


def _rel(t: str, f: str) -> str:
    return f"CASE WHEN {f} > 0 THEN (({t} - {f}) / {f}) * {H} END"


_INS_ROW = f"""
SELECT avg(serious) * {H} AS overall,
       {agg_if('polypharmacy = 1', 'serious')} * {H} AS poly_t, {agg_if('polypharmacy = 0', 'serious')} * {H} AS poly_f,
       {agg_if('elderly = 1', 'serious')} * {H} AS eld_t, {agg_if('elderly = 0', 'serious')} * {H} AS eld_f,
       {agg_if('CAST(reaction_count AS DOUBLE) >= q.cutoff', 'serious')} * {H} AS rx_t,
       {agg_if('CAST(reaction_count AS DOUBLE) < q.cutoff', 'serious')} * {H} AS rx_f,
       {agg_if('drug_repeat_flag = 1', 'serious')} * {H} AS rep_t,
       {agg_if('drug_repeat_flag = 0', 'serious')} * {H} AS rep_f,
       avg(drug_repeat_flag) * {H} AS rep_share, count(*) AS n, any_value(q.cutoff) AS cutoff
FROM cases, (SELECT greatest({D(3)}, quantile_cont(reaction_count, 0.75)) AS cutoff FROM cases) q"""
_INS = [
    (1, "polypharmacy", "poly_t", "poly_f", _insight_sql("polypharmacy", "poly_t", "poly_f"),
     _shown("poly_t", "poly_f")),
    (2, "elderly", "eld_t", "eld_f", _insight_sql("elderly", "eld_t", "eld_f"), _shown("eld_t", "eld_f")),
    (3, "high_reaction", "rx_t", "rx_f", _insight_sql("high_reaction", "rx_t", "rx_f"),
     "(rx_t IS NOT NULL AND rx_f IS NOT NULL)"),
    (4, "drug_repeat", "rep_t", "rep_f", _insight_sql("drug_repeat", "rep_t", "rep_f"), "true"),
]
_INS_SQL = "\nUNION ALL\n".join(
    [f"SELECT CAST({o} AS INTEGER) AS ord, '{n}' AS insight, {t} AS rate_true, {f} AS rate_false, "
     f"{_rel(t, f)} AS relative_change, {t} - {f} AS pp_delta, cutoff AS reaction_cutoff, {txt} AS text "
     f"FROM r WHERE n > 0 AND {cond}" for o, n, t, f, txt, cond in _INS]
    + [f"SELECT CAST(5 AS INTEGER), 'overall', overall, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
       f"CAST(NULL AS DOUBLE), cutoff, {_insight_sql('overall')} FROM r WHERE n > 0"])
register("clinical_insights", O.with_ctes(_INS_SQL, {"r": _INS_ROW}))(
    lambda spark, sf: K.clinical_insights(cases(spark, sf)))

# ---------------------------------------------------------------- O-32
_SRC = ["demo", "drug", "outc", "reac"]
register("source_rows", O.with_ctes("\nUNION ALL\n".join(
    f"SELECT '{s.upper()}' AS source, count(*) AS rows FROM {s}" for s in _SRC)))(
    lambda spark, sf: K.source_rows(FX.sources(spark, sf)))
register("missing_values", O.with_ctes("\nUNION ALL\n".join(
    f"SELECT '{s.upper()}' AS source, '{c}' AS \"column\", "
    f"{O.sql_py_round(f'avg(CASE WHEN {c} IS NULL THEN {D(1)} ELSE {D(0)} END) * {H}', 2)} AS missing_pct FROM {s}"
    for s in _SRC for c in C.QUALITY_MONITORED[s.upper()])))(
    lambda spark, sf: K.missing_values(FX.sources(spark, sf)))
register("retention", O.with_ctes(f"""
SELECT count(*) AS final_rows, greatest((SELECT count(*) FROM demo) - count(*), 0) AS demo_rows_dropped,
       CASE WHEN (SELECT count(*) FROM demo) > 0
            THEN {O.sql_py_round(f'(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM demo)) * {H}', 2)}
            ELSE {D(0)} END AS retention_pct
FROM cases"""))(lambda spark, sf: K.retention(FX.demo_source(spark, sf), cases(spark, sf)))


# ---------------------------------------------------------------- O-33 / O-34 / O-35
def sql_summary(features, digits=2) -> str:
    parts = []
    for c in features:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS feature, count({v}) AS count, {RE(f'avg({v})', digits)} AS mean, "
            f"{RE(f'stddev_samp({v})', digits)} AS std, {RE(f'min({v})', digits)} AS min, "
            f"{RE(f'quantile_cont({v}, 0.25)', digits)} AS p25, {RE(f'quantile_cont({v}, 0.5)', digits)} AS p50, "
            f"{RE(f'quantile_cont({v}, 0.75)', digits)} AS p75, {RE(f'max({v})', digits)} AS max FROM cases")
    return "\nUNION ALL\n".join(parts)


register("feature_summary", O.with_ctes(sql_summary(C.SUMMARY_FEATURES)))(
    lambda spark, sf: K.feature_summary(cases(spark, sf)))

_NUM = ["primaryid", "age", "drug_count", "unique_drug_count", "drug_repeat_flag", "reaction_count",
        "serious", "polypharmacy", "elderly", "sex_code", "risk_score"]
_TXT = ["sex", "age_group", "severity_label"]


def sql_describe_all() -> str:
    parts = []
    for c in _NUM:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({v}) AS count, CAST(NULL AS BIGINT) AS \"unique\", "
            f"CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, {RE(f'avg({v})', 6)} AS mean, "
            f"{RE(f'stddev_samp({v})', 6)} AS std, min({v}) AS min, {RE(f'quantile_cont({v}, 0.25)', 6)} AS p25, "
            f"{RE(f'quantile_cont({v}, 0.5)', 6)} AS p50, {RE(f'quantile_cont({v}, 0.75)', 6)} AS p75, "
            f"max({v}) AS max FROM cases")
    for c in _TXT:
        parts.append(
            f"SELECT '{c}', CAST(sum(cnt) AS BIGINT), count(*), arg_min(value, (-cnt, value)), "
            f"max(cnt), NULL, NULL, NULL, NULL, NULL, NULL, NULL "
            f"FROM (SELECT {c} AS value, count(*) AS cnt FROM cases WHERE {c} IS NOT NULL GROUP BY 1) t")
    return O.with_ctes("\nUNION ALL\n".join(parts))


register("describe_all", sql_describe_all())(
    lambda spark, sf: r6(K.describe_all(cases(spark, sf)), ["mean", "std", "p25", "p50", "p75"]))

register("null_counts", O.with_ctes("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing_count FROM cases"
    for c in C.CASE_COLUMNS)))(lambda spark, sf: K.null_counts(cases(spark, sf)))


# ---------------------------------------------------------------- O-36 / O-37
def q_upload_quality(spark, sf):
    """Labelled upload (the case rows as a CSV-like table) -> quality report."""
    return K.upload_quality(P.prepare_labelled(cases(spark, sf)))


_UQ_COLS = C.CASE_COLUMNS
register("upload_quality", O.with_ctes("\nUNION ALL\n".join(
    f"SELECT '{C.UPLOAD_SOURCE_NAME}' AS source, '{c}' AS \"column\", "
    f"{O.sql_py_round(f'avg(CASE WHEN {c} IS NULL THEN {D(1)} ELSE {D(0)} END) * {H}', 2)} AS missing_pct, "
    f"count(*) AS final_rows, 0 AS demo_rows_dropped, {D(100.0)} AS retention_pct FROM cases"
    for c in _UQ_COLS)))(q_upload_quality)

register("missing_view", O.with_ctes(
    "SELECT * FROM (" + "\nUNION ALL\n".join(
        f"SELECT '{s.upper()}' AS source, '{c}' AS \"column\", "
        f"{O.sql_py_round(f'avg(CASE WHEN {c} IS NULL THEN {D(1)} ELSE {D(0)} END) * {H}', 2)} AS missing_pct FROM {s}"
        for s in _SRC for c in C.QUALITY_MONITORED[s.upper()])
    + ") t ORDER BY missing_pct DESC, source, \"column\" LIMIT 20"))(
    lambda spark, sf: K.missing_view(K.missing_values(FX.sources(spark, sf))))

register("preview", O.with_ctes("SELECT * FROM cases ORDER BY primaryid LIMIT 200"))(
    lambda spark, sf: K.preview(cases(spark, sf)))
