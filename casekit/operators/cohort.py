"""Cohort analytics over the case table (O-17..O-37).

Every operator is one or two aggregation passes. Statistics over several
columns are computed in *long form*: one ``explode`` of (feature, value)
pairs and one ``groupBy(feature)``, so the case table is scanned once and
shuffled once, with partial (map-side) aggregation.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit import config as C
from casekit.functions import columns as X
from casekit.functions import text as T
from casekit.operators import ranking as R


def _pct(c: Column) -> Column:
    return c * F.lit(100.0)


def _avg_if(cond: Column, value: str | Column) -> Column:
    v = X.col_(value)
    return F.avg(F.when(cond, v))


def long_form(df: DataFrame, cols: list[str], name: str = "feature",
              value: str = "value", cast: str = "double", keep: list[str] | None = None) -> DataFrame:
    """Unpivot ``cols`` into (keep..., name, value) rows with one generator."""
    keep = keep or []
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast(cast).alias(value))
                                for c in cols])).alias("_kv")
    return df.select(*keep, pairs).select(*keep, f"_kv.{name}", f"_kv.{value}")


# ---------------------------------------------------------------- O-17
def key_metrics(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count(F.lit(1)).alias("total_records"),
                     F.avg("age").alias("avg_age"),
                     F.avg("drug_count").alias("avg_drug_count"),
                     _pct(F.avg("serious")).alias("serious_pct"))


# ---------------------------------------------------------------- O-18
def executive_summary(cases: DataFrame) -> DataFrame:
    """Means default to 0 on an empty cohort, medians stay null."""
    return cases.agg(
        _pct(F.coalesce(F.avg("serious"), F.lit(0.0))).alias("serious_pct"),
        F.median("age").alias("median_age"),
        F.median("drug_count").alias("median_drug_count"),
        _pct(F.coalesce(F.avg("polypharmacy"), F.lit(0.0))).alias("polypharmacy_pct"),
        _pct(F.coalesce(F.avg("elderly"), F.lit(0.0))).alias("elderly_pct"),
        F.count(F.lit(1)).alias("cases"))


# ---------------------------------------------------------------- O-19
def final_stats(cases: DataFrame) -> DataFrame:
    """Rates of empty sub-cohorts are null (no guard, like the reference's NaN)."""
    return cases.agg(
        _pct(F.avg("serious")).alias("overall_rate"),
        _pct(_avg_if(F.col("elderly") == 1, "serious")).alias("elderly_rate"),
        _pct(_avg_if(F.col("polypharmacy") == 1, "serious")).alias("poly_rate"),
        F.median("age").alias("median_age"),
        F.median("drug_count").alias("median_drug"))


# ---------------------------------------------------------------- O-20
def risk_deltas(cases: DataFrame) -> DataFrame:
    """Percentage-point deltas; an empty side counts as 0."""
    def safe(cond, value):
        return F.coalesce(_avg_if(cond, value), F.lit(0.0))
    s = F.col("serious")
    return cases.agg(
        (_pct(safe(F.col("elderly") == 1, s)) - _pct(safe(F.col("elderly") == 0, s)))
        .alias("elderly_risk_delta"),
        (_pct(safe(F.col("polypharmacy") == 1, s)) - _pct(safe(F.col("polypharmacy") == 0, s)))
        .alias("polypharmacy_risk_delta"),
        (safe(s == 1, "drug_count") - safe(s == 0, "drug_count")).alias("drug_count_gap"))


# ---------------------------------------------------------------- O-21
def top_risk_segments(cases: DataFrame, top_n: int = 10) -> DataFrame:
    """age band x sex x polypharmacy, all 7 bands even when empty; top rates first.

    The grid is the product of the 7 bands with the *observed* sexes and
    flags; it is generated from one aggregate row (``explode`` of bounded
    arrays: <= 7 x 2 x 2 rows), not with a join.
    """
    grouped = cases.groupBy("age_group", "sex", "polypharmacy").agg(
        F.count("primaryid").alias("cases"), F.avg("serious").alias("serious_rate"))
    grid = (cases.agg(F.array_sort(F.collect_set("sex")).alias("sexes"),
                      F.array_sort(F.collect_set("polypharmacy")).alias("polys"))
            .select(F.posexplode(F.array(*[F.lit(g) for g in C.AGE_LABELS])).alias("age_ord", "age_group"),
                    "sexes", "polys")
            .select("age_ord", "age_group", F.explode("sexes").alias("sex"), "polys")
            .select("age_ord", "age_group", "sex", F.explode("polys").alias("polypharmacy")))
    t = (grid.join(grouped, ["age_group", "sex", "polypharmacy"], "left")
         .select("age_ord", "age_group", "sex", "polypharmacy",
                 F.coalesce(F.col("cases"), F.lit(0)).alias("cases"),
                 X.rint_round(_pct(F.col("serious_rate")), 1).alias("serious_rate_pct")))
    t = t.orderBy(F.col("serious_rate_pct").desc_nulls_last(), F.col("cases").desc(),
                  "age_ord", "sex", "polypharmacy").limit(top_n)
    return t.select("age_group", "sex", X.yes_no("polypharmacy").alias("polypharmacy"),
                    "cases", "serious_rate_pct")


# ---------------------------------------------------------------- O-22
def severity_stats(cases: DataFrame) -> DataFrame:
    return cases.groupBy("severity_label").agg(
        F.count("primaryid").alias("cases"),
        F.median("age").alias("median_age"),
        X.rint_round(F.avg("drug_count"), 2).alias("avg_drug_count"),
        X.rint_round(F.avg("reaction_count"), 2).alias("avg_reaction_count"),
        X.rint_round(_pct(F.avg("serious")), 2).alias("serious_rate"))


# ---------------------------------------------------------------- O-23
def value_counts(cases: DataFrame) -> DataFrame:
    """Counts of sex, polypharmacy (Yes/No) and severity in one pass."""
    dims = F.explode(F.array(
        F.struct(F.lit("sex").alias("dimension"), F.col("sex").alias("value")),
        F.struct(F.lit("polypharmacy").alias("dimension"), X.yes_no("polypharmacy").alias("value")),
        F.struct(F.lit("severity").alias("dimension"), F.col("severity_label").alias("value"))))
    return (cases.select(dims.alias("d")).select("d.dimension", "d.value")
            .filter(F.col("value").isNotNull())
            .groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("count")))


# ---------------------------------------------------------------- O-24
HIST_BINS = 30


def histogram(df: DataFrame, col: str, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed, empty bins kept.

    Bin edges and the index rule follow NumPy's uniform-bin path (scaled
    index, then a one-step correction against the edge values), so every
    value lands in the same bin as in the reference. The rule is staged in
    separate projections so each edge is computed once per row.
    """
    v = F.col(col).cast("double")
    valid = df.filter(v.isNotNull() & ~F.isnan(v))
    lo0 = valid.select(F.min(v)).scalar()
    hi0 = valid.select(F.max(v)).scalar()

    def bounds(frame: DataFrame) -> DataFrame:
        return (frame.withColumns({"_lo0": lo0, "_hi0": hi0})
                .withColumns({"_lo": F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5)
                                      .otherwise(F.col("_lo0")),
                              "_hi": F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5)
                                      .otherwise(F.col("_hi0"))})
                .withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))))

    def edge(i: Column) -> Column:
        return F.when(i >= F.lit(bins), F.col("_hi")).otherwise(i.cast("double") * F.col("_step") + F.col("_lo"))

    x = bounds(valid.select(v.alias("_v")))
    lo, step = F.col("_lo"), F.col("_step")
    raw = (((F.col("_v") - lo) / (F.col("_hi") - lo)) * F.lit(float(bins))).cast("int")
    # raw <= bins; only v == max gives bins, which belongs to the last bin
    x = x.withColumn("_i0", F.least(raw, F.lit(bins - 1)))
    # below its left edge -> one bin down (edges below the last are i * step + lo)
    x = x.withColumn("_i1", F.col("_i0") - (F.col("_v") < F.col("_i0").cast("double") * step + lo).cast("int"))
    # at or past the next edge (except in the last, closed bin) -> one bin up
    up = (F.col("_v") >= (F.col("_i1") + 1).cast("double") * step + lo) & (F.col("_i1") != F.lit(bins - 1))
    x = x.withColumn("bin", F.col("_i1") + up.cast("int"))
    counts = x.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = bounds(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")))
    grid = grid.select("bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"))
    return (grid.join(counts, "bin", "left")
            .select("bin", "bin_start", "bin_end", F.coalesce(F.col("count"), F.lit(0)).alias("count")))


# ---------------------------------------------------------------- O-25
KDE_GRID = 200


def kde(df: DataFrame, col: str, bins: int = HIST_BINS, gridsize: int = KDE_GRID) -> DataFrame:
    """Gaussian KDE (Scott bandwidth) on ``gridsize`` points min..max, in histogram counts.

    count(x) = n * binwidth * density(x). Values are first collapsed to
    (value, multiplicity); each distinct value then emits its contribution to
    every grid point with a generator and a partial aggregation sums them, so
    work is distinct values x grid points, spread over tasks. A constant column
    (or a single value) has no bandwidth and gives no curve.
    """
    v = F.col(col).cast("double")
    vals = df.filter(v.isNotNull() & ~F.isnan(v)).select(v.alias("x"))
    n = vals.select(F.count(F.lit(1)).cast("double")).scalar()
    sd = vals.select(F.stddev_samp("x")).scalar()
    lo = vals.select(F.min("x")).scalar()
    hi = vals.select(F.max("x")).scalar()
    h = F.nullif(sd * F.pow(n, F.lit(-0.2)), F.lit(0.0))
    binwidth = (hi - lo) / F.lit(float(bins))
    gstep = (hi - lo) / F.lit(float(gridsize - 1))
    distinct = vals.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("m"))
    j = F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("point")
    contrib = distinct.select("x", "m", j)
    gx = F.when(F.col("point") == gridsize - 1, hi).otherwise(F.col("point").cast("double") * gstep + lo)
    z = (gx - F.col("x")) / h
    out = (contrib.select("point", gx.alias("x_grid"), (F.col("m") * F.exp(-0.5 * z * z)).alias("k"))
           .groupBy("point", "x_grid").agg(F.sum("k").alias("ksum")))
    scale = binwidth / (h * F.lit((2.0 * 3.141592653589793) ** 0.5))
    return out.select(F.col("point").cast("int").alias("point"), "x_grid",
                      (F.col("ksum") * scale).alias("count_density")).filter(F.col("count_density").isNotNull())


# ---------------------------------------------------------------- O-26 / O-26b
BOX_FEATURES = ["age", "drug_count"]


def _box_frame(cases: DataFrame, group: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    lf = long_form(cases, features, keep=["primaryid", group])
    q = lf.groupBy(group, "feature").agg(
        F.percentile("value", [0.25, 0.5, 0.75]).alias("_q"))
    q = q.select(group, "feature", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3"))
    q = q.withColumns({"lo_fence": F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1")),
                       "hi_fence": F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))})
    # groups x features is bounded (2 severity labels x 2 features): broadcast
    return lf, F.broadcast(q)


def box_stats(cases: DataFrame, group: str = "severity_label",
              features: list[str] | None = None) -> DataFrame:
    """Quartiles, whiskers at the furthest point inside 1.5 IQR, outlier count."""
    features = features or BOX_FEATURES
    lf, q = _box_frame(cases, group, features)
    j = lf.join(q, [group, "feature"])
    w = j.groupBy(group, "feature", "q1", "median", "q3").agg(
        F.min(F.when(F.col("value") >= F.col("lo_fence"), F.col("value"))).alias("whisker_low"),
        F.max(F.when(F.col("value") <= F.col("hi_fence"), F.col("value"))).alias("whisker_high"),
        F.count(F.lit(1)).alias("n"))
    w = w.withColumns({"whisker_low": F.coalesce("whisker_low", "q1"),
                       "whisker_high": F.coalesce("whisker_high", "q3")})
    outl = (j.join(w.select(group, "feature", "whisker_low", "whisker_high"), [group, "feature"])
            .groupBy(group, "feature").agg(F.count_if((F.col("value") < F.col("whisker_low"))
                                                      | (F.col("value") > F.col("whisker_high"))).alias("outliers")))
    return w.join(outl, [group, "feature"]).select(
        group, "feature", "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")


def outlier_rows(cases: DataFrame, group: str = "severity_label",
                 features: list[str] | None = None) -> DataFrame:
    """The individual points beyond the whiskers (drawn one by one)."""
    features = features or BOX_FEATURES
    lf, q = _box_frame(cases, group, features)
    j = lf.join(q, [group, "feature"])
    wh = F.broadcast(j.groupBy(group, "feature", "q1", "q3").agg(
        F.min(F.when(F.col("value") >= F.col("lo_fence"), F.col("value"))).alias("wl"),
        F.max(F.when(F.col("value") <= F.col("hi_fence"), F.col("value"))).alias("wh"))
        .select(group, "feature", F.coalesce("wl", "q1").alias("wl"), F.coalesce("wh", "q3").alias("wh")))
    return (lf.join(wh, [group, "feature"])
            .filter((F.col("value") < F.col("wl")) | (F.col("value") > F.col("wh")))
            .select("primaryid", group, "feature", "value"))


# ---------------------------------------------------------------- O-27
def severity_means(cases: DataFrame) -> DataFrame:
    s = F.col("serious")
    return cases.agg(_avg_if(s == 1, "age").alias("avg_age_serious"),
                     _avg_if(s == 0, "age").alias("avg_age_non_serious"),
                     _avg_if(s == 1, "drug_count").alias("avg_drug_serious"),
                     _avg_if(s == 0, "drug_count").alias("avg_drug_non_serious"))


# ---------------------------------------------------------------- O-28
def sex_severity_pivot(cases: DataFrame) -> DataFrame:
    return (cases.groupBy("sex").pivot("severity_label", ["Non-serious", "Serious"])
            .agg(F.count(F.lit(1))).fillna(0, subset=["Non-serious", "Serious"]))


# ---------------------------------------------------------------- O-29
def serious_by_sex(cases: DataFrame) -> DataFrame:
    return cases.groupBy("sex").agg(X.rint_round(_pct(F.avg("serious")), 1).alias("serious_pct"))


# ---------------------------------------------------------------- O-30
def correlation_matrix(cases: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson matrix in long form (row, col, corr); constant columns give null.

    One aggregate row holds every pair's covariance and each column's std
    (``try_divide`` keeps ANSI mode from failing on zero variance); the
    matrix is then unfolded with a generator, mirrored, diagonal added.
    """
    cols = cols or C.CORRELATION_COLS
    names = {c: ("sex" if c == "sex_code" else c) for c in cols}
    aggs = [F.stddev_pop(F.col(c).cast("double")).alias(f"sd__{c}") for c in cols]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs += [F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"cv__{a}__{b}")
             for a, b in pairs]
    row = cases.agg(*aggs)
    entries = []
    for a, b in pairs:
        r = F.try_divide(F.col(f"cv__{a}__{b}"), F.col(f"sd__{a}") * F.col(f"sd__{b}"))
        entries.append(F.struct(F.lit(names[a]).alias("row"), F.lit(names[b]).alias("col"), r.alias("corr")))
        entries.append(F.struct(F.lit(names[b]).alias("row"), F.lit(names[a]).alias("col"), r.alias("corr")))
    for c in cols:
        one = F.when(F.col(f"sd__{c}") > 0, F.lit(1.0))
        entries.append(F.struct(F.lit(names[c]).alias("row"), F.lit(names[c]).alias("col"), one.alias("corr")))
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.row", "e.col", "e.corr")


# ---------------------------------------------------------------- O-31
UNDEFINED_PHRASE = C.UNDEFINED_RELATIVE_PHRASE


def _rel_phrase(t: Column, f: Column) -> Column:
    rel = ((t - f) / f) * F.lit(100.0)
    return F.when(f <= 0, F.lit(UNDEFINED_PHRASE)).otherwise(T.render(C.RELATIVE_PHRASE, rel=rel))


def clinical_insights(cases: DataFrame) -> DataFrame:
    """The five cohort insights as rows: numbers plus the sentence.

    q75 of reaction counts is a scalar subquery; all rates come from one
    aggregate row. Rates of an empty side are null and the sentence is
    then null too (the reference prints 'nan').
    """
    s = F.col("serious")
    q75 = cases.select(F.percentile("reaction_count", 0.75)).scalar()
    cutoff = F.greatest(F.lit(3.0), q75)
    rc = F.col("reaction_count").cast("double")
    row = cases.agg(
        _pct(F.avg(s)).alias("overall"),
        _pct(_avg_if(F.col("polypharmacy") == 1, s)).alias("poly_t"),
        _pct(_avg_if(F.col("polypharmacy") == 0, s)).alias("poly_f"),
        _pct(_avg_if(F.col("elderly") == 1, s)).alias("eld_t"),
        _pct(_avg_if(F.col("elderly") == 0, s)).alias("eld_f"),
        _pct(_avg_if(rc >= cutoff, s)).alias("rx_t"),
        _pct(_avg_if(rc < cutoff, s)).alias("rx_f"),
        _pct(_avg_if(F.col("drug_repeat_flag") == 1, s)).alias("rep_t"),
        _pct(_avg_if(F.col("drug_repeat_flag") == 0, s)).alias("rep_f"),
        _pct(F.avg("drug_repeat_flag").cast("double")).alias("rep_share"),
        F.count(F.lit(1)).alias("n")).withColumn("cutoff", cutoff)

    def text(name: str, t: str | None, f: str | None) -> Column:
        fields = {"overall": F.col("overall"), "cutoff": F.col("cutoff"), "share": F.col("rep_share")}
        if t:
            fields.update(rate_true=F.col(t), rate_false=F.col(f), delta=F.col(t) - F.col(f),
                          phrase=_rel_phrase(F.col(t), F.col(f)))
        needed = {fld for _, fld, _, _ in string.Formatter().parse(C.CLINICAL_INSIGHTS[name]) if fld}
        return T.render(C.CLINICAL_INSIGHTS[name], **{k: v for k, v in fields.items() if k in needed})

    def rel(t: str, f: str) -> Column:
        return F.when(F.col(f) > 0, ((F.col(t) - F.col(f)) / F.col(f)) * F.lit(100.0))

    def entry(order, name, t, f, present):
        return F.struct(F.lit(order).alias("ord"), F.lit(name).alias("insight"),
                        F.col(t).alias("rate_true") if t else F.lit(None).cast("double").alias("rate_true"),
                        F.col(f).alias("rate_false") if f else F.lit(None).cast("double").alias("rate_false"),
                        (rel(t, f) if t else F.lit(None).cast("double")).alias("relative_change"),
                        ((F.col(t) - F.col(f)) if t else F.lit(None).cast("double")).alias("pp_delta"),
                        text(name, t, f).alias("text"), present.alias("present"))

    def shown(t, f):
        # the reference prints a pair when either rate is nonzero (NaN counts as nonzero)
        return F.coalesce(F.col(t) != 0, F.lit(True)) | F.coalesce(F.col(f) != 0, F.lit(True))

    rows = F.array(
        entry(1, "polypharmacy", "poly_t", "poly_f", shown("poly_t", "poly_f")),
        entry(2, "elderly", "eld_t", "eld_f", shown("eld_t", "eld_f")),
        entry(3, "high_reaction", "rx_t", "rx_f", F.col("rx_t").isNotNull() & F.col("rx_f").isNotNull()),
        entry(4, "drug_repeat", "rep_t", "rep_f", F.lit(True)),
        entry(5, "overall", None, None, F.lit(True)))
    out = row.filter(F.col("n") > 0).select(F.explode(rows).alias("e"), "overall", "cutoff").select(
        "e.ord", "e.insight", "e.rate_true", "e.rate_false", "e.relative_change", "e.pp_delta",
        "e.text", "e.present", "overall", "cutoff")
    out = out.withColumn("rate_true", F.when(F.col("insight") == "overall", F.col("overall"))
                         .otherwise(F.col("rate_true")))
    return out.filter("present").select(
        F.col("ord").cast("int").alias("ord"), "insight", "rate_true", "rate_false",
        "relative_change", "pp_delta", F.col("cutoff").alias("reaction_cutoff"), "text")


# ---------------------------------------------------------------- O-32
def source_rows(sources: dict[str, DataFrame]) -> DataFrame:
    frames = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name.upper()).alias("source"), "rows")
              for name, df in sources.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def missing_values(sources: dict[str, DataFrame]) -> DataFrame:
    """Missing % per monitored column of each source (one pass per source)."""
    frames = []
    for name, df in sources.items():
        src = name.upper()
        cols = [c for c in C.QUALITY_MONITORED[src] if c in df.columns]
        if not cols:
            continue
        row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
        kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("m")) for c in cols]))
        frames.append(row.select(kv.alias("e")).select(
            F.lit(src).alias("source"), "e.column",
            X.py_round(_pct(F.coalesce(F.col("e.m"), F.lit(float("nan")))), 2).alias("missing_pct")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def retention(demo: DataFrame, cases: DataFrame) -> DataFrame:
    """Final rows, DEMO rows dropped (never negative), retention % (0 for empty DEMO)."""
    n_demo = demo.select(F.count(F.lit(1))).scalar()
    # the DEMO count is projected before the rounding (a subquery may not sit in a lambda)
    return cases.agg(F.count(F.lit(1)).alias("final_rows")).withColumn("_n_demo", n_demo).select(
        "final_rows",
        F.greatest(F.col("_n_demo") - F.col("final_rows"), F.lit(0)).alias("demo_rows_dropped"),
        F.when(F.col("_n_demo") > 0, X.py_round(_pct(F.col("final_rows") / F.col("_n_demo")), 2))
         .otherwise(F.lit(0.0)).alias("retention_pct"))


# ---------------------------------------------------------------- O-33
def feature_summary(cases: DataFrame, features: list[str] | None = None,
                    digits: int | None = 2) -> DataFrame:
    """``describe()``: count, mean, std (ddof 1), min, quartiles, max per feature."""
    features = features or C.SUMMARY_FEATURES
    lf = long_form(cases, features)
    s = (lf.filter(F.col("value").isNotNull()).groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.percentile("value", [0.25, 0.5, 0.75]).alias("_q"), F.max("value").alias("max")))
    s = s.select("feature", "count", "mean", "std", "min", F.col("_q")[0].alias("p25"),
                 F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max")
    if digits is not None:
        s = s.select("feature", "count", *[X.rint_round(c, digits).alias(c)
                                            for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])
    return s


# ---------------------------------------------------------------- O-34
def describe_all(cases: DataFrame, high_cardinality: tuple[str, ...] = ("primaryid",)) -> DataFrame:
    """``describe(include='all')`` in long form: numeric stats or unique/top/freq.

    Quartiles of bounded-cardinality columns use the exact ``percentile``
    aggregate; id-like columns (``high_cardinality``) go through the
    distributed exact quantile of ``ranking`` so no task holds all ids.
    """
    types = dict(cases.dtypes)
    num = [c for c, t in types.items() if t not in ("string",)]
    txt = [c for c, t in types.items() if t == "string"]
    small = [c for c in num if c not in high_cardinality]
    big = [c for c in num if c in high_cardinality]

    lf = long_form(cases, num, name="column")
    base = lf.filter(F.col("value").isNotNull()).groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    qs = []
    if small:
        qs.append(long_form(cases, small, name="column").filter(F.col("value").isNotNull())
                  .groupBy("column").agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("_q"))
                  .select("column", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
                          F.col("_q")[2].alias("p75")))
    for c in big:
        q = R.exact_quantiles(cases.select(F.col(c).cast("double").alias("v")), "v", [0.25, 0.5, 0.75])
        qs.append(q.select(F.lit(c).alias("column"), F.col("q")[0].alias("p25"),
                           F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75")))
    qall = qs[0]
    for q in qs[1:]:
        qall = qall.unionByName(q)
    numeric = base.join(qall, "column").select(
        "column", "count", F.lit(None).cast("bigint").alias("unique"), F.lit(None).cast("string").alias("top"),
        F.lit(None).cast("bigint").alias("freq"), "mean", "std", "min", "p25", "p50", "p75", "max")
    if not txt:
        return numeric
    tl = long_form(cases, txt, name="column", cast="string").filter(F.col("value").isNotNull())
    vc = tl.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    top = vc.groupBy("column").agg(
        F.sum("cnt").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("cnt")).alias("negcnt"), F.col("value"))).alias("_t"))
    text = top.select("column", "count", "unique", F.col("_t.value").alias("top"),
                      (-F.col("_t.negcnt")).alias("freq"),
                      *[F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])
    return numeric.unionByName(text)


# ---------------------------------------------------------------- O-35
def null_counts(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_count"))
                             for c in df.columns]))
    return row.select(kv.alias("e")).select("e.column", "e.missing_count")


# ---------------------------------------------------------------- O-36
def upload_quality(processed: DataFrame) -> DataFrame:
    """Missing % of every column of an uploaded table, plus row count and retention."""
    row = processed.agg(F.count(F.lit(1)).alias("_n"),
                        *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in processed.columns])
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("m"))
                             for c in processed.columns]))
    return row.select("_n", kv.alias("e")).select(
        F.lit(C.UPLOAD_SOURCE_NAME).alias("source"), "e.column",
        X.py_round(_pct(F.col("e.m")), 2).alias("missing_pct"),
        F.col("_n").alias("final_rows"), F.lit(0).alias("demo_rows_dropped"),
        F.lit(100.0).alias("retention_pct"))


# ---------------------------------------------------------------- O-37
def missing_view(missing: DataFrame, n: int = 20) -> DataFrame:
    """Missing-value rows by missing % descending, first ``n`` (key tie-break)."""
    return missing.orderBy(F.col("missing_pct").desc(), "source", "column").limit(n)


def preview(cases: DataFrame, n: int = 200) -> DataFrame:
    """First ``n`` rows in a declared order (Spark tables have no row order)."""
    return cases.orderBy("primaryid").limit(n)
