"""Classifier evaluation over a long table of scores (O-46, O-47, O-49..O-54, O-68).

Input everywhere: ``scored`` with columns ``model`` (string), ``y`` (0/1)
and ``p`` (probability of class 1). Each operator is a per-model
aggregation; global orders (curves, AUC) use the two-level ranking of
``ranking.rank_distinct``, so nothing funnels through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casekit import config as C
from casekit.functions import text as T
from casekit.operators import ranking as R
from casekit.session import ensure_checkpoint_dir


def grid_array(grid: list[float] | None = None) -> Column:
    return F.array(*[F.lit(float(t)) for t in (grid or C.threshold_grid())])


def _safe_ratio(num: Column, den: Column) -> Column:
    """num/den with 0 when den == 0 (``zero_division=0``)."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision = _safe_ratio(tp, tp + fp)
    recall = _safe_ratio(tp, tp + fn)
    # one division of integers: equal F1 values are bit-identical, so ties are exact
    f1 = _safe_ratio(2 * tp, 2 * tp + fp + fn)
    return precision, recall, f1


# ---------------------------------------------------------------- O-46
def threshold_sweep(scored: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """Precision, recall, F1 of ``p >= t`` for each grid threshold, per model.

    Each score is first binned to its grid slot (number of thresholds <= p),
    then slot totals (<= 32 per model) are suffix-summed: the work is one
    pass plus a tiny aggregation, independent of the grid size.
    """
    g = grid or C.threshold_grid()
    arr = grid_array(g)
    # spelled out: inside a lambda over the grid Spark would evaluate the model behind ``p`` once for each threshold
    slot = sum((F.when(F.col("p") >= F.lit(float(t)), 1).otherwise(0) for t in g), F.lit(0))
    counts = (scored.select("model", slot.alias("slot"), F.col("y").cast("long").alias("y"))
              .groupBy("model", "slot").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")))
    models = scored.select("model").distinct()
    full = (models.select("model", F.explode(F.sequence(F.lit(0), F.lit(len(g)))).alias("slot"))
            .join(counts, ["model", "slot"], "left")
            .select("model", "slot", F.coalesce("pos", F.lit(0)).alias("pos"),
                    F.coalesce("n", F.lit(0)).alias("n")))
    # bounded window: <= len(grid)+1 rows per model
    suffix = Window.partitionBy("model").orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy("model")
    s = full.select("model", "slot", F.sum("pos").over(suffix).alias("tp"),
                    (F.sum("n").over(suffix) - F.sum("pos").over(suffix)).alias("fp"),
                    F.sum("pos").over(tot).alias("P"))
    s = s.filter(F.col("slot") >= 1).select(
        "model", F.element_at(arr, F.col("slot")).alias("threshold"), "tp", "fp",
        (F.col("P") - F.col("tp")).alias("fn"))
    precision, recall, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select("model", "threshold", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


# ---------------------------------------------------------------- O-47
def best_threshold(sweep: DataFrame) -> DataFrame:
    """Per model: threshold of max F1, lowest threshold on ties."""
    return sweep.groupBy("model").agg(
        F.max_by("threshold", F.struct(F.col("f1"), (-F.col("threshold")).alias("neg_t"))).alias("threshold"),
        F.max("f1").alias("best_f1"))


# ---------------------------------------------------------------- curves
def _cumulative(scored: DataFrame, descending: bool) -> DataFrame:
    r = R.rank_distinct(scored.select("model", "p", F.col("y").cast("long").alias("y")), "p",
                        keys=["model"], weight_cols=["y"], ascending=not descending)
    return r


def score_ranks(scored: DataFrame) -> DataFrame:
    """Distinct scores of each model from the highest down with running totals, checkpointed: one global sort that the
    curves, the AUC and the metrics of the same scores can share (their ``ranks``)."""
    ensure_checkpoint_dir(scored.sparkSession)
    return _cumulative(scored, descending=True).checkpoint()


def roc_curve(scored: DataFrame, drop_intermediate: bool = True, ranks: DataFrame | None = None) -> DataFrame:
    """(model, fpr, tpr, threshold): starts at (0, 0, +inf), collinear points dropped."""
    r = _cumulative(scored, descending=True) if ranks is None else ranks
    pts = r.select("model", "idx", F.col("p").alias("threshold"),
                   (F.col("y_before") + F.col("y")).alias("tps"),
                   (F.col("before") + F.col("cnt") - F.col("y_before") - F.col("y")).alias("fps"))
    totals = F.broadcast(pts.groupBy("model").agg(F.max("idx").alias("last"), F.max("tps").alias("P"),
                                                  F.max("fps").alias("N")))
    pts = pts.join(totals, "model")
    if drop_intermediate:
        prv = pts.select("model", (F.col("idx") + 1).alias("idx"), F.col("tps").alias("tps_prev"),
                         F.col("fps").alias("fps_prev"))
        nxt = pts.select("model", (F.col("idx") - 1).alias("idx"), F.col("tps").alias("tps_next"),
                         F.col("fps").alias("fps_next"))
        j = pts.join(prv, ["model", "idx"], "left").join(nxt, ["model", "idx"], "left")
        d2f = F.col("fps_prev") - 2 * F.col("fps") + F.col("fps_next")
        d2t = F.col("tps_prev") - 2 * F.col("tps") + F.col("tps_next")
        keep = (F.col("last") < 2) | (F.col("idx") == 0) | (F.col("idx") == F.col("last")) | (d2f != 0) | (d2t != 0)
        pts = j.filter(keep).select(*pts.columns)
    start = totals.select("model", F.lit(-1).cast("long").alias("idx"), F.lit(float("inf")).alias("threshold"),
                          F.lit(0).cast("long").alias("tps"), F.lit(0).cast("long").alias("fps"), "P", "N")
    allp = pts.select("model", F.col("idx").cast("long").alias("idx"), "threshold",
                      F.col("tps").cast("long").alias("tps"), F.col("fps").cast("long").alias("fps"),
                      "P", "N").unionByName(start)
    return allp.select("model", F.try_divide(F.col("fps").cast("double"), F.col("N")).alias("fpr"),
                       F.try_divide(F.col("tps").cast("double"), F.col("P")).alias("tpr"), "threshold")


def pr_curve(scored: DataFrame, final_threshold: float = 1.0, ranks: DataFrame | None = None) -> DataFrame:
    """(model, precision, recall, threshold) for every distinct score, plus the final (1, 0) point."""
    r = _cumulative(scored, descending=True) if ranks is None else ranks
    pts = r.select("model", F.col("p").alias("threshold"), (F.col("y_before") + F.col("y")).alias("tps"),
                   (F.col("before") + F.col("cnt")).alias("ps"))
    P = F.broadcast(scored.groupBy("model").agg(F.sum(F.col("y").cast("long")).alias("P")))
    pts = pts.join(P, "model")
    out = pts.select("model", _safe_ratio(F.col("tps"), F.col("ps")).alias("precision"),
                     F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("tps") / F.col("P")).alias("recall"),
                     "threshold")
    final = P.select("model", F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                     F.lit(float(final_threshold)).alias("threshold"))
    return out.unionByName(final)


# ---------------------------------------------------------------- O-51
def roc_auc(scored: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Per model AUC = P(score_pos > score_neg) + 0.5 P(tie): the area under
    the full ROC step curve; null when one class is absent."""
    r = _cumulative(scored, descending=True) if ranks is None else ranks
    neg_above, neg_here = F.col("before") - F.col("y_before"), F.col("cnt") - F.col("y")
    return r.groupBy("model").agg(
        F.sum(F.col("y").cast("double") * (neg_above.cast("double") + F.lit(0.5) * neg_here.cast("double"))).alias("_lost"),
        F.sum("y").alias("_P"), F.sum(neg_here).alias("_N")).select(
        "model", F.when((F.col("_P") > 0) & (F.col("_N") > 0), ((F.col("_P") * F.col("_N")).cast("double") - F.col("_lost"))
                        / (F.col("_P") * F.col("_N")).cast("double")).alias("roc_auc"))


# ---------------------------------------------------------------- O-52
def model_metrics(scored: DataFrame, thresholds: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1, AUC, threshold, Brier per model, ranked by F1."""
    j = scored.join(F.broadcast(thresholds.select("model", "threshold")), "model")
    pred = (F.col("p") >= F.col("threshold")).cast("int")
    y = F.col("y").cast("int")
    m = j.groupBy("model", "threshold").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(((pred == 1) & (y == 1)).cast("long")).alias("tp"),
        F.sum(((pred == 1) & (y == 0)).cast("long")).alias("fp"),
        F.sum(((pred == 0) & (y == 1)).cast("long")).alias("fn"),
        F.sum((pred == y).cast("long")).alias("correct"),
        F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier_score"))
    precision, recall, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    m = m.join(roc_auc(scored, ranks), "model", "left").select(
        "model", (F.col("correct") / F.col("n")).alias("accuracy"), precision.alias("precision"),
        recall.alias("recall"), f1.alias("f1"), "roc_auc", "threshold", "brier_score")
    # <= one row per model: a bounded window
    return m.withColumn("rank", F.row_number().over(Window.orderBy(F.col("f1").desc(), F.col("model"))))


# ---------------------------------------------------------------- O-53
def confusion_matrix(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    j = scored.join(F.broadcast(thresholds.select("model", "threshold")), "model")
    counts = j.groupBy("model", F.col("y").cast("int").alias("actual"),
                       (F.col("p") >= F.col("threshold")).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))
    cells = (thresholds.select("model").distinct()
             .select("model", F.explode(F.array(F.lit(0), F.lit(1))).alias("actual"))
             .select("model", "actual", F.explode(F.array(F.lit(0), F.lit(1))).alias("predicted")))
    return cells.join(counts, ["model", "actual", "predicted"], "left").select(
        "model", "actual", "predicted", F.coalesce("count", F.lit(0)).alias("count"))


# ---------------------------------------------------------------- O-54
def calibration_curve(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    """Uniform bins on [0, 1]; bin = number of inner edges strictly below p; empty bins dropped."""
    edges = [k * (1.0 / n_bins) for k in range(1, n_bins)]
    b = F.aggregate(F.array(*[F.lit(e) for e in edges]), F.lit(0),
                    lambda acc, e: acc + F.when(F.col("p") > e, 1).otherwise(0))
    return scored.groupBy("model", b.alias("bin")).agg(
        F.avg("p").alias("mean_predicted"), F.avg(F.col("y").cast("double")).alias("fraction_positive"),
        F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- O-68
def model_digest(metrics: DataFrame, low_threshold: float = 0.35) -> DataFrame:
    """Plain-language comparison: best model per metric (first on ties) and low thresholds."""
    order = (-F.col("rank")).alias("neg_rank")

    def best(metric: str) -> list[Column]:
        return [F.max_by("model", F.struct(F.col(metric), order)).alias(f"{metric}_model"),
                F.max_by(F.col(metric), F.struct(F.col(metric), order)).alias(f"{metric}_value")]
    row = metrics.agg(*best("f1"), *best("recall"), *best("precision"), *best("roc_auc"),
                      F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
                          F.col("threshold") < low_threshold, F.struct("rank", "model")))), lambda x: x["model"]),
                          ", ").alias("low"))

    def item(ord_: int, kind: str, model: Column, text: Column) -> Column:
        return F.struct(F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), model.alias("model"),
                        text.alias("text"))
    items = F.array(*[
        item(i + 1, k, F.col(f"{k}_model"),
             T.render(C.MODEL_DIGEST[k], model=F.col(f"{k}_model"), value=F.col(f"{k}_value")))
        for i, k in enumerate(["f1", "recall", "precision", "roc_auc"])],
        item(5, "low_threshold", F.lit(None).cast("string"),
             F.when(F.col("low") != "", T.render(C.MODEL_DIGEST["low_threshold"], models=F.col("low")))))
    return (row.select(F.explode(items).alias("e")).select("e.*").filter(F.col("text").isNotNull()))
