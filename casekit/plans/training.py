"""End-to-end model pipeline: case table -> trained, tuned, evaluated champion.

Stages (each distributed; the driver holds fitted parameters, <= 32-row
sweeps and one-row summaries only):

1. model frame (null drop, class guard), optional stratified cap;
2. stratified 70/15/15 split, stored (a folder for each part; reused by every
   fit; it lives in the cluster's ``spark.checkpoint.dir`` so a lost
   executor does not recompute the lineage);
3. scaler fitted on train; class weights;
4. per candidate: fit on train, sweep thresholds on validation, pick the
   best, refit on train+validation, score test;
5. metrics, curves, calibration, imbalance comparison, importances,
   clustering + PCA, statistical tests, mutual information.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit import config as C
from casekit.operators import evaluate as E
from casekit.operators import models as M
from casekit.operators import neighbours as NB
from casekit.operators import sampling as S
from casekit.operators import stats_tests as T
from casekit.session import ensure_checkpoint_dir


@dataclass
class TrainingResult:
    split: DataFrame
    scaler: M.Standardizer
    thresholds: DataFrame
    test_scores: DataFrame
    eval_df: DataFrame
    threshold_analysis: DataFrame
    models: dict = field(default_factory=dict)
    best_model_name: str = ""
    best_threshold: float = 0.5
    extras: dict = field(default_factory=dict)

    @property
    def best_model(self):
        return self.models[self.best_model_name]


def _lineage_cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet under the cluster's checkpoint folder and read again: later passes read the columns they use
    and, with ``by``, the folders of its values they ask for."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/casekit-cut/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def prepare_split(cases: DataFrame, max_rows: int | None = None, seed: int = C.RANDOM_STATE) -> DataFrame:
    ml = S.model_frame(cases)
    S.require_two_classes(ml)
    if max_rows is not None:
        ml = S.stratified_sample(ml, max_rows, seed=seed)
    return _lineage_cut(S.split_assign(ml, seed=seed), "split")


def train_candidates(split: DataFrame, settings: M.ModelSettings | None = None, balanced: bool = True,
                     names: list[str] | None = None, parallelism: int = 4) -> TrainingResult:
    """Stages 3-4 for the chosen candidates (default: all four)."""
    settings = settings or M.ModelSettings()
    train = split.filter(F.col("split") == "train")
    val = split.filter(F.col("split") == "validation")
    test = split.filter(F.col("split") == "test")
    trainval = split.filter(F.col("split") != "test")
    scaler = M.Standardizer.fit(train)
    # each fit is weighted by the classes of its own rows; validation and test need no weights
    weights, refit_weights = S.class_weights(train), S.class_weights(trainval)
    n_train = train.count()
    n_trainval = trainval.count()

    # read by every pass of four fits; released below
    train_s = scaler.transform(S.with_weights(train, weights)).persist(StorageLevel.MEMORY_AND_DISK)
    trainval_s = scaler.transform(S.with_weights(trainval, refit_weights)).persist(StorageLevel.MEMORY_AND_DISK)
    val_s, test_s = scaler.transform(val), scaler.transform(test)
    est = M.build_estimators(settings, balanced=balanced, n_train=n_train)
    est_refit = M.build_estimators(settings, balanced=balanced, n_train=n_trainval)
    names = names or list(est)

    def run_one(name: str):
        model = est[name].fit(train_s)
        val_scores = M.positive_probability(model, val_s, ["serious"]).select(
            F.lit(name).alias("model"), F.col("serious").alias("y"), "p")
        sweep = E.threshold_sweep(val_scores)
        best = E.best_threshold(sweep).first()
        thr = float(best["threshold"]) if best is not None else 0.5
        refit = est_refit[name].fit(trainval_s)
        scored = M.positive_probability(refit, test_s, ["primaryid", "serious"]).select(
            F.lit(name).alias("model"), "primaryid", F.col("serious").alias("y"), "p")
        return name, thr, sweep, refit, scored

    # candidates are independent: their (small, iterative) jobs run concurrently
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(names)))) as pool:
        done = list(pool.map(run_one, names))
    sweeps, thresholds, scores, fitted = [], [], [], {}
    for name, thr, sweep, refit, scored in done:
        fitted[name] = refit
        thresholds.append((name, thr))
        sweeps.append(sweep)
        scores.append(scored)
    spark = split.sparkSession
    thr_df = spark.createDataFrame(thresholds, "model string, threshold double")
    test_scores = scores[0]
    for s in scores[1:]:
        test_scores = test_scores.unionByName(s)
    test_scores = _lineage_cut(test_scores)
    train_s.unpersist()
    trainval_s.unpersist()
    sweep_all = sweeps[0]
    for s in sweeps[1:]:
        sweep_all = sweep_all.unionByName(s)
    ranks = E.score_ranks(test_scores)
    eval_df = E.model_metrics(test_scores, thr_df, ranks).withColumn(
        "class_weight", F.when(F.lit(balanced) & (F.col("model") != "ANN (MLPClassifier)"), F.lit("balanced"))
        .otherwise(F.lit("none")))
    top = eval_df.orderBy("rank").first()
    result = TrainingResult(split=split, scaler=scaler, thresholds=thr_df, test_scores=test_scores,
                            eval_df=eval_df, threshold_analysis=E.threshold_sweep(test_scores), models=fitted,
                            best_model_name=top["model"], best_threshold=float(top["threshold"]))
    result.extras.update({"weights": weights, "test_scaled": test_s, "trainval_scaled": trainval_s,
                          "settings": settings, "validation_sweep": sweep_all, "score_ranks": ranks})
    return result


def imbalance_comparison(result: TrainingResult) -> DataFrame:
    """O-55: each weighted non-network model against its unweighted refit at the same threshold."""
    settings = result.extras["settings"]
    tv, test_s = result.extras["trainval_scaled"], result.extras["test_scaled"]
    plain = M.build_estimators(settings, balanced=False, n_train=tv.count())
    names = [n for n, _ in result.thresholds.collect() if n != "ANN (MLPClassifier)" and n in result.models]

    def unweighted(name: str):
        return name, plain[name].fit(tv)

    with ThreadPoolExecutor(max_workers=max(1, len(names))) as pool:
        bases = dict(pool.map(unweighted, names))
    # all models and settings as one table, so that their scores are ranked by one sort
    both = [(n, "unweighted") for n in names] + [(n, "class_weight=balanced") for n in names]
    frames = [M.positive_probability(bases[n], test_s, ["primaryid", "serious"]).select(
        F.lit(f"{n}|unweighted").alias("model"), "primaryid", F.col("serious").alias("y"), "p") for n in names]
    frames.append(result.test_scores.where(F.col("model").isin(names)).withColumn("model", F.concat("model", F.lit("|class_weight=balanced"))).select(
        "model", "primaryid", "y", "p"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    cuts = {r["model"]: r["threshold"] for r in result.thresholds.collect()}
    t = result.split.sparkSession.createDataFrame([(f"{n}|{s}", cuts[n]) for n, s in both], "model string, threshold double")
    m = E.model_metrics(_lineage_cut(out), t)
    name = F.split("model", "\\|")
    return m.select(name[0].alias("model"), name[1].alias("setting"), "threshold", "precision", "recall", "f1", "roc_auc")


def importance_tables(result: TrainingResult, permutation: bool = True) -> dict:
    """O-56 / O-57: native importance of the champion (else the forest) and permutation importance."""
    out = {}
    tree_names = ["Decision Tree", "Random Forest"]
    name = result.best_model_name if result.best_model_name in tree_names else "Random Forest"
    if name not in result.models:
        name = next((n for n in tree_names if n in result.models), None)
    if name is None:
        return out
    out["tree_feature_importance"] = M.tree_importance(result.models[name], name)
    if permutation:
        test = result.split.filter(F.col("split") == "test")
        out["model_explainability"] = M.permutation_importance(result.models[name], name, test, result.scaler)
    return out


def clustering(ml: DataFrame, train: DataFrame, restarts: int = 10) -> dict:
    """O-43 / O-59..O-61: k-means on the fully scaled set, PCA fitted on train."""
    scaler_all = M.Standardizer.fit(ml)
    all_s = scaler_all.transform(ml)
    km = M.kmeans_best(all_s, restarts=restarts)
    clustered = km.transform(all_s)
    pca_model, pca_table = M.pca_fit(M.Standardizer.fit(train).transform(train))
    viz = M.pca_project(pca_model, clustered, ["primaryid", "serious", "cluster", "age", "drug_count"])
    return {"clustered": clustered, "cluster_summary": M.cluster_summary(clustered),
            "silhouette": M.silhouette(clustered), "pca_variance": pca_table, "cluster_viz": viz}


def run_training(cases: DataFrame, settings: M.ModelSettings | None = None, max_rows: int | None = None,
                 permutation: bool = True, clusters: bool = True) -> TrainingResult:
    """The whole pipeline (the reference's cap is ``max_rows=70000``; default: no cap)."""
    split = prepare_split(cases, max_rows)
    result = train_candidates(split, settings)
    result.extras["imbalance_comparison"] = imbalance_comparison(result)
    result.extras.update(importance_tables(result, permutation))
    best = result.test_scores.filter(F.col("model") == result.best_model_name)
    result.extras["calibration"] = E.calibration_curve(best)
    ranks = result.extras["score_ranks"]
    result.extras["roc_curve"] = E.roc_curve(result.test_scores, ranks=ranks)
    result.extras["pr_curve"] = E.pr_curve(result.test_scores, ranks=ranks)
    train = split.filter(F.col("split") == "train")
    result.extras["feature_scores"] = T.mutual_information(train)
    result.extras["feature_scores_knn"] = NB.mutual_information_knn(train)
    ml = split.drop("split")
    if clusters:
        result.extras.update(clustering(ml, train))
    result.extras["stats_tests"] = T.stats_tests(ml)
    return result
