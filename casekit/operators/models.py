"""Model fitting (O-41, O-43, O-44, O-48, O-55..O-61).

Fits are distributed: Spark ML estimators, the network of ``network`` and the
forest of ``forest``; the driver only holds fitted
parameters (9 means/stds, tree ensembles, network weights, centroids).
Scaling is the reference's rule (population std, zero variance -> 1),
applied as column arithmetic before ``VectorAssembler``.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casekit import config as C
from casekit.operators import lloyd
from casekit.operators import ranking as R
from casekit.operators.forest import ForestClassifier, ForestModel
from casekit.operators.network import NetworkClassifier, NetworkModel
from casekit.session import ensure_checkpoint_dir


# ---------------------------------------------------------------- O-41
@dataclass
class Standardizer:
    """Per-feature mean / population std fitted on one table, applied anywhere."""
    cols: list[str]
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str] | None = None) -> "Standardizer":
        cols = cols or C.FEATURE_COLS
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
                     *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols]).first()
        means = {c: float(row[f"m_{c}"]) for c in cols}
        stds = {c: (float(row[f"s_{c}"]) if row[f"s_{c}"] and row[f"s_{c}"] > 0 else 1.0) for c in cols}
        return cls(cols, means, stds)

    def scaled_columns(self, prefix: str = "z_"):
        return [((F.col(c).cast("double") - F.lit(self.means[c])) / F.lit(self.stds[c])).alias(prefix + c)
                for c in self.cols]

    def transform(self, df: DataFrame, out: str = "features", keep_scaled: bool = False) -> DataFrame:
        z = df.select("*", *self.scaled_columns())
        v = VectorAssembler(inputCols=[f"z_{c}" for c in self.cols], outputCol=out).transform(z)
        return v if keep_scaled else v.drop(*[f"z_{c}" for c in self.cols])

    def as_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(c, self.means[c], self.stds[c]) for c in self.cols],
                                     "feature string, mean double, scale double")


# ---------------------------------------------------------------- O-44 / O-45
@dataclass
class ModelSettings:
    """Hyper-parameters. ``fast()`` gives a small configuration for smoke checks."""
    mlp_layers: tuple = (9, 96, 48, 24, 2)
    mlp_max_iter: int = 120
    lr_max_iter: int = 1200
    dt_max_depth: int = 8
    rf_trees: int = 120
    seed: int = C.RANDOM_STATE

    @classmethod
    def fast(cls) -> "ModelSettings":
        return cls(mlp_layers=(9, 16, 8, 2), mlp_max_iter=30, lr_max_iter=100, dt_max_depth=8, rf_trees=20)


def build_estimators(settings: ModelSettings, balanced: bool = True, n_train: int | None = None,
                     weight_col: str = "weight", label: str = "serious", features: str = "features") -> dict:
    """The four candidates. Class weights ('balanced') for all but the network,
    which has no weight column (as in the reference)."""
    w = {"weightCol": weight_col} if balanced else {}
    reg = 1.0 / n_train if n_train else 0.0  # C = 1 on the mean loss scale
    return {
        "ANN (MLPClassifier)": NetworkClassifier(
            hidden=tuple(settings.mlp_layers[1:-1]), max_iter=settings.mlp_max_iter, seed=settings.seed,
            label=label, features=features),
        "Logistic Regression": LogisticRegression(
            maxIter=settings.lr_max_iter, regParam=reg, standardization=False, labelCol=label,
            featuresCol=features, **w),
        "Decision Tree": DecisionTreeClassifier(
            maxDepth=settings.dt_max_depth, seed=settings.seed, labelCol=label, featuresCol=features, **w),
        "Random Forest": ForestClassifier(
            trees=settings.rf_trees, seed=settings.seed, label=label, features=features,
            weight_col=weight_col if balanced else None),
    }


def positive_probability(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``p`` = P(class 1) from a fitted classifier."""
    if isinstance(model, ForestModel):
        return model.score(df, keep)
    if isinstance(model, NetworkModel):
        return df.select(*keep, model.positive().alias("p"))
    out = model.transform(df)
    return out.select(*keep, vector_to_array(F.col("probability"))[1].alias("p"))


# ---------------------------------------------------------------- O-56
def tree_importance(model, name: str, cols: list[str] | None = None) -> DataFrame:
    """Native (impurity) importance of a fitted tree model, as a 9-row table."""
    cols = cols or C.FEATURE_COLS
    imp = (model.importances if isinstance(model, ForestModel) else model.featureImportances.toArray()).tolist()
    rows = [(c, float(v), f"{name} native importance") for c, v in zip(cols, imp)]
    return model_session(model).createDataFrame(rows, "feature string, importance double, source string")


def model_session(_model):
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


# ---------------------------------------------------------------- O-57
BLOCK_ROWS = 1024


def _shuffles(n: int, features: list[str], repeats: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(feature, repeat, a, b) of each variant: block ``x`` receives from ``(a * x + b) mod n``, a permutation
    as ``a`` has no factor in common with ``n``. ``a`` stays below 2^20."""
    rng, out = random.Random(seed), []
    for feature in features:
        for rep in range(repeats):
            a = rng.randrange(1, max(2, min(n, 1 << 20)))
            while math.gcd(a, n) != 1:
                a = rng.randrange(1, max(2, min(n, 1 << 20)))
            out.append((feature, rep, a, rng.randrange(n)))
    return out


def _rotations(n: int, features: list[str], repeats: int, seed: int) -> dict[tuple[str, int], int]:
    """How far each variant turns the rows of a block: 1 to ``n - 1``."""
    rng = random.Random(f"{seed}:turns")
    return {(f, r): rng.randrange(1, max(2, n)) for f in features for r in range(repeats)}


def permuted(test: DataFrame, cols: list[str], keep: list[str], repeats: int, seed: int) -> DataFrame:
    """Every row of ``test`` once as it is (feature ``__baseline__``) and once for each feature and repeat, with this feature
    from another row: a permutation of all rows.

    Rows get distinct places in the order of a seeded hash of the whole row (equal rows collapse before the ranking and
    unfold to consecutive places after it), and ``BLOCK_ROWS`` places make a block, one row of a small table. A variant
    permutes whole blocks (the last, shorter one stays) and turns the values inside each, so a block sends the values of one
    feature to one block: eight bytes a row and variant are shuffled, not copies of the rows. The rows of all variants are
    unfolded where their block lies.
    """
    used = list(dict.fromkeys([*keep, *cols]))
    h = (test.groupBy(*used).agg(F.count(F.lit(1)).alias("_copies"))
         .withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.to_json(F.struct(*used))))))
    ranks = R.rank_distinct(h.select("_h", "_copies"), "_h", weight_cols=["_copies"]).select(
        "_h", F.col("_copies_before").alias("_first"))
    placed = (h.join(ranks, "_h")
              .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
              .select((F.col("_first") + F.col("_copy")).alias("_pos"), *keep, *[F.col(c).cast("double").alias(c) for c in cols if c not in keep]))
    size, names = BLOCK_ROWS, list(dict.fromkeys([*keep, *cols]))
    ensure_checkpoint_dir(test.sparkSession)
    blocks = (placed.groupBy(F.floor(F.col("_pos") / size).alias("block"))
              .agg(F.array_sort(F.collect_list(F.struct("_pos", *names))).alias("rows")).checkpoint())  # BLOCK_ROWS a group
    n = blocks.agg(F.coalesce(F.sum(F.size("rows")), F.lit(0))).first()[0]
    full, turns = n // size, _rotations(min(n, size), cols, repeats, seed)
    values = lambda f: F.transform("rows", lambda x: x[f].cast("double"))
    variants = []
    for f, r, a, b in _shuffles(max(1, full), cols, repeats, seed):
        back = pow(a, -1, full) if full > 1 else 0  # block t gets from block (a t + b) mod full
        to = F.when(F.col("block") >= full, F.col("block")).otherwise(
            F.pmod((F.col("block") - b) * F.lit(back), F.lit(max(1, full)))).cast("bigint")
        own, m = values(f), F.size("rows")
        turn = F.pmod(F.lit(turns[f, r]), m)
        variants.append(F.struct(F.lit(f).alias("feature"), F.lit(r).alias("rep"), to.alias("block"),
                                 F.concat(F.slice(own, turn + 1, m), F.slice(own, F.lit(1), turn)).alias("got")))
    donors = blocks.select(F.inline(F.array(*variants)))

    def unfolded(rows: DataFrame, feature, value) -> DataFrame:
        fields = lambda x, v: F.struct(*[x[c].alias(c) for c in keep], *[
            (F.when(F.col("feature") == c, v).otherwise(x[c].cast("double")) if v is not None else x[c].cast("double")).alias(c) for c in cols if c not in keep])
        array = F.zip_with("rows", value, fields) if value else F.transform("rows", lambda x: fields(x, None))
        return rows.select("feature", "rep", F.inline(array))

    changed = unfolded(donors.join(blocks, "block"), "feature", "got")
    plain = unfolded(blocks.select("rows", F.lit("__baseline__").alias("feature"), F.lit(-1).alias("rep")), None, None)
    return changed.unionByName(plain).select(*keep, "feature", "rep", *[c for c in cols if c not in keep])


def permutation_importance(model, name: str, test: DataFrame, scaler: Standardizer, key: str = "primaryid",
                           label: str = "serious", repeats: int = C.PERMUTATION_REPEATS,
                           seed: int = C.RANDOM_STATE, threshold: float = 0.5) -> DataFrame:
    """Drop in F1 (at the classifier's own 0.5 cut) when one feature is shuffled, over all test rows.

    All variants are scored in one ``transform`` and F1 is one ``groupBy``.
    Returns (feature, importance = mean drop, importance_std = population std, source).
    """
    if not test.head(1):
        return test.sparkSession.createDataFrame([], "feature string, importance double, importance_std double, source string")
    allv = permuted(test, scaler.cols, [key, label], repeats, seed)
    scored = positive_probability(model, scaler.transform(allv), [label, "feature", "rep"])
    pred = (F.col("p") > threshold).cast("int")
    f1 = scored.groupBy("feature", "rep").agg(
        F.sum(((pred == 1) & (F.col(label) == 1)).cast("long")).alias("tp"),
        F.sum(((pred == 1) & (F.col(label) == 0)).cast("long")).alias("fp"),
        F.sum(((pred == 0) & (F.col(label) == 1)).cast("long")).alias("fn")).select(
        "feature", "rep", F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0,
                                 (2 * F.col("tp")) / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
                                 ).otherwise(F.lit(0.0)).alias("f1"))
    base_f1 = f1.filter(F.col("feature") == "__baseline__").select(F.first("f1")).scalar()
    drops = f1.filter(F.col("feature") != "__baseline__").withColumn("drop", base_f1 - F.col("f1"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance"),
                                        F.stddev_pop("drop").alias("importance_std")).withColumn(
        "source", F.lit(f"{name} permutation importance"))


# ---------------------------------------------------------------- O-43
def pca_fit(train_scaled: DataFrame, k: int = 3, features: str = "features"):
    """PCA on scaled features; returns (model, variance table)."""
    model = PCA(k=k, inputCol=features, outputCol="pca").fit(train_scaled)
    ratios = model.explainedVariance.toArray().tolist()
    cum, rows = 0.0, []
    for i, r in enumerate(ratios):
        cum += r
        rows.append((f"PC{i + 1}", float(r), float(cum)))
    spark = model_session(model)
    table = spark.createDataFrame(rows, "component string, explained_variance_ratio double, "
                                        "cumulative_variance_ratio double")
    return model, table


def pca_project(model, df_scaled: DataFrame, keep: list[str]) -> DataFrame:
    """PC1, PC2 with the sign fixed so each component's largest |loading| is positive."""
    pc = model.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(pc.shape[1])]
    out = model.transform(df_scaled).withColumn("_pca", vector_to_array("pca"))
    return out.select(*keep, (F.col("_pca")[0] * signs[0]).alias("PC1"),
                      (F.col("_pca")[1] * (signs[1] if len(signs) > 1 else 1.0)).alias("PC2"))


# ---------------------------------------------------------------- O-59 / O-60 / O-61
def kmeans_best(df_scaled: DataFrame, k: int = C.N_CLUSTERS, restarts: int = 10, seed: int = C.RANDOM_STATE,
                features: str = "features") -> lloyd.KMeansModel:
    """Best of ``restarts`` k-means fits (lowest training cost; ties -> lowest number), all moved in the same passes."""
    return lloyd.fit(df_scaled, k, restarts, seed, features)


def cluster_summary(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("cases"), F.avg(F.col("serious").cast("double")).alias("serious_rate"),
        F.avg("age").alias("avg_age"), F.avg(F.col("drug_count").cast("double")).alias("avg_drug_count"),
        F.avg(F.col("polypharmacy").cast("double")).alias("polypharmacy_rate"))


def silhouette(clustered: DataFrame, features: str = "features") -> DataFrame:
    """Silhouette by both distances: Euclidean (exact, or within the bounds given, see ``lloyd``), and squared-Euclidean,
    which is another quantity that takes one pass over any number of rows."""
    n_clusters = clustered.select(F.count_distinct("cluster")).first()[0]
    square = 0.0 if n_clusters < 2 else ClusteringEvaluator(
        featuresCol=features, predictionCol="cluster", distanceMeasure="squaredEuclidean").evaluate(clustered)
    rows = [("euclidean", *lloyd.silhouette(clustered, features)), ("squaredEuclidean", *[float(square)] * 3)]
    return model_session(None).createDataFrame(rows, "distance string, silhouette double, at_least double, at_most double")


def rank_by(df: DataFrame, col: str, desc: bool = True) -> DataFrame:
    """Small-table rank (<= 9 rows: feature tables)."""
    o = F.col(col).desc() if desc else F.col(col).asc()
    return df.withColumn("rank", F.row_number().over(Window.orderBy(o, F.col("feature"))))
