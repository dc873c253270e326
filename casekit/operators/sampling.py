"""Model input preparation: null drop, class guard, stratified sample and split (O-38..O-40).

Row order never decides membership: every row gets a seeded hash
``md5(id ':' seed)`` (then a hash of the whole row), and a class's first rows
in hash order are taken. Where a quota ends is found by counting: rows by
class and the next four hex digits of the hash, 65,536 cells a class, then the
one cell that holds the end, until few rows are left to look at. Rows are then
compared with the hash found, so whole rows are neither sorted nor shuffled,
and results are reproducible on any partitioning and on task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casekit import config as C

MODEL_COLUMNS = C.FEATURE_COLS + ["age_group", "serious"]


# ---------------------------------------------------------------- O-38
def model_frame(cases: DataFrame, key: str = "primaryid") -> DataFrame:
    """Case rows with every model column present (``dropna`` on features, band, label)."""
    keep = [key] + [c for c in MODEL_COLUMNS if c != key]
    return cases.select(*keep).dropna(subset=MODEL_COLUMNS)


def require_two_classes(df: DataFrame, label: str = "serious") -> None:
    """Raise like the reference when the filtered cohort has a single class."""
    n = df.select(F.count_distinct(label)).first()[0]
    if n < 2:
        raise ValueError("Need at least two target classes in the filtered data for ML training.")


def row_hash(key: str = "primaryid", seed: int = C.RANDOM_STATE, salt: str = "") -> Column:
    parts = [F.col(key).cast("string"), F.lit(":"), F.lit(str(seed))]
    if salt:
        parts += [F.lit(":"), F.lit(salt)]
    return F.md5(F.concat(*parts))


#: Hex digits of a counting round, and rows of a cell from which its hashes are counted whole.
DIGITS, LAST_ROWS = 4, 100_000


def _hashes(df: DataFrame, key: str, seed: int) -> tuple[Column, Column]:
    """Hash of the id (32 hex digits), and of the whole row (needed only among rows that share the first)."""
    whole = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    return F.coalesce(row_hash(key, seed), F.lit("")), F.md5(whole)


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_n_c"))  # one row per class


def quota_ends(df: DataFrame, label: str, key: str, seed: int, quotas: list[tuple]) -> dict[tuple, tuple[str, int]]:
    """For each (class, quota): the hash at which the quota ends, and how many rows of exactly this hash it still takes.
    Quotas of a whole class or more have no end."""
    spark, (first, second) = df.sparkSession, _hashes(df, key, seed)
    kind, ends = df.schema[label].dataType.simpleString(), {}
    todo = {q: ("", 0, None) for q in quotas}  # prefix, rows before it, rows of the cell
    while todo:
        width = len(next(iter(todo.values()))[0])
        last = width and (width >= 64 or all(n <= LAST_ROWS for *_, n in todo.values()))
        asked = spark.createDataFrame([(c, q, p, n) for (c, q), (p, n, _) in todo.items()], f"_c {kind}, _q long, _p string, _base long")
        whole = F.concat(first, second)
        prefix = F.substring(first if width <= 32 else whole, 1, width) if width else F.lit("")
        cell = whole if last else F.substring(first if width < 32 else whole, 1, width + DIGITS)
        rows = df.select(F.col(label).alias("_c"), prefix.alias("_p"), cell.alias("_cell"))
        if width:
            rows = rows.join(F.broadcast(asked.select("_c", "_p").distinct()), ["_c", "_p"], "left_semi")  # a few rows
        counts = rows.groupBy("_c", "_p", "_cell").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("_c", "_p").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        at = F.col("_base") + F.col("_before")
        hit = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(asked), ["_c", "_p"])
               .where((at <= F.col("_q")) & (F.col("_q") < at + F.col("_n"))).select("_c", "_q", "_cell", at.alias("_at"), "_n").collect())
        if last:
            ends |= {(r["_c"], r["_q"]): (r["_cell"], r["_q"] - r["_at"]) for r in hit}
            break
        todo = {(r["_c"], r["_q"]): (r["_cell"], r["_at"], r["_n"]) for r in hit}
    return ends


def _take_first(df: DataFrame, label: str, key: str, seed: int, sizes: list, names: list[str]) -> DataFrame:
    """Adds ``_part``: the first of ``names`` whose quota (``sizes``: rows of class, quota by name) takes the row, else null."""
    first, second = _hashes(df, key, seed)
    quotas = sorted({(r[label], r[n]) for r in sizes for n in names})
    ends = quota_ends(df, label, key, seed, quotas)
    rows, split = df.select("*", first.alias("_h1")), F.lit(None).cast("string")
    ties = []
    for r in sizes:
        part = F.lit(None).cast("string")
        for n in reversed(names):
            if r[n] >= r["_n_c"]:
                part = F.lit(n)
            elif (r[label], r[n]) in ends:
                h, more = ends[r[label], r[n]]
                taken = (F.col("_h1") < h[:32]) | ((F.col("_h1") == h[:32]) & (second < h[32:]))
                part = F.when(taken, n).otherwise(part)
                if more:
                    ties.append((r[label], h))
        split = F.when(F.col(label) == F.lit(r[label]), part).otherwise(split)
    if not ties:
        return rows.withColumn("_part", split).drop("_h1")
    tied = F.lit(False)
    for c, h in ties:
        tied = tied | ((F.col(label) == F.lit(c)) & (F.col("_h1") == h[:32]) & (second == h[32:]))
    # equal rows in which a quota ends: one row with its count, unfolded to numbered copies
    copies = (rows.where(tied).groupBy(*df.columns, "_h1").agg(F.count(F.lit(1)).alias("_copies"))
              .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1))))
    part = split
    for r in sizes:
        for n in reversed(names):
            h, more = ends.get((r[label], r[n]), ("", 0))
            if more:
                here = (F.col(label) == F.lit(r[label])) & (F.col("_h1") == h[:32]) & (second == h[32:])
                part = F.when(here & (F.col("_i") < more), n).otherwise(part)
    return rows.where(~tied).withColumn("_part", split).drop("_h1").unionByName(
        copies.withColumn("_part", part).drop("_h1", "_copies", "_i"))


# ---------------------------------------------------------------- O-39
def stratified_sample(df: DataFrame, max_rows: int | None = C.MAX_TRAIN_ROWS, label: str = "serious",
                      key: str = "primaryid", seed: int = C.RANDOM_STATE) -> DataFrame:
    """Down-sample to about ``max_rows`` keeping class shares.

    Quota per class: ``min(n_c, max(1, int(max_rows * n_c / n)))``; the rows
    kept are the first ``quota`` of the class in seeded-hash order. No cap
    (``None``) or a table already within the cap returns every row.
    """
    if max_rows is None:
        return df
    sizes = class_sizes(df, label)
    n = sizes.agg(F.sum("_n_c")).scalar()
    quota = F.least(F.col("_n_c"), F.greatest(F.lit(1).cast("bigint"),
                    F.floor(F.lit(float(max_rows)) * (F.col("_n_c") / n)).cast("bigint")))
    rows = sizes.select(label, "_n_c", quota.alias("kept")).collect()
    if sum(r["_n_c"] for r in rows) <= max_rows:
        return df
    return _take_first(df, label, key, seed, rows, ["kept"]).where("_part IS NOT NULL").drop("_part")


# ---------------------------------------------------------------- O-40
def split_assign(df: DataFrame, label: str = "serious", key: str = "primaryid", seed: int = C.RANDOM_STATE,
                 test_size: float = C.TEST_SIZE, validation_split: float = C.VALIDATION_SPLIT) -> DataFrame:
    """Adds ``split`` in {train, validation, test}: stratified 70 / 15 / 15.

    Per class: ``temp = round(test_size * n_c)``, ``test = round(temp * validation_split)``
    (halves up); the class's first ``test`` hash ranks are test, the next
    ``temp - test`` validation, the rest train.
    """
    temp = F.round(F.lit(float(test_size)) * F.col("_n_c"), 0).cast("bigint")
    test = F.round(temp.cast("double") * F.lit(float(validation_split)), 0).cast("bigint")
    sizes = class_sizes(df, label).select(label, "_n_c", test.alias("test"), temp.alias("validation")).collect()
    rows = _take_first(df, label, key, seed, sizes, ["test", "validation"])
    return rows.withColumn("split", F.coalesce("_part", F.lit("train"))).drop("_part")


# ---------------------------------------------------------------- O-45
def class_weights(train: DataFrame, label: str = "serious") -> DataFrame:
    """``n / (k * n_c)`` per class ('balanced'); one row per class."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n = train.select(F.count(F.lit(1))).scalar()
    k = train.select(F.count_distinct(label)).scalar()
    return counts.select(label, "n_c", (n / (k * F.col("n_c")).cast("double")).alias("weight"))


def with_weights(df: DataFrame, weights: DataFrame, label: str = "serious", out: str = "weight") -> DataFrame:
    return df.join(F.broadcast(weights.select(label, F.col("weight").alias(out))), label)  # <= 2 rows
