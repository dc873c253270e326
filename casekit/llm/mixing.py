"""Operator 3: mixing sources to target weights by Poisson replication (built-in functions only).

A source's repetition rate is its target weight times all characters over its own characters. Each document draws
the number of its copies from the Poisson distribution of that rate: a hash of seed and doc_id is a uniform number,
and the count is how many values of the cumulative distribution do not exceed it. Rates above ``STEP`` are the sum
of several draws. Documents are exploded by their counts, and all copies are dealt out and ordered by a hash of
their own, so neighbours come from anywhere.

The rates are one row per source; they are joined by broadcast if they are few, else by a shuffle that may split hot
sources. Without ``weights`` every source has the same weight; with them, sources not named have weight 0, and
weights are scaled to sum 1. Null is a source of its own. Null and empty texts have no characters but are drawn like
others of their source; rows with many copies are unfolded in several steps; a source without any characters has rate 0. Rows that repeat a doc_id draw the same count;
rows without doc_id draw by their text. An empty table gives an empty result. All columns of the input are kept;
one that clashes with an output column (``copy_no``, ``n_copies``, ``shuffle_key``) is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import cut, small

STEP, SEED = 500.0, "mix-1"
OUT = ("copy_no", "n_copies", "shuffle_key")
FEW = 10_000
MANY = 256  # copies of one row that one task makes


def rates(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """``mix_source, rate``: one row per source."""
    size = docs.groupBy(F.col("source").cast("string").alias("mix_source")).agg(
        F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    if weights is None:
        size = size.withColumn("weight", F.lit(1.0))
    else:
        total = float(sum(weights.values()))
        given = docs.sparkSession.createDataFrame([(k, v / total) for k, v in weights.items()], "name string, weight double")
        size = size.join(given, F.col("mix_source").eqNullSafe(F.col("name")), "left").withColumn(
            "weight", F.coalesce("weight", F.lit(0.0))).drop("name")
    all_of = size.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weights")).first() or (0, 0.0)
    share = F.col("weight") / F.lit(float(all_of[1] or 1.0))
    return size.select("mix_source", F.when(F.col("chars") > 0, share * F.lit(float(all_of[0] or 0)) / F.col("chars"))
                       .otherwise(F.lit(0.0)).alias("rate"))


def with_steps(rate: DataFrame) -> DataFrame:
    """Adds ``draws`` (number of draws) and ``cdf`` (cumulative distribution of one of them, until it reaches 1)."""
    draws = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    one = F.col("rate") / F.col("draws")
    last = F.ceil(one + 12 * F.sqrt(one) + 40).cast("int")
    start = F.struct(F.exp(-F.col("one")).alias("p"), F.array(F.exp(-F.col("one"))).alias("c"))
    walk = F.aggregate(F.sequence(F.lit(1), F.col("last")), start, lambda s, j: F.struct(
        (s["p"] * F.col("one") / j).alias("p"),
        F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * F.col("one") / j)).alias("c")))
    return (rate.withColumn("draws", draws).withColumn("one", one).withColumn("last", last)
            .select("mix_source", "rate", "draws", walk["c"].alias("cdf")))


def _uniform(*parts) -> F.Column:
    """52 bits of a hash as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def unfolded(counted: DataFrame, most: float) -> DataFrame:
    """Copies with ``copy_no`` from 1 to ``n_copies`` (at most ``most``). Rows with more than ``MANY`` copies are unfolded in
    steps of ``MANY``, dealt out anew after each, so that no task makes all copies of a row."""
    last = lambda df: df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    if most <= MANY:
        return last(counted)
    heavy = counted.where(F.col("n_copies") > MANY).select("*", F.lit(0).alias("mix_low"), F.col("n_copies").alias("mix_n"))
    size, parts = MANY, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: few bytes become many
    while size * MANY < most:
        size *= MANY
    while size >= MANY:
        part = F.explode(F.sequence(F.lit(0), F.ceil(F.col("mix_n") / size).cast("int") - 1))
        heavy = heavy.withColumn("mix_part", part).withColumns({
            "mix_low": F.col("mix_low") + F.col("mix_part") * size, "mix_n": F.least(F.lit(size), F.col("mix_n") - F.col("mix_part") * size)}).drop("mix_part")
        heavy, size = heavy.repartition(parts, "mix_key", "mix_low"), size // MANY
    heavy = heavy.withColumn("copy_no", F.explode(F.sequence(F.col("mix_low") + 1, F.col("mix_low") + F.col("mix_n")))).drop("mix_low", "mix_n")
    return last(counted.where(F.col("n_copies") <= MANY)).unionByName(heavy)


def replicate(docs: DataFrame, weights: dict | None = None, seed: str = SEED) -> DataFrame:
    """Copies of the documents with ``copy_no`` (from 1), ``n_copies`` and ``shuffle_key``, in order of the latter."""
    table = small(cut(with_steps(rates(docs, weights))), FEW)
    kept = [c for c in docs.columns if c.lower() not in OUT]
    inner = ("mix_source", "rate", "draws", "cdf", "mix_key")
    doc = F.struct(*(F.col(c) for c in kept)).alias("doc")
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("mix_key")
    told = docs.select(doc, F.col("source").cast("string").alias("of_source"), key)
    told = told.join(table, F.col("of_source").eqNullSafe(F.col("mix_source")))
    count = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda n, i: n + F.size(
        F.filter("cdf", lambda c: c <= _uniform(F.lit(seed), i.cast("string"), F.col("mix_key")))))
    counted = told.withColumn("n_copies", count).where("n_copies > 0").drop(*inner[:-1], "of_source")
    top = table.agg(F.coalesce(F.max("rate"), F.lit(0.0))).first()[0]
    copies = unfolded(counted, top + 12 * top**0.5 + 40 * (top // STEP + 1))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("at"), F.col("copy_no").cast("string"),
                                                               F.col("mix_key")).cast("binary")))
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select("doc.*", *OUT)


def oracle(seed: str = SEED) -> str:
    """The same rows in SQL over the table ``documents``, every source with the same weight."""
    hexed = "list_sum(list_transform(range(1, 14), lambda i: (strpos('0123456789abcdef', substr(h, i, 1)) - 1) * power(16, 13 - i)))"
    return f"""WITH size AS (SELECT source, sum(coalesce(length(text), 0)) AS chars FROM documents GROUP BY source),
total AS (SELECT CAST(sum(chars) AS DOUBLE) AS all_chars, CAST(count(*) AS DOUBLE) AS n FROM size),
rate AS (SELECT source, CASE WHEN chars > 0 THEN 1 / n * all_chars / chars ELSE 0 END AS rate FROM size, total),
steps AS (SELECT source, rate, greatest(ceil(rate / {STEP}), 1) AS draws, rate / greatest(ceil(rate / {STEP}), 1) AS one FROM rate),
cdf AS (SELECT source, list(c ORDER BY j) AS cdf, any_value(draws) AS draws FROM (
  SELECT source, draws, j, sum(exp(-one + CASE WHEN j = 0 THEN 0 ELSE j * ln(one) END - lgamma(j + 1))) OVER (PARTITION BY source ORDER BY j) AS c
  FROM steps, range(0, 1000) AS t(j) WHERE one > 0 AND j <= ceil(one + 12 * sqrt(one) + 40)) z GROUP BY source),
keyed AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS k, row_number() OVER () AS r FROM documents),
drawn AS (SELECT r, sum(len(list_filter(cdf, lambda c: c <= u))) AS n FROM (
  SELECT r, cdf, {hexed} / power(2, 52) AS u FROM (
    SELECT r, cdf, md5(concat_ws(':', '{seed}', CAST(i AS VARCHAR), k)) AS h
    FROM keyed JOIN cdf ON keyed.source IS NOT DISTINCT FROM cdf.source, range(1, 100) AS t(i) WHERE i <= draws) y) x GROUP BY r)
SELECT keyed.* EXCLUDE (k, r), CAST(copy_no AS INTEGER) AS copy_no, CAST(n AS INTEGER) AS n_copies,
  md5(concat_ws(':', '{seed}', 'at', CAST(copy_no AS VARCHAR), k)) AS shuffle_key
FROM keyed JOIN drawn USING (r), range(1, 100000) AS t(copy_no) WHERE copy_no <= n"""
