"""Exact global ranks and cumulative counts without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves a whole table into one
task. Instead (two-level ranking):

1. collapse to distinct values with multiplicities (partial aggregation, so
   a value that holds a third of all rows becomes one row);
2. range-partition the distinct values (``repartitionByRange`` samples the
   keys, so partitions are balanced on *distinct* values);
3. per-partition totals (<= partitions x groups rows) give each partition
   its offset with a tiny window;
4. inside each partition a window partitioned by that partition id adds the
   local running count.

The result is exact and every step is distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casekit.session import ensure_checkpoint_dir


def _n_parts(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def rank_distinct(df: DataFrame, value_col: str, keys: list[str] | tuple = (),
                  weight_cols: list[str] | tuple = (), ascending: bool = True,
                  num_partitions: int | None = None) -> DataFrame:
    """Distinct values per key group with exact running totals.

    Output columns: keys..., value_col, ``cnt`` (rows with this value),
    ``before`` (rows of the group strictly before it in the order),
    ``idx`` (distinct values before it), and for every weight column ``w``
    the pair ``w`` (sum at this value) / ``w_before`` (sum strictly before).
    """
    keys = list(keys)
    weights = list(weight_cols)
    n = _n_parts(df, num_partitions)
    aggs = [F.count(F.lit(1)).alias("cnt")] + [F.sum(w).alias(w) for w in weights]
    d = df.filter(F.col(value_col).isNotNull()).groupBy(*keys, value_col).agg(*aggs)
    order = F.col(value_col).asc() if ascending else F.col(value_col).desc()
    d = (d.repartitionByRange(n, *[F.col(k).asc() for k in keys], order)
          .withColumn("_pid", F.spark_partition_id()))
    # Range bounds are sampled, so two evaluations may cut differently: the cut rows are
    # materialised once (checkpoint in the shared folder) and both branches below read them.
    ensure_checkpoint_dir(df.sparkSession)
    d = d.checkpoint(eager=True)
    tot_aggs = [F.sum("cnt").alias("_pcnt"), F.count(F.lit(1)).alias("_pidx")] + \
               [F.sum(w).alias(f"_p_{w}") for w in weights]
    tot = d.groupBy("_pid", *keys).agg(*tot_aggs)
    prev = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) \
        if keys else Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # bounded: one row per (partition, group)
    off = tot.select("_pid", *keys,
                     F.coalesce(F.sum("_pcnt").over(prev), F.lit(0)).alias("_off_cnt"),
                     F.coalesce(F.sum("_pidx").over(prev), F.lit(0)).alias("_off_idx"),
                     *[F.coalesce(F.sum(f"_p_{w}").over(prev), F.lit(0)).alias(f"_off_{w}") for w in weights])
    local = Window.partitionBy("_pid", *keys).orderBy(order)
    local_prev = local.rowsBetween(Window.unboundedPreceding, -1)
    d = d.select(*keys, value_col, "cnt", *weights, "_pid",
                 F.coalesce(F.sum("cnt").over(local_prev), F.lit(0)).alias("_loc_cnt"),
                 (F.row_number().over(local) - 1).alias("_loc_idx"),
                 *[F.coalesce(F.sum(w).over(local_prev), F.lit(0)).alias(f"_loc_{w}") for w in weights])
    j = d.join(F.broadcast(off), ["_pid", *keys])
    return j.select(*keys, value_col, "cnt",
                    (F.col("_off_cnt") + F.col("_loc_cnt")).alias("before"),
                    (F.col("_off_idx") + F.col("_loc_idx")).alias("idx"),
                    *[F.col(w) for w in weights],
                    *[(F.col(f"_off_{w}") + F.col(f"_loc_{w}")).alias(f"{w}_before") for w in weights])


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float],
                    keys: list[str] | tuple = ()) -> DataFrame:
    """Linear-interpolation quantiles (NumPy/pandas default), exact, distributed.

    Returns keys..., ``q`` (array of doubles, one per prob).
    """
    keys = list(keys)
    v = df.select(*keys, F.col(value_col).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    r = rank_distinct(v, "_v", keys)
    if keys:
        # one row per group; groups are low-cardinality by contract
        rj = r.join(F.broadcast(v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))), keys)
    else:
        rj = r.withColumn("_n", v.select(F.count(F.lit(1))).scalar())
    parts = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1).cast("double")
        lo_r = F.floor(pos)
        hi_r = F.ceil(pos)
        covers_lo = (F.col("before") <= lo_r) & (lo_r < F.col("before") + F.col("cnt"))
        covers_hi = (F.col("before") <= hi_r) & (hi_r < F.col("before") + F.col("cnt"))
        parts += [F.max(F.when(covers_lo, F.col("_v"))).alias(f"_lo{i}"),
                  F.max(F.when(covers_hi, F.col("_v"))).alias(f"_hi{i}"),
                  F.first(pos - lo_r).alias(f"_fr{i}")]
    g = rj.groupBy(*keys).agg(*parts) if keys else rj.agg(*parts)
    qs = []
    for i in range(len(probs)):
        lo, hi, fr = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_fr{i}")
        qs.append(F.when(hi == lo, lo).otherwise(lo + (hi - lo) * fr))
    return g.select(*keys, F.array(*qs).alias("q"))
