"""Adapter from the generated star-schema tables to the four report sources.

The generated test data has no adverse-event files, so the source tables
(DEMO, DRUG, REAC, OUTC) are *views* over ``orders``, ``lineitem`` and
``part``: they only give rows in the schema the case engine expects
(dirty values on purpose) and do none of the engine's work.

The same adapter is written once as DataFrame code (used by the Spark
queries) and once as SQL (used by the DuckDB oracle), see ``ADAPTER_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def demo_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    age = (F.when(k % 97 == 0, F.lit("UNK"))
           .when(k % 89 == 0, F.lit(None).cast("string"))
           .otherwise(((c * 7 + k) % 131).cast("string")))
    sex = (F.when(k % 53 == 0, F.lit(None).cast("string"))
           .when(k % 47 == 0, F.lit("UNK"))
           .when(c % 5 == 0, F.lit(" f "))
           .when(c % 5 < 3, F.lit("F"))
           .when(c % 5 == 3, F.lit("m"))
           .otherwise(F.lit("M")))
    return o.select(k.alias("primaryid"), age.alias("age"), sex.alias("sex"))


def _lines_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return li.join(part, li.l_partkey == part.p_partkey, "inner")


def drug_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _lines_with_parts(spark, sf_dir)
    pk, ln, name = F.col("l_partkey"), F.col("l_linenumber"), F.col("p_name")
    drugname = (F.when(pk % 23 == 0, F.lit("unk"))
                .when(pk % 29 == 0, F.lit(None).cast("string"))
                .when(pk % 31 == 0, F.lit("  "))
                .when(ln % 2 == 0, F.upper(name))
                .otherwise(F.concat(F.lit(" "), name, F.lit(" "))))
    return j.select(F.col("l_orderkey").alias("primaryid"), drugname.alias("drugname"))


def reac_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _lines_with_parts(spark, sf_dir)
    return (j.filter(F.col("l_linestatus") == "O")
            .select(F.col("l_orderkey").alias("primaryid"), F.col("p_type").alias("pt")))


def outc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    ln = F.col("l_linenumber")
    cod = (F.when(ln % 3 == 0, F.lit("DE")).when(ln % 3 == 1, F.lit("HO")).otherwise(F.lit("OT")))
    return (li.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25))
            .select(F.col("l_orderkey").alias("primaryid"), cod.alias("outc_cod")))


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four sources as lazy DataFrames keyed demo/drug/outc/reac."""
    return {
        "demo": demo_source(spark, sf_dir),
        "drug": drug_source(spark, sf_dir),
        "outc": outc_source(spark, sf_dir),
        "reac": reac_source(spark, sf_dir),
    }


# The same adapter as SQL text (valid in DuckDB and Spark SQL); the oracle
# queries start from these CTEs.
ADAPTER_SQL = {
    "demo": """
SELECT o_orderkey AS primaryid,
       CASE WHEN o_orderkey % 97 = 0 THEN 'UNK' WHEN o_orderkey % 89 = 0 THEN NULL
            ELSE CAST((o_custkey * 7 + o_orderkey) % 131 AS STRING) END AS age,
       CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN 'UNK'
            WHEN o_custkey % 5 = 0 THEN ' f ' WHEN o_custkey % 5 < 3 THEN 'F'
            WHEN o_custkey % 5 = 3 THEN 'm' ELSE 'M' END AS sex
FROM orders""",
    "drug": """
SELECT l_orderkey AS primaryid,
       CASE WHEN l_partkey % 23 = 0 THEN 'unk' WHEN l_partkey % 29 = 0 THEN NULL
            WHEN l_partkey % 31 = 0 THEN '  ' WHEN l_linenumber % 2 = 0 THEN upper(p_name)
            ELSE ' ' || p_name || ' ' END AS drugname
FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "reac": """
SELECT l_orderkey AS primaryid, p_type AS pt
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O'""",
    "outc": """
SELECT l_orderkey AS primaryid,
       CASE WHEN l_linenumber % 3 = 0 THEN 'DE' WHEN l_linenumber % 3 = 1 THEN 'HO' ELSE 'OT' END AS outc_cod
FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25""",
}
