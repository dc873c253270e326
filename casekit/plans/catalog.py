"""Registered queries: one per operator of the inventory, each with its oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator over the
whole case table derived from ``sf_dir``; ``ORACLE[name]`` is the DuckDB
text for the same result (absent for operators that are not SQL-shaped,
such as model fits).
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casekit.operators import prepare as P
from casekit.plans import oracle as O
from casekit.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def build_cases(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """The case table computed from the source tables (the flagship plan)."""
    return P.case_table_from_sources(FX.sources(spark, sf_dir), tasks)


TASK_CASES = 30_000  # reports that one task of a large materialised table joins


def case_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks that join a large table; ``None`` (Spark chooses) where its own number is not exceeded."""
    n = -(-FX.demo_source(spark, sf_dir).count() // TASK_CASES)
    return n if n >= int(spark.conf.get("spark.sql.shuffle.partitions", "200")) else None


_MATERIALIZED: dict = {}
_LOCK = threading.RLock()  # one materialisation per key even when queries run from several threads


def _source_stamp(sf_dir: str) -> str:
    import hashlib
    import os
    parts = []
    for t in ("orders", "lineitem", "part"):
        p = f"{sf_dir.rstrip('/')}/{t}.parquet"
        try:
            st = os.stat(p)
            parts.append(f"{p}:{st.st_size}:{int(st.st_mtime)}")
        except OSError:
            parts.append(p)
    return hashlib.md5("|".join(parts).encode()).hexdigest()[:16]


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case table, materialised once per session and source version.

    Every analytic reuses it (as the reference caches its prepared frame):
    it is written as Parquet under the cluster's checkpoint folder, so later
    plans start from a pruned, pushed-down scan instead of re-joining the
    sources, and a lost executor does not recompute the joins.
    """
    from casekit.session import ensure_checkpoint_dir
    key = (spark.sparkContext.applicationId, sf_dir, _source_stamp(sf_dir))
    with _LOCK:
        path = _MATERIALIZED.get(key)
        if path is None:
            base = ensure_checkpoint_dir(spark).rstrip("/")
            path = f"{base}/casekit-cases/{key[0]}-{key[2]}"
            # rows sorted by age inside each file: Parquet min/max statistics then let
            # age-range cohort filters skip row groups (a local sort, no shuffle)
            build_cases(spark, sf_dir, case_tasks(spark, sf_dir)).sortWithinPartitions("age").write.mode("overwrite").parquet(path)
            _MATERIALIZED[key] = path
    return spark.read.parquet(path)


# ====================================================================== preparation
register("case_table", O.with_ctes("SELECT * FROM cases"))(build_cases)


@register("clean_demo", O.with_ctes("SELECT * FROM demo_clean"))
def q_clean_demo(spark, sf_dir):
    return P.clean_demo(FX.demo_source(spark, sf_dir))


@register("normalize_drugs", O.with_ctes("SELECT * FROM drug_norm"))
def q_normalize_drugs(spark, sf_dir):
    return P.normalize_drugs(FX.drug_source(spark, sf_dir))


@register("drug_exposure", O.with_ctes("SELECT * FROM drug_agg"))
def q_drug_exposure(spark, sf_dir):
    return P.drug_exposure(P.normalize_drugs(FX.drug_source(spark, sf_dir)))


@register("serious_cases", O.with_ctes("SELECT * FROM serious_agg"))
def q_serious_cases(spark, sf_dir):
    return P.serious_cases(FX.outc_source(spark, sf_dir))


@register("reaction_counts", O.with_ctes("SELECT * FROM reac_agg"))
def q_reaction_counts(spark, sf_dir):
    return P.reaction_counts(FX.reac_source(spark, sf_dir))


@register("risk_score", O.with_ctes(f"SELECT primaryid, {O.sql_risk_score()} AS risk_score FROM cases"))
def q_risk_score(spark, sf_dir):
    return P.risk_score_frame(cases(spark, sf_dir))


@register("age_groups", O.with_ctes(
    f"SELECT primaryid, age, {O.sql_age_group('age')} AS age_group, "
    f"{O.sql_age_group_ord('age')} AS age_group_ord FROM cases"))
def q_age_groups(spark, sf_dir):
    return P.age_groups(cases(spark, sf_dir))


@register("cohort_filter", O.with_ctes(
    f"SELECT * FROM cases WHERE age >= {O.D(30)} AND age <= {O.D(75)}"))
def q_cohort_filter(spark, sf_dir):
    return P.cohort_filter(cases(spark, sf_dir), 30, 75)


# registrations by area (imported for their side effect on QUERIES / ORACLE)
from casekit.plans import q_cohort  # noqa: E402,F401
from casekit.plans import q_scoring  # noqa: E402,F401
from casekit.plans import q_models  # noqa: E402,F401
from casekit.plans import q_files  # noqa: E402,F401
