"""A representative set of registered queries against their DuckDB oracles (sf0.001)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import duck, rows_of, type_family

from .conftest import SF001

KEYS = ["case_table", "drug_exposure", "top_risk_segments", "histogram", "kde", "box_stats", "describe_all",
        "clinical_insights", "missing_values", "threshold_sweep", "roc_curve", "pr_curve", "model_digest",
        "explain_cases", "risk_segmentation", "what_if", "split_assign", "stats_tests", "mutual_information",
        "case_table_from_files"]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    st = E.queries()[key](spark, SF001).toArrow()
    dt = con.sql(E.oracle_sql()[key]).to_arrow_table()
    assert sorted(st.column_names) == sorted(dt.column_names)
    assert {f.name: type_family(f.type) for f in st.schema} == {f.name: type_family(f.type) for f in dt.schema}
    assert st.num_rows == dt.num_rows
    assert rows_of(st) == rows_of(dt)
