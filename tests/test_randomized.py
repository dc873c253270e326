"""Randomized checks (Hypothesis): rounding/formatting and the ragged-row reader.

Each property draws a whole batch of examples and checks them in one Spark
job, so the test stays fast.
"""

import os
import tempfile

from hypothesis import given, settings
from hypothesis import strategies as st

from casekit.functions import columns as X
from casekit.sources import delimited as DL

finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)
decimals = st.integers(min_value=-10 ** 7, max_value=10 ** 7).map(lambda i: i / 1000.0)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(finite, decimals), min_size=50, max_size=300), st.integers(min_value=0, max_value=4))
def test_python_rounding_matches_python(spark, values, digits):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select(X.py_round("x", digits).alias("r"), X.fmt_fixed("x", digits).alias("t"),
                     X.fmt_fixed("x", digits, sign=True).alias("s")).collect()
    for v, r in zip(values, rows):
        assert r["r"] == round(v, digits)
        assert r["t"] == f"{v:.{digits}f}"
        assert r["s"] == f"{v:+.{digits}f}"


field = st.text(alphabet="abcXYZ019 .-éü", min_size=0, max_size=6)


def _pandas_rule(lines, n):
    """Rows kept (as tuples of strings/None) under skip-long / pad-short, '' -> None."""
    out = []
    for line in lines:
        parts = line.split("$")
        if len(parts) == 1 and not parts[0].strip():
            continue  # a blank line (one field, white space only) is skipped
        if len(parts) > n:
            continue
        parts = parts + [None] * (n - len(parts))
        out.append(tuple(None if p in DL.PANDAS_NA_VALUES else p for p in parts))
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(field, min_size=1, max_size=6), min_size=5, max_size=60))
def test_ragged_reader_matches_rule(spark, rows):
    tmpdir_path = tempfile.mkdtemp(prefix="casekit-ragged-")
    n = 4
    header = "a$b$c$d"
    lines = ["$".join(r) for r in rows]
    lines = [ln for ln in lines if ln != "" and ln != header]
    path = os.path.join(tmpdir_path, f"r{abs(hash(tuple(lines)))}.txt")
    with open(path, "wb") as f:
        f.write(("\n".join([header] + lines) + "\n").encode("latin-1"))
    got = sorted((tuple(r) for r in DL.read_delimited(spark, path).collect()), key=repr)
    exp = sorted(_pandas_rule(lines, n), key=repr)
    assert got == exp


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.floats(min_value=-1e3, max_value=1e3, allow_nan=False, allow_infinity=False),
                          st.integers(min_value=-50, max_value=50).map(float)), min_size=2, max_size=400))
def test_histogram_matches_numpy(spark, values):
    import numpy as np

    from casekit.operators import cohort as K
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["count"] for r in K.histogram(df, "x").orderBy("bin").collect()]
    lo, hi = min(values), max(values)
    exp, _ = np.histogram(np.array(values), bins=30, range=(lo, hi) if lo < hi else None)
    assert got == exp.tolist()


def test_risk_score_literals(spark):
    """Worked by hand: age share of 25, drugs of 30, distinct drugs of 15, reactions of 20, flags 7 and 3."""
    rows = [(45.0, 4, 1, 0, 0, 1, 21.0), (70.5, 25, 25, 12, 1, 0, 89.62), (33.37, 0, 0, 0, 0, 0, 8.34),
            (99.99, 19, 7, 9, 1, 1, 86.75), (119.99, 40, 40, 20, 1, 1, 100.0), (10.0, 5, 5, 5, 1, 0, 30.75)]
    df = spark.createDataFrame(rows, "age double, dc int, udc int, rc int, poly int, rep int, expected double")
    args = ("age", "dc", "udc", "rc", "poly", "rep")
    for r in df.select("expected", X.risk_score(*args).alias("a"), X.risk_score(*args, rounding="python").alias("b")).collect():
        assert r["a"] == r["expected"] and r["b"] == r["expected"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(min_value=1, max_value=11999).map(lambda a: a / 100.0),
                          st.integers(min_value=0, max_value=40), st.integers(min_value=0, max_value=40),
                          st.integers(min_value=0, max_value=20), st.integers(min_value=0, max_value=1)),
                min_size=20, max_size=300))
def test_risk_score_roundings_agree(spark, rows):
    """Both roundings give two decimals of the same unrounded sum, at most half a hundredth away."""
    df = spark.createDataFrame(rows, "age double, dc int, udc int, rc int, rep int")
    args = ("age", "dc", "udc", "rc", (df["dc"] >= 5).cast("int"), "rep")
    for r in df.select(X.risk_score(*args).alias("a"), X.risk_score(*args, rounding="python").alias("b"),
                       X.risk_score(*args, rounding="none").alias("raw")).collect():
        for v in (r["a"], r["b"]):
            assert v == round(v, 2) and abs(v - r["raw"]) <= 0.005 + 1e-9 and 0 <= v <= 100
