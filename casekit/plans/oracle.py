"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each oracle starts from the same adapter rows as the Spark query
(``ADAPTER_SQL``) and re-derives the case table in plain SQL; it shares no
code path with the Spark operators except the fixed constants.
All arithmetic is cast to DOUBLE (a bare ``20.0`` is a DECIMAL in DuckDB).
"""

from __future__ import annotations

from casekit import config as C
from casekit.functions.columns import NUMERIC_PATTERN
from casekit.sources.fixtures import ADAPTER_SQL


def D(x: float) -> str:
    """A DOUBLE literal with the exact bits of the Python float."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def sql_round_even(expr: str, digits: int) -> str:
    scale = D(10.0 ** digits)
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def sql_py_round(expr: str, digits: int) -> str:
    """SQL twin of ``columns.py_round`` (same exact product error, same tie rule)."""
    if digits == 0:
        return f"round_even(CAST({expr} AS DOUBLE), 0)"
    sc = D(float(10 ** digits))
    x = "v"
    p = f"({x} * {sc})"
    t = f"({x} * {D(134217729.0)})"
    xh = f"({t} - ({t} - {x}))"
    xl = f"({x} - {xh})"
    err = f"((({xh} * {sc}) - {p}) + ({xl} * {sc}))"
    tie = f"({p} - floor({p}) = {D(0.5)})"
    r = (f"CASE WHEN {tie} AND {err} > 0 THEN CAST(ceil({p}) AS DOUBLE) "
         f"WHEN {tie} AND {err} < 0 THEN CAST(floor({p}) AS DOUBLE) ELSE round_even({p}, 0) END")
    # the input is bound once through a one-element list lambda
    return f"list_transform([CAST({expr} AS DOUBLE)], lambda v: ({r}) / {sc})[1]"


def sql_fmt(expr: str, digits: int, sign: bool = False) -> str:
    return f"printf('%{'+' if sign else ''}.{digits}f', {sql_py_round(expr, digits)})"


def sql_age_group(age: str = "age") -> str:
    b, labels = C.AGE_BINS, C.AGE_LABELS
    parts = [f"WHEN {age} >= {D(b[0])} AND {age} <= {D(b[1])} THEN '{labels[0]}'"]
    for lo, hi, lab in zip(b[1:-1], b[2:], labels[1:]):
        parts.append(f"WHEN {age} > {D(lo)} AND {age} <= {D(hi)} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


def sql_age_group_ord(age: str = "age") -> str:
    b = C.AGE_BINS
    parts = [f"WHEN {age} >= {D(b[0])} AND {age} <= {D(b[1])} THEN 0"]
    for i, (lo, hi) in enumerate(zip(b[1:-1], b[2:]), start=1):
        parts.append(f"WHEN {age} > {D(lo)} AND {age} <= {D(hi)} THEN {i}")
    return "CAST(CASE " + " ".join(parts) + " END AS INTEGER)"


def sql_clip(expr: str, lo: float, hi: float) -> str:
    return f"least(greatest(CAST({expr} AS DOUBLE), {D(lo)}), {D(hi)})"


def sql_risk_score(age="age", dc="drug_count", udc="unique_drug_count", rc="reaction_count",
                   poly="polypharmacy", rep="drug_repeat_flag", rounding: str = "numpy") -> str:
    names = {"age": age, "drug_count": dc, "unique_drug_count": udc, "reaction_count": rc}
    total = None
    for name, upper, weight in C.RISK_SCORE_TERMS:
        term = f"(({sql_clip(names[name], 0.0, upper)} / {D(upper)}) * {D(weight)})"
        total = term if total is None else f"({total} + {term})"
    flags = (f"CAST(CAST({poly} AS INTEGER) * {C.POLYPHARMACY_POINTS} "
             f"+ CAST({rep} AS INTEGER) * {C.REPEAT_POINTS} AS DOUBLE)")
    if rounding == "python":
        return sql_py_round(f"{total} + {flags}", 2)
    return sql_round_even(f"{total} + {flags}", 2)


def sql_risk_level(p: str) -> str:
    return (f"CASE WHEN {p} < {D(C.RISK_LOW_CUT)} THEN 'Low' "
            f"WHEN {p} < {D(C.RISK_MEDIUM_CUT)} THEN 'Medium' ELSE 'High' END")


def sql_to_number(expr: str) -> str:
    e = f"CAST({expr} AS VARCHAR)"
    return (f"CASE WHEN regexp_matches({e}, '{NUMERIC_PATTERN}') "
            f"THEN TRY_CAST(trim({e}) AS DOUBLE) END")


def _missing_names() -> str:
    return ", ".join(f"'{n}'" for n in C.MISSING_DRUG_NAMES)


CASE_CTES = {
    **{k: v for k, v in ADAPTER_SQL.items()},
    "demo_clean": f"""
SELECT primaryid, age, sex FROM (
  SELECT CAST(primaryid AS BIGINT) AS primaryid, {sql_to_number('age')} AS age,
         upper(trim(sex)) AS sex
  FROM demo) d
WHERE primaryid IS NOT NULL AND age > {D(0)} AND age < {D(120)} AND sex IN ('M', 'F')""",
    "drug_norm": f"""
SELECT primaryid, drugname,
       CASE WHEN upper(trim(drugname)) IN ({_missing_names()}) THEN NULL
            ELSE upper(trim(drugname)) END AS drugname_norm
FROM drug WHERE primaryid IS NOT NULL""",
    "drug_agg": """
SELECT primaryid, CAST(count(*) AS INTEGER) AS drug_count,
       CAST(count(DISTINCT drugname_norm) AS INTEGER) AS unique_drug_count,
       CAST(CASE WHEN count(*) > count(DISTINCT drugname_norm) THEN 1 ELSE 0 END AS INTEGER) AS drug_repeat_flag
FROM drug_norm GROUP BY primaryid""",
    "serious_agg": """
SELECT DISTINCT primaryid, CAST(1 AS INTEGER) AS serious FROM outc WHERE primaryid IS NOT NULL""",
    "reac_agg": """
SELECT primaryid, CAST(count(*) AS INTEGER) AS reaction_count
FROM reac WHERE primaryid IS NOT NULL GROUP BY primaryid""",
    "joined": """
SELECT d.primaryid, d.age, d.sex,
       CAST(coalesce(a.drug_count, 0) AS INTEGER) AS drug_count,
       CAST(coalesce(a.unique_drug_count, 0) AS INTEGER) AS unique_drug_count,
       CAST(coalesce(a.drug_repeat_flag, 0) AS INTEGER) AS drug_repeat_flag,
       CAST(coalesce(r.reaction_count, 0) AS INTEGER) AS reaction_count,
       CAST(coalesce(s.serious, 0) AS INTEGER) AS serious
FROM demo_clean d
LEFT JOIN drug_agg a ON a.primaryid = d.primaryid
LEFT JOIN serious_agg s ON s.primaryid = d.primaryid
LEFT JOIN reac_agg r ON r.primaryid = d.primaryid""",
    "flagged": f"""
SELECT *, CAST(CASE WHEN drug_count >= {C.POLYPHARMACY_THRESHOLD} THEN 1 ELSE 0 END AS INTEGER) AS polypharmacy,
          CAST(CASE WHEN age >= {D(C.ELDERLY_THRESHOLD)} THEN 1 ELSE 0 END AS INTEGER) AS elderly
FROM joined""",
    "cases": f"""
SELECT primaryid, age, sex, drug_count, unique_drug_count, drug_repeat_flag, reaction_count,
       serious, polypharmacy, elderly, {sql_age_group('age')} AS age_group,
       CAST(CASE WHEN sex = 'F' THEN 0 WHEN sex = 'M' THEN 1 END AS INTEGER) AS sex_code,
       {sql_risk_score()} AS risk_score,
       CASE WHEN serious = 0 THEN 'Non-serious' WHEN serious = 1 THEN 'Serious' END AS severity_label
FROM flagged""",
}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Full oracle text: adapter + case-table CTEs (+ query CTEs), then ``body``."""
    ctes = dict(CASE_CTES)
    if extra:
        ctes.update(extra)
    parts = [f"{name} AS ({text.strip()})" for name, text in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
