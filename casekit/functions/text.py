"""Render the fixed text templates of ``config`` as Spark columns or SQL.

A template is a Python format string. ``render`` turns it into one
``concat`` of literals and formatted columns (numbers with Python's
rounding and formatting rules, null when any field is null), and
``render_sql`` into the equivalent SQL expression for the oracle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from casekit.functions import columns as X


def _pieces(template: str):
    for literal, field, spec, _conv in string.Formatter().parse(template):
        yield literal, field, spec or ""


def _digits(spec: str) -> tuple[int, bool]:
    sign = spec.startswith("+")
    body = spec.lstrip("+")
    if not (body.startswith(".") and body.endswith("f")):
        raise ValueError(f"unsupported format spec: {spec!r}")
    return int(body[1:-1]), sign


def render(template: str, bind: bool = True, rounded: bool = False, digits: bool = False, **fields: Column | str) -> Column:
    """``rounded=True``: the numeric fields already hold Python-rounded values at the
    template's precision, so they are formatted without rounding them again.
    ``digits=True``: common numbers are put together from their digits (``columns.printed``)."""
    parts: list[Column] = []
    for literal, field, spec in _pieces(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        v = X.col_(fields[field]) if isinstance(fields[field], str) else fields[field]
        if spec:
            d, sign = _digits(spec)
            if rounded:
                parts.append(X.printed(v.cast("double"), d, sign, digits))
            else:
                parts.append(X.fmt_fixed(v, d, sign=sign, bind=bind, digits_only=digits))
        else:
            parts.append(v.cast("string"))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def sql_literal(text: str) -> str:
    """A SQL string literal (quotes doubled, line feeds as chr(10))."""
    chunks = text.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{c}'" for c in chunks) if len(chunks) > 1 else f"'{chunks[0]}'"


def render_sql(template: str, **fields: str) -> str:
    from casekit.plans.oracle import sql_fmt
    parts: list[str] = []
    for literal, field, spec in _pieces(template):
        if literal:
            parts.append(sql_literal(literal))
        if field is None:
            continue
        e = fields[field]
        if spec:
            d, sign = _digits(spec)
            parts.append(sql_fmt(e, d, sign))
        else:
            parts.append(f"CAST({e} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"
