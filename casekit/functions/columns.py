"""Column expressions shared by every operator.

All of these are built-in Spark expressions (whole-stage codegen, no
Python at run time); they take and return ``Column`` objects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casekit import config as C

# A number as pandas ``to_numeric`` accepts it: Spark's cast would also take
# "45d" / "45f" (Java literal suffixes), so the text is checked first.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()``: all leading/trailing white space, not only blanks."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def norm_upper(c: str | Column) -> Column:
    """``upper().strip()`` as the reference applies to codes and names."""
    return py_strip(F.upper(col_(c)))


def to_number(c: str | Column) -> Column:
    """``pd.to_numeric(errors='coerce')`` for strings and numbers -> double or null."""
    c = col_(c)
    as_text = c.cast("string")
    return F.when(as_text.rlike(NUMERIC_PATTERN), py_strip(as_text).try_cast("double"))


def rint_round(c: str | Column, digits: int) -> Column:
    """NumPy/pandas rounding: ``rint(x * 10^d) / 10^d`` (half to even on the scaled value)."""
    scale = float(10 ** digits)
    return F.rint(col_(c) * F.lit(scale)) / F.lit(scale)


def clip(c: str | Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col_(c).cast("double"), F.lit(float(lo))), F.lit(float(hi)))


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int; null stays null."""
    return cond.cast("int")


def risk_score(age: str | Column = "age", drug_count: str | Column = "drug_count",
               unique_drug_count: str | Column = "unique_drug_count",
               reaction_count: str | Column = "reaction_count",
               polypharmacy: str | Column = "polypharmacy",
               drug_repeat_flag: str | Column = "drug_repeat_flag", rounding: str = "numpy") -> Column:
    """Composite risk score 0..100, two decimals (O-9).

    Summed in the reference's order so the double result is bit-identical.
    ``rounding``: "numpy" for the case table (pandas ``.round``), "python"
    for scores of hand-entered / uploaded cases (scalar ``round``).
    """
    cols = {"age": age, "drug_count": drug_count, "unique_drug_count": unique_drug_count,
            "reaction_count": reaction_count}
    total = None
    for name, upper, weight in C.RISK_SCORE_TERMS:
        term = (clip(cols[name], 0.0, upper) / F.lit(upper)) * F.lit(weight)
        total = term if total is None else total + term
    flags = (col_(polypharmacy).cast("int") * F.lit(C.POLYPHARMACY_POINTS)
             + col_(drug_repeat_flag).cast("int") * F.lit(C.REPEAT_POINTS))
    raw = total + flags.cast("double")
    if rounding == "none":
        return raw
    return py_round(raw, 2) if rounding == "python" else rint_round(raw, 2)


def age_group(age: str | Column = "age") -> Column:
    """Right-closed bins, lowest edge included; outside -> null (``pd.cut``)."""
    a = col_(age)
    bins, labels = C.AGE_BINS, C.AGE_LABELS
    expr = F.when((a >= F.lit(float(bins[0]))) & (a <= F.lit(float(bins[1]))), F.lit(labels[0]))
    for lo, hi, label in zip(bins[1:-1], bins[2:], labels[1:]):
        expr = expr.when((a > F.lit(float(lo))) & (a <= F.lit(float(hi))), F.lit(label))
    return expr


def age_group_ord(age: str | Column = "age") -> Column:
    """Ordinal 0..6 of ``age_group`` (category order), null outside."""
    a = col_(age)
    bins = C.AGE_BINS
    expr = F.when((a >= F.lit(float(bins[0]))) & (a <= F.lit(float(bins[1]))), F.lit(0))
    for i, (lo, hi) in enumerate(zip(bins[1:-1], bins[2:]), start=1):
        expr = expr.when((a > F.lit(float(lo))) & (a <= F.lit(float(hi))), F.lit(i))
    return expr


def sex_code(sex: str | Column = "sex") -> Column:
    s = col_(sex)
    return F.when(s == "F", F.lit(0)).when(s == "M", F.lit(1))


def sex_from_code(code: str | Column = "sex_code") -> Column:
    c = col_(code)
    return F.when(c == 0, F.lit("F")).when(c == 1, F.lit("M"))


def severity_label(serious: str | Column = "serious") -> Column:
    s = col_(serious)
    return F.when(s == 0, F.lit("Non-serious")).when(s == 1, F.lit("Serious"))


def yes_no(c: str | Column) -> Column:
    c = col_(c)
    return F.when(c == 1, F.lit("Yes")).when(c == 0, F.lit("No"))


def risk_level(p: str | Column) -> Column:
    """Low / Medium / High; NaN and null fall through to High like ``float`` compares."""
    p = col_(p)
    return (F.when(p.isNotNull() & ~F.isnan(p) & (p < F.lit(C.RISK_LOW_CUT)), F.lit("Low"))
            .when(p.isNotNull() & ~F.isnan(p) & (p < F.lit(C.RISK_MEDIUM_CUT)), F.lit("Medium"))
            .otherwise(F.lit("High")))


_SPLIT = 134217729.0  # 2^27 + 1 (Veltkamp split of a double into two 26-bit halves)


def py_round(c: str | Column, digits: int, bind: bool = True) -> Column:
    """Python ``round(x, d)``: the double's exact decimal value, ties to even.

    ``p = x * 10^d`` is correctly rounded; its exact error comes from
    Dekker's product (Veltkamp split, all steps exact in double), so an
    apparent tie ``p = k + 0.5`` is resolved by the sign of that error.
    NumPy's rule (``rint_round``) differs exactly on those ties (2.675).
    """
    if digits == 0:
        return F.rint(col_(c).cast("double"))
    scale = F.lit(float(10 ** digits))

    def body(x: Column) -> Column:
        p = x * scale
        t = x * F.lit(_SPLIT)
        xh = t - (t - x)
        xl = x - xh
        err = (xh * scale - p) + xl * scale  # exact value of x*10^d - p
        tie = (p - F.floor(p)) == F.lit(0.5)
        r = F.when(tie & (err > 0), F.ceil(p).cast("double")).when(tie & (err < 0), F.floor(p).cast("double")) \
            .otherwise(F.rint(p))
        return r / scale
    # bind the input once (a one-element transform acts as a let): the body
    # refers to it many times and inputs are often large expressions; a cheap
    # input (a column or lambda variable) is used directly (bind=False)
    x = col_(c).cast("double")
    return let(x, body) if bind else body(x)


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and apply ``fn`` to it (no expression duplication)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def apart(c: str | Column) -> Column:
    """``c`` itself, in a projection that Spark compiles by itself, in small methods.

    Whole-stage code is one method for all fused operators; beyond 8,000 bytes of bytecode the JVM interprets it on every
    row. Spark leaves a projection with a lambda out of it, so a long projection holds one cheap column of this kind.
    """
    return let(col_(c), lambda x: x)


def printed(v: Column, digits: int, sign: bool = False, digits_only: bool = False) -> Column:
    """A double that is already rounded to ``digits``, as text; null stays null.

    ``format_string`` parses its pattern and makes a decimal for every value. With ``digits_only`` values from 1 to 10^12 are
    put together from their digits instead, which gives the same text."""
    text = F.when(v.isNotNull(), F.format_string(f"%{'+' if sign else ''}.{digits}f", v))
    if not digits_only or sign:
        return text
    scale = F.lit(10 ** digits).cast("bigint")
    k = F.rint(v * F.lit(float(10 ** digits))).cast("bigint")
    plain = F.concat(F.call_function("div", k, scale).cast("string"), F.lit("."), F.lpad((k % scale).cast("string"), digits, "0")) \
        if digits else k.cast("string")
    return F.when((v >= 1.0) & (v < 1e12), plain).otherwise(text)


def fmt_fixed(c: str | Column, digits: int, sign: bool = False, bind: bool = True, digits_only: bool = False) -> Column:
    """Python ``f'{x:.Nf}'`` (``:+.Nf`` with ``sign``); null stays null.

    ``format_string`` rounds the shortest decimal form half-up and prints
    null as "null"; rounding first with Python's exact rule leaves it a
    value it prints verbatim.
    """
    def body(v: Column) -> Column:
        return printed(py_round(v, digits, bind=False), digits, sign, digits_only)
    x = col_(c).cast("double")
    return let(x, body) if bind else body(x)
