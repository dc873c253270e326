"""Operator 6: secret scans, base patterns and a randomness test battery.

Base spans come from three patterns over whole texts. The method looks at every other run of 16 or
more token characters, and at every run of 16 or more between '-' and '_' inside it, infers its encoding
(digits, hex, letters or letters and digits of one case, base32, alphanumeric, base64: the smallest
alphabet that holds it), and tests whether its characters are drawn evenly and independently from that alphabet:

* chi-squared of the character counts over cells of the alphabet (uniformity),
* a runs test of "upper half / lower half" of the alphabet,
* lag-one serial correlation of the character values,

each a p-value; Fisher's method combines the three. Evidence for a secret is two-sided: the token must
not be rejected as random, and it must be unlikely as prose. The second part is a p-value as well: under
the character models of ordinary words (letters alone, and letters by the one before; the likelier
one counts), the likelihood ratio (uniform alphabet against the model) exceeds
x with a probability of at most 1/x, so 1/ratio is a valid p-value, and it shrinks with the length of
the token. Plain digits are as likely in ordinary numbers, so they are never found by themselves. A part
is reported only where its whole token isn't. Benjamini-Hochberg runs within bands of length over all candidates of the corpus, from counts
of p-values rounded up to half powers of two: nothing but one small table per band meets in one place.

Null and empty texts have no spans; repeated rows each give a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casekit.llm.common import cut, held, slices, texts

#: Kinds in order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs of 24 and more
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Alphabets from the smallest to the largest.
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (("digits", "0123456789"), ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("lower", _AZ.lower()), ("upper", _AZ),
             ("base32", _AZ + "234567"), ("base32 lower", _AZ.lower() + "234567"),
             ("alnum lower", "0123456789" + _AZ.lower()), ("alnum upper", "0123456789" + _AZ),
             ("alnum", "0123456789" + _AZ + _AZ.lower()), ("base64", _AZ + _AZ.lower() + "0123456789+/-_"))
PART = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")
#: Prose model: share of a character by its class when the class stays, and the cost of a change of class (nats).
ENGLISH = dict(zip("etaoinsrhldcumfpgwybvkxjqz",
                   (12.0, 9.1, 8.1, 7.7, 7.3, 7.0, 6.3, 6.0, 5.9, 4.3, 4.0, 3.9, 2.9, 2.6, 2.3, 2.1, 2.0, 1.9, 1.7, 1.5,
                    1.1, 0.9, 0.2, 0.15, 0.1, 0.1)))
#: Letters that often follow a letter, the most frequent first.
FOLLOW = dict(zip("abcdefghijklmnopqrstuvwxyz", (
    "ntlrscdmbgiyup", "eoluariys", "hoetkaiulr", "eioasuryl", "rnsdalcmtiu", "oeirafutl", "ehroiauln", "eaiotruy", "ntsocledragm", "uoae",
    "eisnal", "eliayodsut", "eaopibmu", "dtgeosciak", "nurfmtlwspvokd", "eroalipuhst", "u", "eoiatsydnu", "teihsoaupcl", "hioeartsuy",
    "nrstlpcemg", "eiao", "aheionr", "tpcia", "osetmaid", "eaiouzy")))
PAIRED = 0.75  # share of letters that follow the table
STAY, BAND, CELLS = 0.93, 8, 120
CAND = ("start", "end", "band", "cell", "whole_band", "whole_cell")
LEVEL, RANDOM_LEVEL = 0.001, 0.001  # false-discovery rate, and the battery's level


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _prose(c: str) -> float:
    if c.isalpha():
        return ENGLISH[c.lower()] / 100
    return 0.1 if c.isdigit() else 0.25


_PROSE = {c: math.log(_prose(c)) for c in dict(ALPHABETS)["base64"]}
_PAIR = {a + b: math.log((1 - PAIRED) * ENGLISH[b] / 100 + (PAIRED / (1 + after.index(b)) / sum(1 / (1 + i) for i in range(len(after))) if b in after else 0))
         for a, after in FOLLOW.items() for b in ENGLISH}
_PLACE = {alphabet: {c: i for i, c in enumerate(alphabet)} for _, alphabet in ALPHABETS}
_CHARS = [(name, alphabet, frozenset(alphabet)) for name, alphabet in ALPHABETS]
_STAY, _MOVE = math.log(STAY), math.log((1 - STAY) / 3)


def encoding(token: str) -> tuple[str, str]:
    """Name and alphabet of the smallest encoding that holds the token (padding aside)."""
    chars = set(token.rstrip("="))
    for name, alphabet, held_by in _CHARS:
        if chars <= held_by:
            return name, alphabet
    return ALPHABETS[-1]


def _chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared (Wilson-Hilferty)."""
    z = ((max(x, 0) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation under "drawn evenly from its alphabet"."""
    _, alphabet = encoding(token)
    place = _PLACE[alphabet]
    v = np.array([place[c] for c in token.rstrip("=")], float)
    n, size = len(v), len(alphabet)
    cells = max(2, min(16, n // 4, size))
    got = np.bincount((v * cells // size).astype(int), minlength=cells)
    share = np.bincount((np.arange(size) * cells // size), minlength=cells) / size
    p_even = _chi2_tail(float(((got - n * share) ** 2 / (n * share)).sum()), cells - 1)
    high = v >= size / 2
    a, b = int(high.sum()), int((~high).sum())
    if a and b:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * a * b / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        p_runs = math.erfc(abs(runs - mean) / spread / math.sqrt(2))
    else:
        p_runs = 2.0 ** (1 - n)
    d = v - (size - 1) / 2
    corr = float((d[1:] * d[:-1]).sum() / ((size * size - 1) / 12))
    p_corr = math.erfc(abs(corr) / math.sqrt(n - 1) / math.sqrt(2))
    return p_even, p_runs, p_corr


def fisher(ps) -> float:
    """Fisher's combined p-value of three tests (chi-squared with six degrees of freedom, exact)."""
    x = -sum(math.log(max(p, 1e-300)) for p in ps)
    return math.exp(-x) * (1 + x + x * x / 2)


def log_ratio(token: str) -> float:
    """Log likelihood ratio of "drawn evenly from its alphabet" against the likelier prose model."""
    body = token.rstrip("=")
    even = -math.log(len(encoding(token)[1])) * len(body)
    moves = alone = paired = 0.0
    before, last = None, ""
    for c in body:
        k = _class(c)
        moves += 0 if before is None else _STAY if k == before else _MOVE
        alone += _PROSE[c]
        paired += _PAIR.get(last + c.lower(), _PROSE[c])
        before, last = k, c.lower()
    return even - moves - max(alone, paired)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _cell(token: str, random_level: float) -> int:
    """Cell of the p-value (p <= 2^(-cell/2)); 0 if the battery rejects the token as random."""
    cell = min(CELLS, max(0, math.floor(2 * log_ratio(token) / math.log(2))))
    return 0 if cell and fisher(battery(token)) < random_level else cell


def candidates(text: str, base, random_level: float) -> list[tuple[int, int, int, int, int, int]]:
    """(start, end, length band, cell of the p-value, band and cell of the whole token) of tokens, and of their parts,
    that touch no base span; for a whole token the last cell is -1."""
    out = []
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))

    def free(a, b):
        k = bisect_left(starts, b)  # base spans that start before b
        return len(set(text[a:b])) >= 6 and not (k and ends[k - 1] > a)

    def band(a, b):
        return min((b - a) // BAND, 64)

    for m in TOKEN.finditer(text):
        a, b, whole = m.start(), m.end(), (0, -1)
        if free(a, b):
            whole = band(a, b), _cell(m[0], random_level)
            out.append((a, b, *whole, 0, -1))
        if "-" in m[0] or "_" in m[0]:
            for p in PART.finditer(text, a, b):
                if p.span() != m.span() and free(*p.span()):
                    out.append((*p.span(), band(*p.span()), _cell(p[0], random_level), *whole))
    return out


def _scan(docs: DataFrame, random_level: float) -> DataFrame:
    """``doc_id, base, cand`` of every row: base spans and candidates of whole texts."""
    def run(batches):
        held(None, lambda: None)  # frees what other operators keep in this worker
        for batch in batches:
            for part in slices(batch, "text"):
                base, cand = [], []
                for t in texts(part, "text"):
                    b = base_spans(t)
                    base.append([{"start": s, "kind": k, "end": e} for s, k, e in b])
                    cand.append([dict(zip(CAND, x)) for x in candidates(t, b, random_level)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(base, pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "kind", "end")]))),
                     pa.array(cand, pa.list_(pa.struct([(c, pa.int32()) for c in CAND])))],
                    ["doc_id", "base", "cand"])

    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return need.mapInArrow(run, "doc_id long, base array<struct<start:int,kind:int,end:int>>, "
                                "cand array<struct<" + ",".join(f"{c}:int" for c in CAND) + ">>")


def find(docs: DataFrame, level: float = LEVEL, random_level: float = RANDOM_LEVEL) -> DataFrame:
    """``doc_id, base, found``: arrays of (start, kind, end); ``level``: false-discovery rate.

    The texts are scanned once; the spans (without the texts) are checkpointed, as the limits need all of them.
    """
    scanned = cut(_scan(docs, random_level))
    limits = _collected(scanned, level)
    if limits:
        table = F.create_map(*(F.lit(v) for kv in limits.items() for v in kv))
        passes = lambda x, of: x[f"{of}cell"] >= F.coalesce(table[x[f"{of}band"]], F.lit(CELLS + 1))
        kept = F.filter("cand", lambda x: passes(x, "") & ~passes(x, "whole_"))
    else:
        kept = F.expr("filter(cand, x -> false)")
    found = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return scanned.select("doc_id", "base", found.alias("found"))


def redact(docs: DataFrame, level: float = LEVEL, random_level: float = RANDOM_LEVEL) -> DataFrame:
    """``docs`` with every found span (overlapping ones as one) replaced by ``[secret]``; ``n_chars`` follows if there is one.

    Two scans of the texts, the first for the limits alone, and no shuffle of texts.
    """
    limits = _collected(_scan(docs, random_level), level)

    def clean(text):
        spans = base_spans(text)
        more = [(s, 3, e) for s, e, d, c, _, _ in candidates(text, spans, random_level) if c >= limits.get(d, CELLS + 1)]
        out, at = [], 0
        for s, _, e in sorted(spans + more):
            if s >= at:
                out += [text[at:s], "[secret]"]
            at = max(at, e)
        return "".join(out) + text[at:] if out else text

    def run(batches):
        held(None, lambda: None)  # frees what other operators keep in this worker
        for batch in batches:
            for part in slices(batch, "text"):
                old = part.column(part.schema.get_field_index("text")).to_pylist()
                new = [None if t is None else clean(t) for t in old]
                cols = [pa.array(new, f.type) if f.name == "text" else
                        pa.array([n if a is b or a == b else len(b) for n, a, b in zip(part.column(i).to_pylist(), old, new)], f.type)
                        if f.name == "n_chars" else part.column(i) for i, f in enumerate(part.schema)]
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def _collected(scanned: DataFrame, level: float) -> dict[int, int]:
    return {r.band: r.cell for r in _limits(scanned, level).collect()}  # one row per band, 65 at most


def _limits(scanned: DataFrame, level: float) -> DataFrame:
    """Benjamini-Hochberg in each band of length: the lowest cell whose p-value passes at its rank."""
    cells = scanned.select(F.explode("cand").alias("c")).groupBy("c.band", "c.cell").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("band").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.select("band", "cell", F.sum("n").over(down).alias("rank"),
                          F.sum("n").over(Window.partitionBy("band")).alias("total"))
    return ranked.where((F.col("cell") > 0) & (F.pow(F.lit(2.0), -F.col("cell") / 2) <= level * F.col("rank") / F.col("total"))
                        ).groupBy("band").agg(F.min("cell").alias("cell"))


def _joined(spans) -> F.Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    one = lambda x: F.concat(F.element_at(kinds, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"),
                             x["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def scan(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random``."""
    got = find(docs, level)
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return got.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                      F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      _joined(F.array_sort(F.concat("base", "found"))).alias("spans"),
                      F.size("found").cast("long").alias("n_random"))
