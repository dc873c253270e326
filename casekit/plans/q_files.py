"""Registered file round trips (O-1, O-3, O-4) and the streaming scorer.

The report sources derived from the test tables are written by Spark as
``$``-delimited Latin-1 files (one folder of part files per source, each
with its header line), then read back; the case
table built from the files must equal the one built from the tables.
Narratives with line ends inside quotes make the same trip.
Uploads go through a comma CSV the same way. Files live under the
session's checkpoint folder (shared storage on a cluster).
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit import config as C
from casekit.operators import prepare as P
from casekit.operators import scoring as S
from casekit.plans import oracle as O
from casekit.plans.catalog import cases, register
from casekit.plans.q_scoring import _FEATS, _T, _prep_sql
from casekit.session import ensure_checkpoint_dir
from casekit.sources import delimited as DL
from casekit.sources import fixtures as FX
from casekit.streaming import score_stream as SS

D, RE = O.D, O.sql_round_even
REPORT_FILES = {"demo": "DEMO.txt", "drug": "DRUG.txt", "outc": "OUTC.txt", "reac": "REAC.txt"}
_DONE: dict = {}
_LOCK = threading.RLock()


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/casekit-files/{spark.sparkContext.applicationId}/{name}"


def write_report_files(spark: SparkSession, sf_dir: str) -> str:
    """O-4 in the report format: '$'-separated, Latin-1, header, values written verbatim."""
    key = (spark.sparkContext.applicationId, sf_dir, "reports")
    with _LOCK:
        return _DONE[key] if key in _DONE else _write_reports(spark, sf_dir, key)


def _write_reports(spark: SparkSession, sf_dir: str, key) -> str:
    base = _scratch(spark, f"reports-{abs(hash(sf_dir))}")
    for name, df in FX.sources(spark, sf_dir).items():
        (df.write.mode("overwrite").option("header", True).option("sep", "$")
         .option("encoding", "ISO-8859-1").option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(f"{base}/{REPORT_FILES[name]}"))
    _DONE[key] = base
    return base


def q_case_table_from_files(spark, sf):
    base = write_report_files(spark, sf)
    src = DL.load_sources(spark, base, REPORT_FILES)
    return P.case_table_from_sources(src)


register("case_table_from_files", O.with_ctes("SELECT * FROM cases"))(q_case_table_from_files)


def write_quoted_records(spark: SparkSession, sf_dir: str) -> str:
    """Narratives (the documents) as report records whose quoted text holds line ends, separators and quotes; by id some
    have a field too many, some end early, and some go on after a closing quote."""
    key = (spark.sparkContext.applicationId, sf_dir, "quoted")
    with _LOCK:
        if key not in _DONE:
            quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
            docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
            kind = F.pmod("doc_id", F.lit(11))
            text = F.concat(F.lit('say "$" or\n'), F.col("text"))
            line = F.when(kind == 5, F.concat_ws("$", "doc_id", quoted(F.col("source")), quoted(text), F.lit("one more"))).when(
                kind == 6, F.col("doc_id").cast("string")).when(
                kind == 7, F.concat_ws("$", "doc_id", F.concat(quoted(F.col("source")), F.lit("x")), F.lit("lost"))).otherwise(
                F.concat_ws("$", "doc_id", "source", quoted(text)))
            path = _scratch(spark, f"quoted-{abs(hash(sf_dir))}")
            docs.select(line.alias("value")).write.mode("overwrite").text(path)
            _DONE[key] = path
        return _DONE[key]


def q_quoted_records(spark, sf):
    return DL.read_delimited(spark, write_quoted_records(spark, sf), encoding="UTF-8", header=["doc_id", "source", "text"])


_NA = ", ".join(f"'{v}'" for v in DL.PANDAS_NA_VALUES)
register("quoted_records", f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 11 <> 6 AND source NOT IN ({_NA}) THEN source END AS source,
       CASE WHEN doc_id % 11 <> 6 THEN 'say "$" or' || chr(10) || coalesce(text, '') END AS text
FROM documents WHERE doc_id % 11 NOT IN (5, 7)""")(q_quoted_records)


def write_upload_csv(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, "upload")
    with _LOCK:
        return _DONE[key] if key in _DONE else _write_upload(spark, sf_dir, key)


def _write_upload(spark: SparkSession, sf_dir: str, key) -> str:
    path = _scratch(spark, f"upload-{abs(hash(sf_dir))}")
    up = cases(spark, sf_dir).select("primaryid", "age", "sex", "drug_count", "reaction_count")
    DL.write_csv(up, path)
    _DONE[key] = path
    return path


def q_batch_score_from_csv(spark, sf):
    """O-3 -> O-14 -> O-79: read the uploaded CSV (strings), validate, score."""
    up = DL.read_upload(spark, write_upload_csv(spark, sf))
    ok = P.validate_upload(up).first()
    if not ok["is_valid"]:
        raise ValueError(ok["message"])
    return S.batch_score(up.drop("primaryid"), threshold=_T)


register("batch_score_from_csv", O.with_ctes(f"""
SELECT {_FEATS}, CASE WHEN risk_score / {D(100)} >= {D(_T)} THEN 'Serious' ELSE 'Non-serious' END AS predicted_label,
       {RE(f'risk_score / {D(100)}', 4)} AS predicted_probability, {O.sql_risk_level(f'risk_score / {D(100)}')} AS risk_category
FROM prep""", {"prep": _prep_sql("cases")}))(q_batch_score_from_csv)


def q_stream_score_cases(spark, sf) -> DataFrame:
    """Structured Streaming over the uploaded CSV folder: drain it once into a Parquet sink."""
    src = write_upload_csv(spark, sf)
    sink, ckpt = _scratch(spark, f"stream-sink-{abs(hash(sf))}"), _scratch(spark, f"stream-ckpt-{abs(hash(sf))}")
    key = (spark.sparkContext.applicationId, sf, "stream")
    with _LOCK:
        if key not in _DONE:
            q = SS.run_to_parquet(SS.scored_stream(spark, src), sink, ckpt)
            q.awaitTermination()
            _DONE[key] = sink
    return spark.read.parquet(_DONE[key]).select("primaryid", *C.FEATURE_COLS, "probability", "risk_level",
                                                 "predicted_label", "action", "confidence")


register("stream_score_cases")(q_stream_score_cases)
