"""Scoring new case files as they arrive (Structured Streaming).

``score_cases`` is stateless (one narrow stage), so the same function that
scores a batch table scores a stream: files dropped in ``input_dir`` are
prepared, scored and appended to a Parquet sink with exactly-once output
(file sink + checkpoint). Nothing stateful is needed, so no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit import config as C
from casekit.operators import prepare as P
from casekit.operators import scoring as S
from casekit.sources import delimited as DL

UPLOAD_SCHEMA = "primaryid string, age string, sex string, drug_count string, reaction_count string"


def _header_schema(spark: SparkSession, input_dir: str) -> str:
    """Text columns named by the header of the files present."""
    names = spark.read.options(**DL.CSV).csv(input_dir).columns
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def scored_stream(spark: SparkSession, input_dir: str, scorer: S.Scorer = S.proxy_scorer,
                  threshold: float = 0.5, schema: str | None = None, fmt: str = "csv",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of scored cases from files in ``input_dir``.

    CSV columns are taken by name from the header (any order, with the optional inputs that
    the batch path trusts); a later file whose header differs fails the stream instead of
    being read by position. An empty folder needs ``schema`` (such as ``UPLOAD_SCHEMA``).
    ``primaryid`` is returned if the files have it.
    """
    if fmt == "csv":
        schema = schema or _header_schema(spark, input_dir)
    reader = spark.readStream.schema(schema or UPLOAD_SCHEMA)
    if fmt == "csv":
        reader = reader.options(**DL.CSV).option("multiLine", True).option("enforceSchema", False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.format(fmt).load(input_dir)
    if fmt == "csv":
        raw = DL.missing_to_null(raw)
    feats = P.prepare_external(raw, C.FEATURE_COLS)
    scored = S.score_cases(feats, scorer, threshold)
    ids = [c for c in raw.columns if c == "primaryid"]
    return scored.select(*ids, *C.FEATURE_COLS, "probability", "risk_level", "predicted_label",
                         F.col("action.action").alias("action"), F.col("confidence.level").alias("confidence"),
                         F.col("explanation.summary").alias("explanation"))


def run_to_parquet(stream: DataFrame, sink_dir: str, checkpoint_dir: str, available_now: bool = True):
    """Start the stream into a Parquet sink; with ``available_now`` it drains the folder and stops."""
    w = stream.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
