"""Readers and writers for report files (O-1, O-3, O-4).

Quarterly report files are ``$``-delimited, Latin-1, with a header line.
Rows with *more* fields than the header are skipped and rows with fewer
are padded with nulls; quoted fields may hold separators and line ends
(see ``records``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit.sources import records

# fixed values: strings pandas reads as missing by default
PANDAS_NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _na_to_null(c: str):
    return F.when(F.col(c).isin(*PANDAS_NA_VALUES), F.lit(None).cast("string")).otherwise(F.col(c))


def read_delimited(spark: SparkSession, path: str, sep: str = "$", encoding: str = "ISO-8859-1",
                   header: list[str] | None = None) -> DataFrame:
    """All columns as strings (ids and numbers are cast by the operators).

    ``header`` defaults to the first record of the first file (one line read
    on the driver, as any schema discovery does); records equal to the header
    are headers of further files.
    """
    if header is None:
        first = records.lines(spark, path, encoding).where(F.trim("value") != "").select("value").first()
        if first is None:
            raise ValueError(f"empty input: {path}")
        header = records.parse([first["value"]], sep)[0]
    n, names = len(header), [h.strip() for h in header]
    fields = F.col("fields")
    rows = records.read_fields(spark, path, sep, encoding)
    rows = rows.where((F.size(fields) <= n) & (fields != F.array(*[F.lit(h) for h in header])))
    rows = rows.select(*[F.get(fields, F.lit(i)).alias(f"c{i}") for i in range(n)])
    return rows.select(*[_na_to_null(f"c{i}").alias(h) for i, h in enumerate(names)])


def load_sources(spark: SparkSession, directory: str, files: dict[str, str], **kw) -> dict[str, DataFrame]:
    """The four report tables (demo/drug/outc/reac) from their files in ``directory``."""
    return {name: read_delimited(spark, f"{directory.rstrip('/')}/{fname}", **kw) for name, fname in files.items()}


#: One option set for the reader and the writer: doubled quotes, blanks kept, no backslash escapes.
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """O-3: a comma CSV with a header; strings only, pandas' missing markers as null."""
    df = spark.read.options(**CSV).option("inferSchema", False).option("multiLine", True).csv(path)
    return missing_to_null(df)


def missing_to_null(df: DataFrame) -> DataFrame:
    """Text columns with pandas' missing markers as null."""
    return df.select(*[_na_to_null(c).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """O-4: CSV sink with a header (one file per partition, written in parallel)."""
    df.write.mode(mode).options(**CSV).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
