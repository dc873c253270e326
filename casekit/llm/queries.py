"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit.llm import alignment, bpe, clusters, fingerprint, licenses, mixing, ngram_join, quality, quotes, revisits, secrets, topk, toxicity
from casekit.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def messages_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in mail archive: each turn quotes the one before, and every second one the one before that as well."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    back = lambda n, name: c.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(name))
    both = c.join(back(1, "one"), ["conv_id", "turn"], "left").join(back(2, "two"), ["conv_id", "turn"], "left")
    mark = lambda col, m: F.concat(F.lit("\n" + m), F.regexp_replace(col, "\n", "\n" + m))
    deep = F.when((F.col("turn") % 2 == 0) & F.col("two").isNotNull(), mark("two", "> > ")).otherwise("")
    body = F.concat("text", F.when(F.col("one").isNotNull(), mark("one", "> ")).otherwise(""), deep)
    return both.select(F.col("conv_id").alias("list_id"), F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("turn").alias("sent_at"), body.alias("body"))


def op2_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(messages_from_conversations(spark, sf_dir))


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), alone=True)


def records_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in WARC records: a response for each page, and up to two revisits under other spellings of its URL."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    at = F.lit(1_700_000_000) + F.pmod(F.xxhash64("page_id"), F.lit(2_000_000))
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 16), F.lit('"'))
    first = p.select(F.concat(F.lit("r-"), F.col("page_id").cast("string")).alias("record_id"), F.lit("response").alias("warc_type"),
                     F.col("url").alias("target_uri"), at.alias("warc_date"), F.lit(200).alias("http_status"), tag.alias("etag"),
                     F.lit(None).cast("string").alias("last_modified"),
                     F.array(header("Content-Type", F.lit("text/html")), header("ETag", tag), header("Date", at.cast("string"))).alias("headers"),
                     F.col("html").alias("payload"))
    n = F.pmod(F.xxhash64("url"), F.lit(3)).cast("int")
    again = p.withColumn("k", F.explode(F.sequence(F.lit(0), n))).where("k > 0")
    other = F.when(F.col("k") == 1, F.concat(F.col("url"), F.lit("#again"))).otherwise(F.regexp_replace("url", "^http", "HTTP"))
    seen = F.when(F.pmod(F.col("page_id") + F.col("k"), F.lit(7)) == 0, F.lit('"other"')).otherwise(tag)
    later = at + F.col("k") * 50_000 - 20_000
    second = again.select(F.concat_ws("-", F.lit("v"), F.col("page_id").cast("string"), F.col("k").cast("string")).alias("record_id"), F.lit("revisit").alias("warc_type"),
                          other.alias("target_uri"), later.alias("warc_date"), F.lit(304).alias("http_status"), seen.alias("etag"),
                          F.lit(None).cast("string").alias("last_modified"),
                          F.array(header("Date", later.cast("string")), header("Cache-Control", F.lit("max-age=60")),
                                  header("Content-Length", F.lit("0"))).alias("headers"), F.lit(None).cast("string").alias("payload"))
    return first.unionByName(second)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = revisits.resolve(records_from_pages(spark, sf_dir))
    shown = F.concat_ws("\n", F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), F.coalesce(h["value"], F.lit("")))))
    return got.select("record_id", "canonical_url", "original_id", "verdict", shown.alias("headers"),
                      F.sha2(F.col("payload").cast("binary"), 256).alias("payload_sha256"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def files_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in source tree: documents as files of two directory levels below their source; some are license files."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    name = F.when(h % 8 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.lit(".txt")))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.when(h % 3 > 0, F.concat(F.lit("d"), (F.floor(h / 1000)).cast("string"))),
                         F.when(h % 3 > 1, F.concat(F.lit("e"), (F.floor(h / 100) % 10).cast("string"))))
    return d.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(files_from_documents(spark, sf_dir))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_rules, op2_quote_threads, op3_poisson_mix, op4_bpe_round_trip, op5_warc_revisits, op6_secret_scan, op7_toxicity,
    op8_weighted_fingerprints, op9_ngram_join, op10_license_scan, op11_exact_topk,
    op12_token_alignment, op13_bisector_clusters)}
ORACLE: dict[str, str] = {"op3_poisson_mix": mixing.oracle(), "op11_exact_topk": topk.oracle(), "op13_bisector_clusters": clusters.oracle()}
