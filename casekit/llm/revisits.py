"""Operator 5: WARC not-modified revisits, resolved by an as-of join on the canonical URL.

Input records: ``record_id, warc_type, target_uri, warc_date`` (seconds), ``http_status, etag, last_modified,
headers`` (array of name, value) and ``payload``; other columns are ignored. Each revisit record is joined to the
latest earlier full response (type response, status 200) of the same canonical URL (ties in time: the larger
record_id). If the revisit names an ETag it must equal the response's (weak comparison), else a named Last-Modified
must; a revisit without validators is resolved as "unvalidated". The resolved record has the response's payload and
headers, of which those that a 304 answer may update are replaced by the revisit's.

The as-of join runs on ids, URLs and times alone, in two steps: within (URL, day), and from the days before through
one row per (URL, day), so a hot URL is spread over its days; payloads are fetched afterwards by record_id. Null or
malformed URLs and null dates resolve to nothing ("no_original"); repeated rows each give a row; of several responses
with one record_id, URL and time the one with the least hash of its payload counts; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified answer may update, and tracking parameters.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#\s]*)(\?[^#\s]*)?"
PERIOD = 86_400


def canonical(url: F.Column) -> F.Column:
    """Scheme and host in lower case, no default port, no fragment, no tracking parameters, the rest in order; null if malformed."""
    scheme, host = F.lower(F.regexp_extract(url, _URL, 1)), F.lower(F.regexp_extract(url, _URL, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(url, _URL, 3)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    pairs = F.split(F.substring(F.regexp_extract(url, _URL, 4), 2, 1 << 30), "&")
    query = F.concat_ws("&", F.array_sort(F.filter(pairs, lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def as_of(revisits: DataFrame, responses: DataFrame) -> DataFrame:
    """``row_id, url, at`` of each revisit with ``hit`` (time and id): the latest earlier response of its URL.

    Both sides: ``url, at, id`` (revisits: ``row_id`` too); ``url`` and ``at`` not null.
    """
    both = (responses.select("url", "at", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("row_id"), F.struct("at", "id").alias("hit"))
            .unionByName(revisits.select("url", "at", F.lit(1).alias("kind"), "row_id", F.lit(None).cast("struct<at:long,id:string>").alias("hit"))))
    both = both.withColumn("period", F.floor(F.col("at") / PERIOD))
    # a response of the same second is not earlier: revisits sort first
    inside = Window.partitionBy("url", "period").orderBy("at", F.desc("kind"), "hit.id").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("near", F.last("hit", ignorenulls=True).over(inside)).where("kind = 1")
    last = both.where("kind = 0").groupBy("url", "period").agg(F.max("hit").alias("last"))
    asked = seen.where("near IS NULL").select("url", "period").distinct()
    days = last.select("url", "period", "last").unionByName(asked.select("url", "period", F.lit(None).cast("struct<at:long,id:string>").alias("last")))
    before = Window.partitionBy("url").orderBy("period").rangeBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("carry", F.last("last", ignorenulls=True).over(before)).where("last IS NULL").select("url", "period", "carry")
    got = seen.where("near IS NOT NULL").select("row_id", "url", "at", F.col("near").alias("hit"))
    days = days.groupBy("url", "period").agg(F.max("carry").alias("carry"))
    far = seen.where("near IS NULL").join(days, ["url", "period"], "left").select("row_id", "url", "at", F.col("carry").alias("hit"))
    return got.unionByName(far)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: ``record_id, canonical_url, original_id, verdict, headers, payload``."""
    need = records.select(F.col("record_id").cast("string").alias("record_id"), F.lower("warc_type").alias("warc_type"), "http_status",
                          canonical(F.col("target_uri")).alias("url"), F.col("warc_date").cast("long").alias("at"), "etag", "last_modified",
                          "headers", "payload")
    revisit = need.where("warc_type = 'revisit'").drop("payload")
    full = need.where("warc_type = 'response' AND http_status = 200 AND record_id IS NOT NULL")
    ids = revisit.where("url IS NOT NULL AND at IS NOT NULL").select("url", "at", F.col("record_id").alias("row_id")).where("row_id IS NOT NULL").distinct()
    found = as_of(ids, full.where("url IS NOT NULL AND at IS NOT NULL").select("url", "at", F.col("record_id").alias("id")))
    found = found.where("hit IS NOT NULL").select("row_id", F.col("url").alias("of_url"), F.col("at").alias("of_at"), F.col("hit.id").alias("hit_id"), F.col("hit.at").alias("hit_at"))
    one = F.min(F.struct(F.md5(F.coalesce("payload", F.lit("")).cast("binary")).alias("hash"), "etag", "last_modified", "headers", "payload"))
    kept = full.where("url IS NOT NULL AND at IS NOT NULL").groupBy("record_id", "url", "at").agg(one.alias("r"))
    o = kept.select(F.col("record_id").alias("o_id"), F.col("url").alias("o_url"), F.col("at").alias("o_at"), F.col("r.etag").alias("o_etag"),
                    F.col("r.last_modified").alias("o_last"), F.col("r.headers").alias("o_headers"), F.col("r.payload").alias("o_payload"))
    got = revisit.join(found, (F.col("record_id") == F.col("row_id")) & (F.col("url") == F.col("of_url")) & (F.col("at") == F.col("of_at")), "left")
    got = got.join(o, (F.col("hit_id") == F.col("o_id")) & (F.col("url") == F.col("o_url")) & (F.col("hit_at") == F.col("o_at")), "left")
    tag = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    verdict = (F.when(F.col("o_id").isNull(), "no_original")
               .when(F.col("etag").isNotNull(), F.when(tag("etag") == tag("o_etag"), "resolved").otherwise("validator_mismatch"))
               .when(F.col("last_modified").isNotNull(), F.when(F.trim("last_modified") == F.trim("o_last"), "resolved").otherwise("validator_mismatch"))
               .otherwise("unvalidated"))
    low = lambda a: F.transform(F.coalesce(F.col(a), F.array().cast("array<struct<name:string,value:string>>")),
                                lambda h: F.struct(F.lower(F.trim(h["name"])).alias("name"), h["value"].alias("value")))
    may = F.filter(low("headers"), lambda h: h["name"].isin(*PERMITTED))
    stay = F.filter(low("o_headers"), lambda h: ~F.exists(may, lambda p: p["name"] == h["name"]))
    ok = F.col("verdict").isin("resolved", "unvalidated")
    return got.withColumn("verdict", verdict).select(
        "record_id", F.col("url").alias("canonical_url"), F.col("o_id").alias("original_id"), "verdict",
        F.when(ok, F.array_sort(F.concat(stay, may))).alias("headers"), F.when(ok, F.col("o_payload")).alias("payload"))
