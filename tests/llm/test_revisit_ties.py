"""Repeated record ids, empty tables and clashing columns for the operators on stand-in records."""

import hashlib

import pytest
from pyspark.sql import functions as F

from casekit.llm import quotes, revisits

RECORD = ("record_id string, warc_type string, target_uri string, warc_date long, http_status int, etag string, last_modified string, "
          "headers array<struct<name:string,value:string>>, payload string, verdict string, canonical_url int, url string, at string, row_id string")
X = ("x", 7, "u", "z", "r")  # clashing extra columns


def test_a_response_is_known_by_id_url_and_time(spark):
    rows = [("a", "response", "http://x.com/1", 10, 200, '"1"', None, [], "one", *X), ("a", "response", "http://x.com/2", 10, 200, '"2"', None, [], "two", *X),
            ("a", "response", "http://x.com/2", 5, 200, '"0"', None, [], "older", *X),
            ("b", "response", "http://x.com/3", 10, 200, None, None, [], "p", *X), ("b", "response", "http://x.com/3", 10, 200, None, None, [], "q", *X),
            ("v", "revisit", "http://x.com/1", 20, 304, '"1"', None, [], None, *X), ("v", "revisit", "http://x.com/2", 20, 304, '"2"', None, [], None, *X),
            ("v", "revisit", "http://x.com/2", 7, 304, None, None, [], None, *X), ("w", "revisit", "http://x.com/3", 200_000, 304, None, None, None, None, *X),
            ("w", "revisit", "http://x.com/3", 200_000, 304, None, None, None, None, *X), (None, "revisit", "http://x.com/3", 20, 304, None, None, None, None, *X)]
    least = min("pq", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    for n in (1, 5):
        got = revisits.resolve(spark.createDataFrame(rows, RECORD).repartition(n)).collect()
        assert sorted((r.record_id or "", r.canonical_url, r.payload or "") for r in got) == sorted([
            ("v", "http://x.com/1", "one"), ("v", "http://x.com/2", "two"), ("v", "http://x.com/2", "older"), ("w", "http://x.com/3", least),
            ("w", "http://x.com/3", least), ("", "http://x.com/3", "")])


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_empty_tables_repeats_and_clashing_columns(spark, kind):
    records = spark.createDataFrame([], RECORD)
    assert revisits.resolve(records).collect() == []
    schema = "list_id string, message_id string, sent_at long, body string, root string, depth string, level string, conversation_id int"
    rows = [] if kind == "empty" else [("L", "a", 1, "first words here", "x", "y", "z", 1), ("L", "a", 1, "first words here", "x", "y", "z", 1),
                                       (None, "b", 2, "> first words here", "x", "y", "z", 1), ("L", "c", 3, "> first words here\nown", "x", "y", "z", 1),
                                       ("L", "d", None, "> own", "x", "y", "z", 1), ("L", "e", 9, "> " * 50 + "first words here " + "w" * 50_000, "x", "y", "z", 1)]
    got = {(r.list_id, r.message_id): (r.parent_id, r.conversation_id) for r in quotes.conversations(spark.createDataFrame(rows, schema)).collect()}
    assert got == ({} if kind == "empty" else {("L", "a"): (None, "a"), (None, "b"): (None, "b"), ("L", "c"): ("a", "a"), ("L", "d"): (None, "d"), ("L", "e"): (None, "e")})
    assert quotes.conversations(spark.createDataFrame(rows, schema).where(F.lit(False))).collect() == []
