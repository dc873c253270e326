"""Operator 2: quotation linking of messages (built-in functions only).

Lines of a message are its own or quoted; the level is the number of ``>`` in front. A line's passage is its text
without the marks, lower-cased, with blanks collapsed. The original of a passage is the first message of the same
list that wrote it as its own line; a quoted passage is joined to it by its hash if that message is earlier. A
message answers the original that its lowest linked level quotes most characters of (ties: the later one).
Following answers up gives the conversation (its first message) and the depth; conversations come out in reply
order (conversation, depth, time, id), with the messages' own text only.

Input: ``list_id, message_id, sent_at, body``; other columns are ignored. Null bodies count as empty; rows without
message_id or sent_at are left alone: no links, a conversation of their own. Repeated rows count as one message
(least body). Hot passages and lists are no problem for the counts, which are pre-aggregated, and the join on
(list, hash) has one row per key on one side, so Spark can split the other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import cut

MARKS = r"^[ \t]*((?:>[ \t]*)*)"
ATTRIBUTION = r"^on .{1,200} wrote:$"


def lines(messages: DataFrame) -> DataFrame:
    """One row per line: ``line_no, level, passage`` (empty lines too) and its text without marks."""
    parts = messages.select("list_id", "message_id", "sent_at", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n")).alias("line_no", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    text = F.regexp_replace("line", MARKS, "")
    return parts.select("list_id", "message_id", "sent_at", "line_no", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), text.alias("said"),
                        F.trim(F.lower(F.regexp_replace(text, r"[ \t\r]+", " "))).alias("passage")).withColumn("hash", F.md5(F.col("passage").cast("binary")))


def originals(told: DataFrame) -> DataFrame:
    """First message of each list that wrote a passage itself."""
    own = told.where(f"level = 0 AND passage <> '' AND NOT passage RLIKE '{ATTRIBUTION}' AND sent_at IS NOT NULL AND message_id IS NOT NULL")
    first = own.groupBy("list_id", "hash").agg(F.min(F.struct("sent_at", "message_id")).alias("first"))
    return first.select("list_id", "hash", F.col("first.sent_at").alias("origin_at"), F.col("first.message_id").alias("origin_id"))


def quotations(messages: DataFrame) -> DataFrame:
    """Quoted passages with their original: ``list_id, message_id, line_no, level, passage, origin_id`` (null: none)."""
    told = lines(messages)
    quoted = told.where("level > 0 AND passage <> ''").alias("q")
    o = originals(told).alias("o")
    return quoted.join(o, F.col("q.list_id").eqNullSafe(F.col("o.list_id")) & (F.col("q.hash") == F.col("o.hash"))
                       & (F.col("o.origin_at") < F.col("q.sent_at")), "left").select(
        "q.list_id", "q.message_id", "q.sent_at", "line_no", "level", "passage", "origin_id", "origin_at")


def _up(parents: DataFrame) -> DataFrame:
    """``list_id, node, root, depth`` by doubling the steps; only messages that are not at their first one go on.

    An answer is later than what it answers, so there is no cycle. Each round is checkpointed.
    """
    go = cut(parents.select("list_id", F.col("message_id").alias("node"), F.coalesce("parent_id", "message_id").alias("root"),
                            F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), F.col("parent_id").isNull().alias("done")))
    done, go = go.where("done"), go.where("NOT done")
    while go.limit(1).count():
        up = done.union(go).select(F.col("list_id").alias("l"), F.col("node").alias("mid"), F.col("root").alias("top"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        new = cut(go.join(up, F.col("list_id").eqNullSafe(F.col("l")) & (F.col("root") == F.col("mid")), "left").select(
            "list_id", "node", F.coalesce("top", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.coalesce("ends", F.lit(True)).alias("done")))
        done, go = done.union(new.where("done")), new.where("NOT done")
    return done.drop("done")


def conversations(messages: DataFrame) -> DataFrame:
    """``conversation_id, depth, sent_at, message_id, list_id, parent_id, n_quoted, n_linked, deepest, own_text`` in reply order."""
    need = messages.select("list_id", "message_id", "sent_at", F.coalesce("body", F.lit("")).alias("body"))
    named = need.where("message_id IS NOT NULL").groupBy("list_id", "message_id").agg(F.min(F.struct("sent_at", "body")).alias("m"))
    named = cut(named.select("list_id", "message_id", "m.sent_at", "m.body"))
    links = quotations(named)
    each = links.groupBy("list_id", "message_id", "level", "origin_id", "origin_at").agg(
        F.count(F.lit(1)).alias("quoted"), F.sum(F.length("passage")).alias("chars"))
    best = F.max(F.when(F.col("origin_id").isNotNull(), F.struct((-F.col("level")).alias("near"), "chars", "origin_at", "origin_id")))
    told = cut(each.groupBy("list_id", "message_id").agg(
        best["origin_id"].alias("parent_id"), F.sum("quoted").alias("n_quoted"),
        F.sum(F.when(F.col("origin_id").isNotNull(), F.col("quoted")).otherwise(0)).alias("n_linked"), F.max("level").alias("deepest")))
    m, t = named.alias("m"), told.alias("t")
    same = F.col("m.list_id").eqNullSafe(F.col("t.list_id")) & (F.col("m.message_id") == F.col("t.message_id"))
    full = m.join(t, same, "left").select("m.*", "parent_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_quoted", "n_linked", "deepest")))
    top = _up(full.select("list_id", "message_id", "parent_id")).alias("u")
    f = full.alias("f")
    own = F.concat_ws("\n", F.filter(F.split("body", "\n"), lambda x: ~x.rlike(r"^[ \t]*>") & ~F.lower(F.trim(x)).rlike(ATTRIBUTION)))
    out = f.join(top, F.col("f.list_id").eqNullSafe(F.col("u.list_id")) & (F.col("f.message_id") == F.col("u.node"))).select(
        F.col("root").alias("conversation_id"), F.col("depth").cast("long").alias("depth"), "sent_at", "message_id", "f.list_id", "parent_id",
        "n_quoted", "n_linked", "deepest", F.trim(F.regexp_replace(own, r"\n{2,}", "\n")).alias("own_text"))
    alone = need.where("message_id IS NULL").select(
        F.lit(None).cast("string").alias("conversation_id"), F.lit(0).cast("long").alias("depth"), "sent_at", "message_id", "list_id",
        F.lit(None).cast("string").alias("parent_id"), *(F.lit(0).cast("long").alias(c) for c in ("n_quoted", "n_linked", "deepest")),
        F.trim(F.regexp_replace(own, r"\n{2,}", "\n")).alias("own_text"))
    return out.union(alone).orderBy("conversation_id", "depth", "sent_at", "message_id")
