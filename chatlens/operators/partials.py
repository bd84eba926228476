"""Mergeable partial roll-ups: what a batch adds to
``user_interactions`` and ``daily_stats``, without a rebuild.

An edge (reply, reaction, mention) needs the message it points at, for its
author, server or time. Edges of a batch are resolved against the stored
messages in the range of their ids; those whose message has not come yet stay
open and are tried again with each later batch. So the roll-ups do not depend
on how the history is cut into batches, or on their order.

A partial row holds count, least and greatest time of a key and a day; partials
of a key are added up when they are read. ``daily_parts`` has a row for each
replied-to author, so the distinct number stays exact when a batch resolves a
reply of an earlier one: that adds a row of no messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.columns import round_ratio
from chatlens.sources.schema import conform


def _schema(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields])


L, S, TS, D = T.LongType(), T.StringType(), T.TimestampNTZType(), T.DateType()
OPEN_EDGES = _schema([("tenant_id", S), ("kind", S), ("message_id", L), ("doer", L), ("other", L), ("server_id", L),
                      ("channel_id", L), ("ts", TS)])
INTERACTION_PARTS = _schema([("tenant_id", S), ("day", D), ("from_user_id", L), ("to_user_id", L), ("server_id", L),
                             ("interaction_type", S), ("n", L), ("first", TS), ("last", TS)])
DAILY_PARTS = _schema([("tenant_id", S), ("day", D), ("server_id", L), ("channel_id", L), ("author_id", L),
                       ("replied_to", L), ("messages", L), ("replies", L), ("words", L)])


def open_edges(messages: DataFrame, reactions: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges of a batch, each with the id of the message that it needs. A reply
    that names its target's author needs none and is left to ``stated``."""
    none = F.lit(None)
    replies = messages.filter(F.col("reply_to_message_id").isNotNull() & F.col("reply_to_author_id").isNull()).select(
        "tenant_id", F.lit("reply").alias("kind"), F.col("reply_to_message_id").alias("message_id"),
        F.col("author_id").alias("doer"), none.cast("long").alias("other"), "server_id", "channel_id",
        F.col("created_at").alias("ts"))
    return replies.unionByName(reactions.select(
        "tenant_id", F.lit("reaction").alias("kind"), "message_id", F.col("user_id").alias("doer"),
        none.cast("long").alias("other"), none.cast("long").alias("server_id"),
        none.cast("long").alias("channel_id"), F.col("reacted_at").alias("ts"))).unionByName(mentions.select(
            "tenant_id", F.lit("mention").alias("kind"), "message_id", none.cast("long").alias("doer"),
            F.col("mentioned_user_id").alias("other"), none.cast("long").alias("server_id"),
            none.cast("long").alias("channel_id"), none.cast("timestamp_ntz").alias("ts")))


def resolve(edges: DataFrame, messages: DataFrame) -> DataFrame:
    """Edges with their message's ``found``, ``author``, ``place`` and ``at``.
    Of the stored messages only the range of the wanted ids is read."""
    bounds = edges.agg(F.min("message_id").alias("lo"), F.max("message_id").alias("hi"))
    target = messages.filter(F.col("id").between(bounds.select("lo").scalar(), bounds.select("hi").scalar())).select(
        "tenant_id", F.col("id").alias("message_id"), F.lit(True).alias("found"), F.col("author_id").alias("author"),
        F.col("server_id").alias("place"), F.col("created_at").alias("at"))
    return edges.join(target, ["tenant_id", "message_id"], "left")


def _partial(acts: DataFrame) -> DataFrame:
    keys = ["tenant_id", "day", "from_user_id", "to_user_id", "server_id", "interaction_type"]
    return (acts.filter(F.col("from_user_id") != F.col("to_user_id")).withColumn("day", F.to_date("ts"))
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")))


def interaction_parts(resolved: DataFrame, messages: DataFrame) -> DataFrame:
    """Partials of a batch's resolved edges and of its replies that state the
    replied-to author themselves."""
    is_mention, is_reply = F.col("kind") == "mention", F.col("kind") == "reply"
    acts = resolved.filter("found").select(
        "tenant_id", F.when(is_mention, F.col("author")).otherwise(F.col("doer")).alias("from_user_id"),
        F.when(is_mention, F.col("other")).otherwise(F.col("author")).alias("to_user_id"),
        F.when(is_reply, F.col("server_id")).otherwise(F.col("place")).alias("server_id"),
        F.col("kind").alias("interaction_type"), F.when(is_mention, F.col("at")).otherwise(F.col("ts")).alias("ts"))
    stated = messages.filter(F.col("reply_to_author_id").isNotNull()).select(
        "tenant_id", F.col("author_id").alias("from_user_id"), F.col("reply_to_author_id").alias("to_user_id"),
        "server_id", F.lit("reply").alias("interaction_type"), F.col("created_at").alias("ts"))
    return _partial(acts.unionByName(stated)).select(*INTERACTION_PARTS.names)


def daily_parts(resolved: DataFrame, messages: DataFrame) -> DataFrame:
    keys = ["tenant_id", "day", "server_id", "channel_id", "author_id", "replied_to"]
    own = messages.select(
        "tenant_id", F.to_date("created_at").alias("day"), "server_id", "channel_id", "author_id",
        F.col("reply_to_author_id").alias("replied_to"), F.lit(1).cast("long").alias("messages"),
        F.col("reply_to_message_id").isNotNull().cast("long").alias("replies"),
        F.coalesce("word_count", F.lit(0)).cast("long").alias("words"))
    zero = F.lit(0).cast("long")
    late = resolved.filter("found AND kind = 'reply' AND author IS NOT NULL").select(
        "tenant_id", F.to_date("ts").alias("day"), "server_id", "channel_id", F.col("doer").alias("author_id"),
        F.col("author").alias("replied_to"), zero.alias("messages"), zero.alias("replies"), zero.alias("words"))
    return own.unionByName(late).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("messages", "replies", "words")]).select(*DAILY_PARTS.names)


def combine_interactions(parts: DataFrame) -> DataFrame:
    g = parts.groupBy("tenant_id", "from_user_id", "to_user_id", "server_id", "interaction_type").agg(
        F.sum("n").alias("interaction_count"), F.min("first").alias("first_interaction"),
        F.max("last").alias("last_interaction"))
    return conform(g, "user_interactions")


def combine_daily(parts: DataFrame) -> DataFrame:
    g = parts.groupBy("tenant_id", F.col("day").cast("timestamp_ntz").alias("day"), "server_id", "channel_id",
                      "author_id").agg(
        F.sum("messages").alias("message_count"), F.countDistinct("replied_to").alias("unique_users_replied_to"),
        F.sum("replies").alias("reply_count"), F.sum("words").alias("total_words"))
    return conform(g.withColumn("avg_words_per_message",
                                round_ratio(F.col("total_words"), F.col("message_count"), 6)), "daily_stats")


def touched_days(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(tenant_id, part) of the days whose edges or messages a deletion changes:
    those of the rows that went or lost their author, of the replies to such
    messages and of the reactions to them."""
    cols = ["tenant_id", "id", "author_id", "created_at"]
    old = before["messages"].select(*cols)
    new = after["messages"].select("tenant_id", "id", F.col("author_id").alias("now"), F.lit(True).alias("kept"))
    changed = (old.join(new, ["tenant_id", "id"], "left")
               .filter(F.col("kept").isNull() | ~F.col("author_id").eqNullSafe(F.col("now"))))
    ids = changed.select("tenant_id", F.col("id").alias("message_id"))
    to_it = before["messages"].filter(F.col("reply_to_message_id").isNotNull()).select(
        "tenant_id", F.col("reply_to_message_id").alias("message_id"), F.col("created_at").alias("ts"))
    reacted = before["reactions"].select("tenant_id", "message_id", "user_id", "emoji_id", F.col("reacted_at").alias("ts"))
    lost = reacted.join(after["reactions"], ["tenant_id", "message_id", "user_id", "emoji_id"], "left_anti")
    tagged = before["message_mentions"].join(
        after["message_mentions"], ["tenant_id", "message_id", "mentioned_user_id"], "left_anti")
    at = old.select("tenant_id", F.col("id").alias("message_id"), F.col("created_at").alias("ts"))
    days = (changed.select("tenant_id", F.col("created_at").alias("ts"))
            .unionByName(to_it.join(ids, ["tenant_id", "message_id"], "left_semi").select("tenant_id", "ts"))
            .unionByName(reacted.join(ids, ["tenant_id", "message_id"], "left_semi").select("tenant_id", "ts"))
            .unionByName(lost.select("tenant_id", "ts"))
            .unionByName(at.join(tagged, ["tenant_id", "message_id"], "left_semi").select("tenant_id", "ts")))
    return days.select("tenant_id", F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("part")).distinct()
