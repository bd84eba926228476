"""The two derived roll-ups: who interacts with whom, and
daily activity per (day, server, channel, author)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.columns import round_ratio
from chatlens.sources.schema import conform


def user_interactions(messages: DataFrame, reactions: DataFrame, mentions: DataFrame) -> DataFrame:
    """Union of reply, reaction and mention edges with count, first and last
    time per (tenant, from, to, server, type); self edges and NULL ends
    dropped. Replies use the stored ``reply_to_author_id`` (resolve it first
    with ``resolve_reply_author`` when a loader left it empty). Each edge
    kind is aggregated on its own (partial aggregation before the shuffle)."""
    keys = ["tenant_id", "from_user_id", "to_user_id", "server_id"]

    def agg(df, ts, kind):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("interaction_count"),
                                     F.min(ts).alias("first_interaction"),
                                     F.max(ts).alias("last_interaction")) \
            .withColumn("interaction_type", F.lit(kind))

    rep = messages.filter(F.col("reply_to_author_id").isNotNull()
                          & (F.col("author_id") != F.col("reply_to_author_id"))).select(
        "tenant_id", F.col("author_id").alias("from_user_id"),
        F.col("reply_to_author_id").alias("to_user_id"), "server_id", "created_at")
    # two tenants may hold the same server: the key is (tenant, message id);
    # co-located when both sides are bucketed by it
    of_message = ["tenant_id", "message_id"]
    msg = messages.select("tenant_id", F.col("id").alias("message_id"), "author_id", "server_id",
                          "created_at")
    rea = reactions.join(msg, of_message) \
        .filter(F.col("user_id") != F.col("author_id")).select(
        "tenant_id", F.col("user_id").alias("from_user_id"), F.col("author_id").alias("to_user_id"),
        "server_id", "reacted_at")
    men = mentions.join(msg, of_message) \
        .filter(F.col("author_id") != F.col("mentioned_user_id")).select(
        "tenant_id", F.col("author_id").alias("from_user_id"),
        F.col("mentioned_user_id").alias("to_user_id"), "server_id", "created_at")
    out = agg(rep, "created_at", "reply").unionByName(agg(rea, "reacted_at", "reaction")) \
        .unionByName(agg(men, "created_at", "mention"))
    return conform(out, "user_interactions")


def daily_stats(messages: DataFrame) -> DataFrame:
    day = F.date_trunc("day", "created_at").cast("timestamp_ntz")
    g = messages.groupBy("tenant_id", day.alias("day"), "server_id", "channel_id", "author_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.countDistinct("reply_to_author_id").alias("unique_users_replied_to"),
        F.count(F.when(F.col("reply_to_message_id").isNotNull(), 1)).alias("reply_count"),
        F.sum(F.coalesce("word_count", F.lit(0))).cast("long").alias("total_words"))
    g = g.withColumn("avg_words_per_message",
                     round_ratio(F.col("total_words"), F.col("message_count"), 6))
    return conform(g, "daily_stats")
