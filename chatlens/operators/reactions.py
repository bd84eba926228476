"""Reactions and mentions.

Reactions and mentions are aggregated per message (or per pair of ids)
first; only those small aggregates meet messages and users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.columns import round_ratio
from chatlens.operators.common import in_window, narrow, top_k, with_content

DESC, ASC = F.desc_nulls_last, F.asc_nulls_first


def _names(users: DataFrame, id_col: str, name_col: str = "username") -> DataFrame:
    return users.select(F.col("id").alias(id_col), F.col("username").alias(name_col))


def top_emojis(emojis: DataFrame, reactions: DataFrame, k: int | None = 15) -> DataFrame:
    cnt = reactions.groupBy(F.col("emoji_id").alias("eid")).agg(
        F.count("emoji_id").alias("usage_count"))
    j = emojis.select(F.col("id").alias("eid"), F.col("name").alias("emoji"), "is_custom") \
        .join(cnt, "eid", "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0)))
    return top_k(j, [DESC("usage_count"), ASC("eid")], k).select("emoji", "is_custom", "usage_count")


def popular_emojis(reactions: DataFrame, emojis: DataFrame, k: int | None = 10) -> DataFrame:
    cnt = reactions.groupBy(F.col("emoji_id").alias("eid")).agg(
        F.count(F.lit(1)).alias("usage_count"))
    j = cnt.join(emojis.select(F.col("id").alias("eid"), "name"), "eid")
    return top_k(j, [DESC("usage_count"), ASC("eid")], k).select("name", "usage_count")


def custom_vs_unicode(emojis: DataFrame, reactions: DataFrame) -> DataFrame:
    cnt = reactions.groupBy(F.col("emoji_id").alias("eid")).agg(F.count("emoji_id").alias("n"))
    j = emojis.select(F.col("id").alias("eid"), "is_custom").join(cnt, "eid", "left")
    return j.groupBy("is_custom").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("usage_count"),
        F.countDistinct("eid").alias("unique_emojis")).select(
        F.when(F.col("is_custom"), "Custom").otherwise("Unicode").alias("emoji_type"),
        "usage_count", "unique_emojis")


def most_reacted_messages(messages: DataFrame, users: DataFrame, channels: DataFrame,
                          reactions: DataFrame, k: int | None = 10, preview: int = 50) -> DataFrame:
    cnt = reactions.groupBy(F.col("message_id").alias("id")).agg(
        F.count(F.lit(1)).alias("reaction_count"))
    m = narrow(messages).join(cnt, "id") \
        .join(_names(users, "author_id", "author"), "author_id") \
        .join(channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel")),
              "channel_id")
    order = [DESC("reaction_count"), ASC("id")]
    return with_content(top_k(m, order, k), messages, order).select(
        "author", "channel", "reaction_count",
        F.substring("content", 1, preview).alias("content_preview"))


def most_reacted_messages_all(messages: DataFrame, users: DataFrame, reactions: DataFrame,
                              k: int | None = 20, preview: int = 50) -> DataFrame:
    cnt = reactions.groupBy(F.col("message_id").alias("id")).agg(
        F.count(F.lit(1)).alias("reaction_count"))
    m = narrow(messages).join(_names(users, "author_id", "author"), "author_id") \
        .join(cnt, "id", "left").withColumn("reaction_count", F.coalesce("reaction_count", F.lit(0)))
    order = [DESC("reaction_count"), ASC("id")]
    return with_content(top_k(m, order, k), messages, order).select(
        "id", F.substring("content", 1, preview).alias("preview"), "author", "reaction_count")


def _reaction_edges(reactions: DataFrame, messages: DataFrame) -> DataFrame:
    return reactions.join(messages.select(F.col("id").alias("message_id"), "author_id", "server_id"),
                          "message_id")


def reaction_pairs(reactions: DataFrame, messages: DataFrame, users: DataFrame, server_id: int,
                   k: int | None = 10) -> DataFrame:
    e = _reaction_edges(reactions, messages).filter(
        (F.col("server_id") == server_id) & (F.col("user_id") != F.col("author_id")))
    cnt = e.groupBy("user_id", "author_id").agg(F.count(F.lit(1)).alias("reaction_count"))
    j = cnt.join(_names(users, "user_id", "reactor"), "user_id") \
           .join(_names(users, "author_id", "message_author"), "author_id")
    return top_k(j, [DESC("reaction_count"), ASC("user_id"), ASC("author_id")], k).select(
        "reactor", "message_author", "reaction_count")


def reaction_patterns(reactions: DataFrame, messages: DataFrame, users: DataFrame,
                      emojis: DataFrame, server_id: int, days: int = 7, as_of=None,
                      k: int | None = 20) -> DataFrame:
    e = _reaction_edges(reactions.filter(in_window("reacted_at", as_of, days, strict=True)),
                        messages).filter((F.col("server_id") == server_id)
                                         & (F.col("user_id") != F.col("author_id")))
    e = e.join(emojis.select(F.col("id").alias("emoji_id"), F.col("name").alias("emoji")), "emoji_id")
    per = e.groupBy("user_id", "author_id").agg(F.count(F.lit(1)).alias("n"),
                                                 F.collect_set("emoji").alias("em"))
    j = per.join(_names(users, "user_id", "reactor"), "user_id") \
           .join(_names(users, "author_id", "message_author"), "author_id")
    g = j.groupBy("reactor", "message_author").agg(
        F.sum("n").alias("reaction_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("em")))).alias("emojis_used"))
    return top_k(g, [DESC("reaction_count"), ASC("reactor"), ASC("message_author")], k)


def self_reactions(reactions: DataFrame, messages: DataFrame) -> DataFrame:
    e = _reaction_edges(reactions, messages)
    return e.filter(F.col("user_id") == F.col("author_id")).agg(
        F.count(F.lit(1)).alias("self_reaction_count"))


def most_mentioned(mentions: DataFrame, users: DataFrame, k: int | None = 10) -> DataFrame:
    cnt = mentions.groupBy(F.col("mentioned_user_id").alias("uid")).agg(
        F.count(F.lit(1)).alias("times_mentioned"))
    j = cnt.join(users.select(F.col("id").alias("uid"), "username", "global_name"), "uid")
    return top_k(j, [DESC("times_mentioned"), ASC("uid")], k).select(
        "username", "global_name", "times_mentioned")


def _mention_edges(mentions: DataFrame, messages: DataFrame) -> DataFrame:
    return mentions.join(messages.select(F.col("id").alias("message_id"), "author_id",
                                         "created_at"), "message_id")


def mentioners(messages: DataFrame, users: DataFrame, mentions: DataFrame,
               k: int | None = 10) -> DataFrame:
    e = _mention_edges(mentions, messages)
    per = e.groupBy(F.col("author_id").alias("uid")).agg(
        F.countDistinct("mentioned_user_id").alias("unique_users_mentioned"),
        F.count(F.lit(1)).alias("total_mentions"))
    j = per.join(users.select(F.col("id").alias("uid"), "username", "global_name"), "uid")
    return top_k(j, [DESC("total_mentions"), ASC("uid")], k).select(
        "username", "global_name", "unique_users_mentioned", "total_mentions")


def tag_happy(messages: DataFrame, users: DataFrame, min_messages: int = 20,
              k: int | None = 10) -> DataFrame:
    per = messages.groupBy(F.col("author_id").alias("uid")).agg(
        F.coalesce(F.sum("mention_count"), F.lit(0)).cast("long").alias("mentions_given"),
        F.count(F.lit(1)).alias("total_msgs"))
    j = per.filter(F.col("total_msgs") >= min_messages).join(
        users.select(F.col("id").alias("uid"), "username"), "uid")
    j = j.withColumn("mentions_per_msg", round_ratio(F.col("mentions_given"), F.col("total_msgs"), 2))
    return top_k(j, [DESC("mentions_given"), ASC("uid")], k).select(
        "username", "mentions_given", "total_msgs", "mentions_per_msg")


def self_mentions(mentions: DataFrame, messages: DataFrame) -> DataFrame:
    e = _mention_edges(mentions, messages)
    return e.filter(F.col("mentioned_user_id") == F.col("author_id")).agg(
        F.count(F.lit(1)).alias("self_mention_count"))


def everyone_mentions(messages: DataFrame, users: DataFrame) -> DataFrame:
    per = messages.filter(F.col("mentions_everyone")).groupBy(F.col("author_id").alias("uid")).agg(
        F.count(F.lit(1)).alias("everyone_mention_count"))
    j = per.join(users.select(F.col("id").alias("uid"), F.col("username").alias("author")), "uid")
    return top_k(j, [DESC("everyone_mention_count"), ASC("uid")], None).select(
        "everyone_mention_count", "author")


def mention_network(mentions: DataFrame, messages: DataFrame, users: DataFrame,
                    k: int | None = 20) -> DataFrame:
    """Who mentions whom, self mentions dropped, grouped by usernames."""
    e = _mention_edges(mentions, messages).filter(F.col("author_id") != F.col("mentioned_user_id"))
    cnt = e.groupBy("author_id", "mentioned_user_id").agg(F.count(F.lit(1)).alias("n"))
    j = cnt.join(_names(users, "author_id", "from_user"), "author_id") \
           .join(_names(users, "mentioned_user_id", "to_user"), "mentioned_user_id")
    g = j.groupBy("from_user", "to_user").agg(F.sum("n").alias("mention_count"))
    return top_k(g, [DESC("mention_count"), ASC("from_user"), ASC("to_user")], k)


def mention_network_all(mentions: DataFrame, messages: DataFrame, users: DataFrame,
                        k: int | None = 20) -> DataFrame:
    """Self mentions kept, grouped by ids."""
    e = _mention_edges(mentions, messages)
    cnt = e.groupBy("author_id", "mentioned_user_id").agg(F.count(F.lit(1)).alias("mention_count"))
    j = cnt.join(_names(users, "author_id", "mentioner"), "author_id") \
           .join(_names(users, "mentioned_user_id", "mentioned_user"), "mentioned_user_id")
    return top_k(j, [DESC("mention_count"), ASC("author_id"), ASC("mentioned_user_id")], k).select(
        "mentioner", "mentioned_user", "mention_count")
