"""Channels.

Messages are aggregated per channel before meeting the channels dimension;
per-channel sequences (gaps) use the skew-safe ``adjacent`` helper, since a
single busy channel may hold a large share of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.columns import channel_type_name, micros_between, round_ratio
from chatlens.operators.common import adjacent, in_window, share, since, top_k, total_of

DESC, ASC = F.desc_nulls_last, F.asc_nulls_first


def _ch(channels: DataFrame, *extra: str) -> DataFrame:
    return channels.select(F.col("id").alias("cid"), F.col("name").alias("channel_name"), *extra)


def _per_channel(messages: DataFrame, *aggs) -> DataFrame:
    return messages.groupBy(F.col("channel_id").alias("cid")).agg(*aggs)


def messages_per_channel(channels: DataFrame, messages: DataFrame) -> DataFrame:
    cnt = _per_channel(messages, F.count("id").alias("message_count"))
    j = _ch(channels).join(cnt, "cid", "left").withColumn(
        "message_count", F.coalesce("message_count", F.lit(0)))
    return top_k(j, [DESC("message_count"), ASC("cid")], None).select(
        "channel_name", "message_count")


def channel_activity(channels: DataFrame, messages: DataFrame) -> DataFrame:
    cnt = _per_channel(messages, F.count("id").alias("message_count"),
                       F.countDistinct("author_id").alias("unique_users"))
    j = _ch(channels).join(cnt, "cid", "left").select(
        "cid", "channel_name", F.coalesce("message_count", F.lit(0)).alias("message_count"),
        F.coalesce("unique_users", F.lit(0)).alias("unique_users"))
    return top_k(j, [DESC("message_count"), ASC("cid")], None).drop("cid")


def server_channel_activity(messages: DataFrame, channels: DataFrame, server_id: int) -> DataFrame:
    cnt = _per_channel(messages.filter(F.col("server_id") == server_id),
                       F.count(F.lit(1)).alias("message_count"))
    j = cnt.join(_ch(channels), "cid")
    return top_k(j, [DESC("message_count"), ASC("cid")], None).select(
        F.col("channel_name").alias("name"), "message_count")


def channel_leaderboard(messages: DataFrame, channels: DataFrame) -> DataFrame:
    total = total_of(messages, F.count(F.lit(1)))
    cnt = _per_channel(messages, F.count(F.lit(1)).alias("message_count"),
                       F.countDistinct("author_id").alias("unique_users"))
    j = cnt.join(_ch(channels), "cid").withColumn("pct", share(F.col("message_count"), total))
    return top_k(j, [DESC("message_count"), ASC("cid")], None).select(
        F.col("channel_name").alias("name"), "message_count", "unique_users", "pct")


def active_channels_recent(channels: DataFrame, messages: DataFrame, as_of=None,
                           days: int = 7, k: int | None = 10) -> DataFrame:
    cnt = _per_channel(messages.filter(in_window("created_at", as_of, days)),
                       F.count(F.lit(1)).alias("message_count"))
    j = cnt.join(_ch(channels), "cid")
    return top_k(j, [DESC("message_count"), ASC("cid")], k).select("channel_name", "message_count")


def top_channels_detail(channels: DataFrame, messages: DataFrame, as_of=None, days: int = 30,
                        k: int | None = 10) -> DataFrame:
    """Window test inside the join: channels without messages stay (zeros)."""
    win = messages.filter(in_window("created_at", as_of, days))
    cnt = _per_channel(win, F.count("id").alias("message_count"),
                       F.countDistinct("author_id").alias("unique_users"),
                       F.sum("char_count").alias("_c"), F.count("char_count").alias("_n"))
    j = _ch(channels).join(cnt, "cid", "left").select(
        "cid", F.col("cid").cast("string").alias("channel_id"), "channel_name",
        F.coalesce("message_count", F.lit(0)).alias("message_count"),
        F.coalesce("unique_users", F.lit(0)).alias("unique_users"),
        F.coalesce(round_ratio(F.col("_c"), F.col("_n"), 1), F.lit(0.0)).alias("avg_message_length"))
    return top_k(j, [DESC("message_count"), ASC("cid")], k).drop("cid")


def _count_children(channels, messages, child, out, k):
    per_msg = child.groupBy("message_id").agg(F.count("message_id").alias("n"))
    per_ch = messages.select(F.col("id").alias("message_id"), F.col("channel_id").alias("cid")) \
        .join(per_msg, "message_id").groupBy("cid").agg(F.sum("n").alias(out))
    j = _ch(channels).join(per_ch, "cid", "left").withColumn(
        out, F.coalesce(out, F.lit(0)).cast("long"))
    return top_k(j, [DESC(out), ASC("cid")], k).select("channel_name", out)


def channel_reactions(channels: DataFrame, messages: DataFrame, reactions: DataFrame,
                      k: int | None = 10) -> DataFrame:
    return _count_children(channels, messages, reactions, "reaction_count", k)


def channel_mentions(channels: DataFrame, messages: DataFrame, mentions: DataFrame,
                     k: int | None = 10) -> DataFrame:
    return _count_children(channels, messages, mentions, "mention_count", k)


def empty_channels(channels: DataFrame, messages: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    recent = messages.filter(in_window("created_at", as_of, days)).select(
        F.col("channel_id").alias("cid")).distinct()
    j = _ch(channels, F.col("type").alias("channel_type")).join(recent, "cid", "left_anti")
    return top_k(j, [ASC("channel_name"), ASC("cid")], None).select("channel_name", "channel_type")


def quiet_channels(channels: DataFrame, messages: DataFrame, max_messages: int = 10) -> DataFrame:
    cnt = _per_channel(messages, F.count("id").alias("total_messages"),
                       F.max("created_at").alias("last_message_at"))
    j = _ch(channels, "type").join(cnt, "cid", "left").withColumn(
        "total_messages", F.coalesce("total_messages", F.lit(0)))
    j = j.filter(F.col("total_messages") < max_messages)
    return top_k(j, [ASC("total_messages"), ASC("cid")], None).select(
        F.col("channel_name").alias("name"), "type", "last_message_at", "total_messages")


def channel_growth_window(channels: DataFrame, messages: DataFrame, as_of=None, days: int = 30,
                          k: int | None = 10) -> DataFrame:
    """Current against previous period in one pass over the two windows."""
    start, prev = since(as_of, days), since(as_of, 2 * days)
    ts = F.col("created_at")
    m = messages.filter(ts >= prev)
    cnt = _per_channel(m, F.count(F.when(ts >= start, 1)).alias("current_period"),
                       F.count(F.when(ts < start, 1)).alias("previous_period"))
    j = cnt.filter((F.col("current_period") > 0) | (F.col("previous_period") > 0)) \
        .join(_ch(channels), "cid")
    cur, pre = F.col("current_period"), F.col("previous_period")
    growth = F.when(pre == 0, F.lit(0.0)).otherwise(share(cur - pre, pre))
    j = j.withColumn("growth_percent", growth)
    return top_k(j, [DESC("current_period"), ASC("cid")], k).select(
        "channel_name", "current_period", "previous_period", "growth_percent")


def channel_daily(channels: DataFrame, messages: DataFrame, k: int | None = 100) -> DataFrame:
    cnt = messages.groupBy(F.col("channel_id").alias("cid"),
                           F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("daily_messages"))
    j = cnt.join(_ch(channels), "cid")
    return top_k(j, [DESC("date"), DESC("daily_messages"), ASC("cid")], k).select(
        "channel_name", "date", "daily_messages")


def channel_message_length(channels: DataFrame, messages: DataFrame,
                           min_messages: int = 10) -> DataFrame:
    cnt = _per_channel(messages, F.count("id").alias("total_messages"),
                       F.sum("word_count").alias("_w"), F.count("word_count").alias("_nw"),
                       F.sum("char_count").alias("_c"), F.count("char_count").alias("_nc"))
    j = cnt.filter(F.col("total_messages") > min_messages).join(_ch(channels), "cid").select(
        "cid", "channel_name", "total_messages",
        round_ratio(F.col("_w"), F.col("_nw"), 1).alias("avg_words"),
        round_ratio(F.col("_c"), F.col("_nc"), 0).alias("avg_chars"))
    return top_k(j, [DESC("avg_words"), ASC("cid")], None).drop("cid")


def channel_overview(channels: DataFrame) -> DataFrame:
    return channels.orderBy(ASC("position"), ASC("id")).select(
        "name", "topic", "position", "is_nsfw", channel_type_name("type").alias("channel_type"))


def channel_detail(channels: DataFrame, messages: DataFrame, channel_id: int, as_of=None,
                   days: int = 30) -> DataFrame:
    """One channel's window figures; zeros when it has no messages, no row
    when the channel is unknown."""
    win = messages.filter((F.col("channel_id") == channel_id)
                          & in_window("created_at", as_of, days))
    a = win.agg(F.count("id").alias("total_messages"),
                F.countDistinct("author_id").alias("unique_users"),
                F.sum("word_count").alias("_w"), F.count("word_count").alias("_nw"),
                F.sum("char_count").alias("_c"), F.count("char_count").alias("_nc"),
                F.count(F.when(F.col("reply_to_message_id").isNotNull(), 1)).alias("reply_count"),
                F.count(F.when(F.col("attachment_count") > 0, 1)).alias("messages_with_attachments"))
    figures = a.select(
        "total_messages", "unique_users",
        F.coalesce(round_ratio(F.col("_w"), F.col("_nw"), 1), F.lit(0.0)).alias("avg_words_per_message"),
        F.coalesce(round_ratio(F.col("_c"), F.col("_nc"), 1), F.lit(0.0)).alias("avg_chars_per_message"),
        "reply_count", "messages_with_attachments")
    # Scalar subqueries over one aggregate; Catalyst merges them into one.
    return channels.filter(F.col("id") == channel_id).select(
        "name", "topic", *[figures.select(c).scalar().alias(c) for c in figures.columns])


def channel_message_gap(messages: DataFrame, channels: DataFrame, min_gaps: int = 10) -> DataFrame:
    """Mean seconds between consecutive messages of a channel."""
    m = messages.select("channel_id", "created_at", "id")
    m = adjacent(m, ["channel_id"], "created_at", "id", ["created_at"], which="prev")
    g = m.filter(F.col("prev_created_at").isNotNull()).withColumn(
        "us", micros_between("prev_created_at", "created_at"))
    per = g.groupBy(F.col("channel_id").alias("cid")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("us").alias("_s"))
    j = per.filter(F.col("_n") > min_gaps).join(_ch(channels), "cid").select(
        "cid", F.col("channel_name").alias("channel"),
        round_ratio(F.col("_s"), F.col("_n") * 1_000_000, 3).alias("avg_seconds_between"))
    return top_k(j, [ASC("avg_seconds_between"), ASC("cid")], None).drop("cid")


def channel_type_names(channels: DataFrame) -> DataFrame:
    return channels.select("id", "type", channel_type_name("type").alias("channel_type"))

