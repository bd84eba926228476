"""Integrity checks and whole-table counts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.columns import micros_between, round_ratio
from chatlens.sources.schema import CHAT_TABLES, KEYS

DAY_US = 86_400_000_000


def table_counts(tables: Mapping[str, DataFrame], names=CHAT_TABLES) -> DataFrame:
    """Row count of each table: one small aggregate per table, unioned."""
    parts = [tables[n].agg(F.count(F.lit(1)).alias("count"))
             .select(F.lit(n).alias("table_name"), "count") for n in names]
    return reduce(DataFrame.unionByName, parts)


def _orphans(child: DataFrame, key: str, parent: DataFrame, pkey: str, out: str) -> DataFrame:
    """Children whose key has no parent row of their tenant; a NULL key counts
    as orphan. Children are counted per key first, so a busy key is one row of
    the join."""
    p = parent.select(F.col("tenant_id").alias("_pt"), F.col(pkey).alias("_pk")).distinct()
    keys = child.groupBy("tenant_id", F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    lost = keys.join(p, (F.col("tenant_id") == F.col("_pt")) & (F.col("_k") == F.col("_pk")), "left_anti")
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(out))


def orphan_messages(messages: DataFrame, users: DataFrame) -> DataFrame:
    return _orphans(messages, "author_id", users, "id", "orphan_messages")


def orphan_reactions(reactions: DataFrame, messages: DataFrame) -> DataFrame:
    return _orphans(reactions, "message_id", messages, "id", "orphan_reactions")


def orphan_mentions(mentions: DataFrame, messages: DataFrame) -> DataFrame:
    return _orphans(mentions, "message_id", messages, "id", "orphan_mentions")


def orphan_channel_refs(messages: DataFrame, channels: DataFrame) -> DataFrame:
    return _orphans(messages, "channel_id", channels, "id", "orphan_channel_refs")


def big_numbers(messages: DataFrame, channels: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row of totals; each figure is one aggregate (scalar subquery)."""
    m = messages.agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.countDistinct("author_id").alias("active_users"),
        F.count("reply_to_message_id").alias("total_replies"),
        F.min("created_at").alias("first_msg"), F.max("created_at").alias("last_msg"))
    return m.select(
        "total_messages", "active_users",
        channels.agg(F.count(F.lit(1))).scalar().alias("channels"),
        mentions.agg(F.count(F.lit(1))).scalar().alias("total_mentions"),
        "total_replies", "first_msg", "last_msg")


def human_totals(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Messages are counted per author first, so a busy one is a row of the join."""
    human_ids = users.filter(~F.coalesce("is_bot", F.lit(False))).select(F.col("id").alias("author_id"))
    wrote = messages.groupBy("author_id").agg(F.count(F.lit(1)).alias("n")).join(human_ids, "author_id")
    m = wrote.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("human_messages"),
                  F.count(F.lit(1)).alias("active_humans"))
    u = users.agg(F.count(F.when(~F.coalesce("is_bot", F.lit(False)), 1)).alias("human_users"),
                  F.count(F.when(F.col("is_bot"), 1)).alias("bot_users"))
    return m.select("human_messages", "active_humans",
                    u.select("human_users").scalar().alias("human_users"),
                    u.select("bot_users").scalar().alias("bot_users"))


def message_span(messages: DataFrame) -> DataFrame:
    a = messages.agg(F.min("created_at").alias("first_message"),
                     F.max("created_at").alias("last_message"))
    return a.select("first_message", "last_message",
                    round_ratio(micros_between("first_message", "last_message"),
                                F.lit(DAY_US), 6).alias("days_span"))


def server_header(servers: DataFrame) -> DataFrame:
    return servers.orderBy("id").limit(1).select("name", "member_count")


def dedup_constraints(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def constraint_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Number of duplicated key values per declared key, all tables."""
    parts = [dedup_constraints(tables[n], KEYS[n]).agg(F.count(F.lit(1)).alias("violations"))
             .select(F.lit(n).alias("table_name"), "violations") for n in KEYS]
    return reduce(DataFrame.unionByName, parts)
