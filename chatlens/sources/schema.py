"""Explicit schemas of the chat tables, roll-ups and service tables.

Every table carries ``tenant_id``. Time columns are UTC wall-clock
``TIMESTAMP_NTZ`` values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, I, S, B = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
TS = T.TimestampNTZType()


def _st(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


TENANT = ("tenant_id", S)

SCHEMAS: dict[str, T.StructType] = {
    "servers": _st(TENANT, ("id", L), ("name", S), ("icon_hash", S), ("owner_id", L),
                   ("member_count", I), ("created_at", TS), ("first_synced_at", TS),
                   ("last_synced_at", TS)),
    "users": _st(TENANT, ("id", L), ("username", S), ("discriminator", S), ("global_name", S),
                 ("avatar_hash", S), ("is_bot", B), ("created_at", TS), ("first_seen_at", TS)),
    "server_members": _st(TENANT, ("server_id", L), ("user_id", L), ("nickname", S),
                          ("joined_at", TS), ("is_active", B)),
    "channels": _st(TENANT, ("id", L), ("server_id", L), ("name", S), ("type", I),
                    ("parent_id", L), ("topic", S), ("position", I), ("is_nsfw", B),
                    ("created_at", TS), ("is_archived", B), ("last_synced_at", TS)),
    "messages": _st(TENANT, ("id", L), ("server_id", L), ("channel_id", L), ("author_id", L),
                    ("content", S), ("created_at", TS), ("edited_at", TS), ("message_type", I),
                    ("is_pinned", B), ("is_tts", B), ("reply_to_message_id", L),
                    ("reply_to_author_id", L), ("thread_id", L), ("mentions_everyone", B),
                    ("mention_count", I), ("attachment_count", I), ("embed_count", I),
                    ("has_poll", B), ("word_count", I), ("char_count", I)),
    "message_mentions": _st(TENANT, ("message_id", L), ("mentioned_user_id", L)),
    "emojis": _st(TENANT, ("id", I), ("discord_id", L), ("name", S), ("is_custom", B),
                  ("server_id", L), ("is_animated", B)),
    "reactions": _st(TENANT, ("message_id", L), ("emoji_id", I), ("user_id", L),
                     ("reacted_at", TS), ("is_super_reaction", B)),
    "sync_state": _st(TENANT, ("id", I), ("server_id", L), ("channel_id", L), ("sync_type", S),
                      ("last_message_id", L), ("oldest_message_id", L), ("status", S),
                      ("started_at", TS), ("completed_at", TS), ("message_count", I),
                      ("error_message", S)),
    "user_interactions": _st(TENANT, ("from_user_id", L), ("to_user_id", L), ("server_id", L),
                             ("interaction_type", S), ("interaction_count", L),
                             ("first_interaction", TS), ("last_interaction", TS)),
    "daily_stats": _st(TENANT, ("day", TS), ("server_id", L), ("channel_id", L),
                       ("author_id", L), ("message_count", L), ("unique_users_replied_to", L),
                       ("reply_count", L), ("total_words", L),
                       ("avg_words_per_message", T.DoubleType())),
    "extraction_jobs": _st(("id", S), ("user_id", S), ("guild_id", L), ("status", S),
                           ("sync_days", I), ("messages_extracted", I), ("started_at", TS),
                           ("completed_at", TS), ("error_message", S)),
    "usage_logs": _st(("id", S), ("user_id", S), ("action", S), ("storage_bytes", L),
                      ("created_at", TS)),
    "app_users": _st(("id", S), ("plan", S)),
}

# Primary / unique keys declared by the reference DDL (tenant added).
KEYS: dict[str, list[str]] = {
    "servers": ["tenant_id", "id"],
    "users": ["tenant_id", "id"],
    "server_members": ["tenant_id", "server_id", "user_id"],
    "channels": ["tenant_id", "id"],
    "messages": ["tenant_id", "id"],
    "message_mentions": ["tenant_id", "message_id", "mentioned_user_id"],
    "emojis": ["tenant_id", "name", "server_id"],
    "reactions": ["tenant_id", "message_id", "emoji_id", "user_id"],
    "sync_state": ["tenant_id", "server_id", "channel_id", "sync_type"],
}

CHAT_TABLES = ["servers", "users", "server_members", "channels", "messages",
               "message_mentions", "emojis", "reactions", "sync_state"]


def conform(df: DataFrame, table: str, also: list[str] = ()) -> DataFrame:
    """Select and cast ``df`` to the declared schema (missing columns → NULL),
    and keep the columns ``also`` as they are."""
    schema = SCHEMAS[table]
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols, *also)


def check(df: DataFrame, table: str) -> DataFrame:
    """Raise if ``df`` lacks a declared column or has another type."""
    want = {f.name: f.dataType for f in SCHEMAS[table].fields}
    got = {f.name: f.dataType for f in df.schema.fields}
    bad = [n for n, t in want.items() if got.get(n) != t]
    if bad:
        raise ValueError(f"{table}: columns missing or mistyped: {bad}")
    return df
