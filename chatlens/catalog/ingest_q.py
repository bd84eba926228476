"""Registered ingestion and maintenance queries.

Raw records are rebuilt from the driver-derived tables (``nest_messages``)
and flattened again, so each oracle is the table the rules define.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.catalog.base import AS_OF, SQL_AS_OF, register, since
from chatlens.functions import columns as FC
from chatlens.operators import ingest as G
from chatlens.operators import quality as Q
from chatlens.operators.common import resolve_reply_author
from chatlens.sources.fixtures import TENANT
from chatlens.sources.records import nest_messages, nest_reactor_pages

MSG_COLS = ("tenant_id, id, server_id, channel_id, author_id, content, created_at, edited_at, "
            "message_type, is_pinned, is_tts, reply_to_message_id, reply_to_author_id, thread_id, "
            "mentions_everyone, mention_count, attachment_count, embed_count, has_poll, "
            "word_count, char_count")


def _records(t):
    return nest_messages(t.slim_messages, t.users, t.message_mentions, t.reactions, t.emojis, t.with_texts)


def _pages(t):
    return nest_reactor_pages(t.messages, t.users, t.reactions, t.emojis)


@register("normalize_messages", f"SELECT {MSG_COLS} FROM messages")
def _normalize_messages(t):
    return G.normalize_messages(_records(t), TENANT)


@register("explode_mentions", "SELECT tenant_id, message_id, mentioned_user_id FROM message_mentions")
def _explode_mentions(t):
    return G.explode_mentions(_records(t), TENANT)


@register("explode_reactions", """
SELECT tenant_id, message_id, emoji_id, user_id, reacted_at, is_super_reaction FROM reactions""")
def _explode_reactions(t):
    return G.explode_reactions(_pages(t), t.emojis, TENANT)


@register("users_from_records", f"""
WITH seen AS (
  SELECT author_id AS id, created_at FROM messages WHERE author_id IS NOT NULL
  UNION ALL SELECT mm.mentioned_user_id, m.created_at
            FROM message_mentions mm JOIN messages m ON m.id = mm.message_id
  UNION ALL SELECT user_id, reacted_at FROM reactions),
f AS (SELECT id, MIN(created_at) AS first_seen_at FROM seen GROUP BY id)
SELECT '{TENANT}' AS tenant_id, u.id, u.username, u.discriminator, u.global_name, u.avatar_hash,
       coalesce(u.is_bot, false) AS is_bot,
       make_timestamp(((u.id >> 22) + 1420070400000) * 1000) AS created_at, f.first_seen_at
FROM f JOIN users u ON u.id = f.id""")
def _users_from_records(t):
    return G.users_from_records(_records(t), TENANT, _pages(t))


@register("conform_emojis", """
WITH used AS (SELECT DISTINCT e.name, e.server_id, e.discord_id, e.is_custom, e.is_animated
              FROM reactions r JOIN emojis e ON e.id = r.emoji_id),
old AS (SELECT * FROM emojis WHERE id < 12),
new AS (SELECT u.* FROM used u WHERE NOT EXISTS (
          SELECT 1 FROM old o WHERE o.name IS NOT DISTINCT FROM u.name
                                AND o.server_id IS NOT DISTINCT FROM u.server_id))
SELECT tenant_id, id, discord_id, name, is_custom, server_id, is_animated FROM old
UNION ALL
SELECT 'user_demotenant01', CAST((SELECT max(id) FROM old)
         + ROW_NUMBER() OVER (ORDER BY name NULLS FIRST, server_id NULLS FIRST) AS INTEGER),
       discord_id, name, is_custom, server_id, is_animated FROM new""")
def _conform_emojis(t):
    return G.conform_emojis(t.emojis.filter(F.col("id") < 12), _records(t), TENANT)


def _users_new(t):
    u = t.users
    changed = u.filter(F.col("id") % 7 == 0).withColumn("username", F.upper("username")) \
        .withColumn("global_name", F.lit(None).cast("string")) \
        .withColumn("is_bot", ~F.col("is_bot"))
    added = u.filter(F.col("id") % 50 == 0).withColumn("id", F.col("id") + 1_000_000)
    return changed.unionByName(added)


@register("merge_latest_users", """
SELECT tenant_id, id, CASE WHEN id % 7 = 0 THEN upper(username) ELSE username END AS username,
       discriminator, CASE WHEN id % 7 = 0 THEN NULL ELSE global_name END AS global_name,
       avatar_hash, is_bot, created_at, first_seen_at FROM users
UNION ALL
SELECT tenant_id, id + 1000000, username, discriminator, global_name, avatar_hash, is_bot,
       created_at, first_seen_at FROM users WHERE id % 50 = 0""")
def _merge_latest_users(t):
    return G.merge_latest_users(t.users, _users_new(t))


@register("merge_latest_servers", """
SELECT tenant_id, id, 'renamed' AS name, icon_hash, owner_id + 1 AS owner_id,
       member_count + 1 AS member_count, created_at, first_synced_at,
       last_synced_at + INTERVAL 1 DAY AS last_synced_at FROM servers""")
def _merge_latest_servers(t):
    s = t.servers
    new = s.select("tenant_id", "id", F.lit("renamed").alias("name"), "icon_hash",
                   (F.col("owner_id") + 1).alias("owner_id"),
                   (F.col("member_count") + 1).alias("member_count"),
                   (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"),
                   (F.col("first_synced_at") + F.expr("INTERVAL 1 DAY")).alias("first_synced_at"),
                   (F.col("last_synced_at") + F.expr("INTERVAL 1 DAY")).alias("last_synced_at"))
    return G.merge_latest_servers(s, new)


@register("merge_latest_members", """
SELECT tenant_id, server_id, user_id,
       CASE WHEN user_id % 5 = 0 THEN 'renamed' ELSE nickname END AS nickname,
       joined_at, is_active FROM server_members""")
def _merge_latest_members(t):
    m = t.server_members
    new = m.filter(F.col("user_id") % 5 == 0).withColumn("nickname", F.lit("renamed")) \
        .withColumn("joined_at", F.col("joined_at") + F.expr("INTERVAL 1 DAY")) \
        .withColumn("is_active", F.lit(False))
    old = m.withColumn("is_active", F.lit(True))
    return G.merge_latest_members(old, new)


@register("merge_latest_channels", """
SELECT tenant_id, id, server_id, upper(name) AS name, type, parent_id, topic, position + 100 AS position,
       is_nsfw, created_at, is_archived, last_synced_at FROM channels""")
def _merge_latest_channels(t):
    c = t.channels
    new = c.withColumn("name", F.upper("name")).withColumn("position", F.col("position") + 100) \
        .withColumn("type", F.lit(99)).withColumn("is_nsfw", ~F.col("is_nsfw"))
    return G.merge_latest_channels(c, new)


@register("insert_ignore", "SELECT " + MSG_COLS.replace(
    "content,", "CASE WHEN created_at >= TIMESTAMP '2024-01-20 00:00:00' THEN 'EDITED ' || content "
                "ELSE content END AS content,") + " FROM messages")
def _insert_ignore(t):
    old = t.messages.filter(F.col("created_at") < F.lit("2024-01-20").cast("timestamp_ntz"))
    new = t.slim_messages.filter(F.col("created_at") >= F.lit("2024-01-15").cast("timestamp_ntz"))

    def edited(rows):
        return t.with_texts(rows).withColumn("content", F.concat(F.lit("EDITED "), F.col("content")))

    # a second copy of the batch must not change the result either
    return G.insert_ignore(old, new.unionByName(new), ["tenant_id", "id"], texts=edited)


@register("history_cutoff", f"SELECT id, created_at FROM messages WHERE created_at > {since(7)}")
def _history_cutoff(t):
    return G.history_cutoff(_records(t), as_of=AS_OF, sync_days=7).select("id", "created_at")


@register("history_page", f"""
SELECT id, created_at FROM messages WHERE channel_id = 2
  AND created_at < {since(10)} AND created_at > {since(12)}
ORDER BY created_at, id LIMIT 50""")
def _history_page(t):
    from chatlens.operators.common import since as s
    return G.history_page(t.messages, 2, before=s(AS_OF, 10), after=s(AS_OF, 12),
                          oldest_first=True, limit=50).select("id", "created_at")


@register("extraction_stats", """
SELECT (SELECT COUNT(DISTINCT server_id) FROM messages) AS servers,
       (SELECT COUNT(DISTINCT author_id) FROM messages) AS users,
       (SELECT COUNT(DISTINCT channel_id) FROM messages) AS channels,
       (SELECT COUNT(*) FROM messages) AS messages,
       (SELECT COUNT(*) FROM reactions) AS reactions,
       (SELECT COUNT(*) FROM message_mentions) AS mentions""")
def _extraction_stats(t):
    return G.extraction_stats(_records(t), _pages(t))


@register("messages_per_channel_run", """
SELECT channel_id, COUNT(*) AS count FROM messages GROUP BY channel_id""")
def _messages_per_channel_run(t):
    return G.messages_per_channel_run(_records(t))


@register("sync_state_rollup", """
SELECT tenant_id, CAST(ROW_NUMBER() OVER (PARTITION BY tenant_id ORDER BY server_id, channel_id)
       AS INTEGER) AS id, server_id, channel_id, 'messages' AS sync_type,
       MAX(id) AS last_message_id, MIN(id) AS oldest_message_id, 'completed' AS status,
       MIN(created_at) AS started_at, MAX(created_at) AS completed_at,
       CAST(COUNT(*) AS INTEGER) AS message_count, CAST(NULL AS VARCHAR) AS error_message
FROM messages GROUP BY tenant_id, server_id, channel_id""")
def _sync_state_rollup(t):
    return G.sync_state_rollup(t.messages)


@register("incremental_batch", """
WITH marks AS (SELECT channel_id, MAX(id) AS last_id FROM messages
               WHERE created_at < TIMESTAMP '2024-01-20 00:00:00' GROUP BY channel_id)
SELECT m.id, m.channel_id FROM messages m LEFT JOIN marks k ON k.channel_id = m.channel_id
WHERE k.last_id IS NULL OR m.id > k.last_id""")
def _incremental_batch(t):
    old = t.messages.filter(F.col("created_at") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return G.incremental_batch(t.messages, G.sync_state_rollup(old)).select("id", "channel_id")


@register("snowflake_to_timestamp", """
SELECT id, make_timestamp(((id >> 22) + 1420070400000) * 1000) AS created_at FROM users""")
def _snowflake(t):
    return t.users.select("id", FC.snowflake_to_timestamp("id").alias("created_at"))


@register("display_name", """
SELECT sm.user_id, coalesce(nullif(sm.nickname, ''), nullif(u.global_name, ''), u.username)
         AS display_name
FROM server_members sm JOIN users u ON u.id = sm.user_id""")
def _display_name(t):
    j = t.server_members.join(t.users.withColumnRenamed("id", "user_id"), "user_id")
    return j.select("user_id", FC.display_name("nickname", "global_name", "username")
                    .alias("display_name"))


@register("emoji_text", """
SELECT r.message_id, r.user_id,
       CASE WHEN e.discord_id IS NOT NULL AND e.discord_id <> 0
            THEN '<' || CASE WHEN coalesce(e.is_animated, false) THEN 'a' ELSE '' END || ':'
                 || e.name || ':' || CAST(e.discord_id AS VARCHAR) || '>'
            ELSE e.name END AS emoji_text
FROM reactions r JOIN emojis e ON e.id = r.emoji_id""")
def _emoji_text(t):
    """The text form of every reaction's emoji (as a message would render it)."""
    e = t.emojis.select(F.col("id").alias("emoji_id"),
                        FC.emoji_text("name", "discord_id", "is_animated").alias("emoji_text"))
    return t.reactions.join(e, "emoji_id").select("message_id", "user_id", "emoji_text")


@register("jump_url", """
SELECT id, 'https://discord.com/channels/' || coalesce(CAST(server_id AS VARCHAR), '@me') || '/'
           || CAST(channel_id AS VARCHAR) || '/' || CAST(id AS VARCHAR) AS jump_url FROM messages""")
def _jump_url(t):
    return t.messages.select("id", FC.jump_url("server_id", "channel_id", "id").alias("jump_url"))


@register("resolve_reply_author", """
SELECT id, reply_to_author_id FROM messages_resolved WHERE reply_to_message_id IS NOT NULL""")
def _resolve_reply_author(t):
    return resolve_reply_author(t.messages).filter(F.col("reply_to_message_id").isNotNull()) \
        .select("id", "reply_to_author_id")


@register("cascade_delete", """
WITH m AS (SELECT * FROM messages WHERE channel_id <> 2)
SELECT 'messages' AS table_name, COUNT(*) AS count FROM m
UNION ALL SELECT 'message_mentions', COUNT(*) FROM message_mentions
  WHERE message_id IN (SELECT id FROM m) AND mentioned_user_id <> 7
UNION ALL SELECT 'reactions', COUNT(*) FROM reactions
  WHERE message_id IN (SELECT id FROM m) AND user_id <> 7
UNION ALL SELECT 'users', COUNT(*) FROM users WHERE id <> 7
UNION ALL SELECT 'channels', COUNT(*) FROM channels WHERE id <> 2
UNION ALL SELECT 'server_members', COUNT(*) FROM server_members WHERE user_id <> 7
UNION ALL SELECT 'authorless', COUNT(*) FROM m WHERE author_id IS NULL OR author_id = 7""")
def _cascade_delete(t):
    spark = t.spark
    names = ["messages", "message_mentions", "reactions", "users", "channels", "server_members"]
    out = G.cascade_delete({n: t[n] for n in names},
                           channels=spark.range(2, 3).toDF("id"),
                           users=spark.range(7, 8).toDF("id"))
    counts = Q.table_counts(out, names)
    authorless = out["messages"].filter(F.col("author_id").isNull()).agg(
        F.count(F.lit(1)).alias("count")).select(F.lit("authorless").alias("table_name"), "count")
    return counts.unionByName(authorless)


@register("normalize_legacy", """
SELECT tenant_id, id, server_id, name, type, parent_id, topic, position, is_nsfw, created_at,
       is_archived, last_synced_at FROM channels""")
def _normalize_legacy(t):
    old = t.channels.withColumnsRenamed({"id": "channel_id", "type": "channel_type"}) \
        .drop("tenant_id", "is_archived")
    return G.normalize_legacy({"channels": old}, TENANT)["channels"]


# Older names of columns, and the flag that the older tables lack
_OLD_NAMES = {"servers": {"id": "server_id"}, "users": {"id": "user_id"}, "messages": {"id": "message_id"},
              "emojis": {"id": "emoji_id"}, "reactions": {"reacted_at": "created_at"}, "server_members": {},
              "message_mentions": {}}
_LACKING = {"messages": "has_poll", "reactions": "is_super_reaction"}


def _legacy(name: str):
    def run(t):
        old = t[name].withColumnsRenamed(_OLD_NAMES[name]).drop("tenant_id", _LACKING.get(name, "tenant_id"))
        return G.normalize_legacy({name: old}, TENANT)[name]

    lacking = f"* REPLACE (false AS {_LACKING[name]})" if name in _LACKING else "*"
    register(f"normalize_legacy_{name}", f"SELECT {lacking} FROM {name}")(run)


for _name in _OLD_NAMES:
    _legacy(_name)


@register("normalize_legacy_sync_state", """
SELECT tenant_id, server_id, channel_id, 'messages' AS sync_type, MAX(id) AS last_message_id,
       MAX(created_at) AS completed_at, COUNT(*) AS message_count FROM messages GROUP BY ALL""")
def _legacy_sync_state(t):
    old = t.sync_state.withColumnsRenamed({"completed_at": "last_sync_at"}).drop("tenant_id")
    return G.normalize_legacy({"sync_state": old}, TENANT)["sync_state"].select(
        "tenant_id", "server_id", "channel_id", "sync_type", "last_message_id", "completed_at",
        F.col("message_count").cast("long").alias("message_count"))


# The keys of what is left, as text, with the author of messages
_LEFT = {"messages": ["id", "author_id"], "message_mentions": ["message_id", "mentioned_user_id"],
         "reactions": ["message_id", "emoji_id", "user_id"], "users": ["id"], "channels": ["id"],
         "server_members": ["server_id", "user_id"], "servers": ["id"], "emojis": ["id"]}


def _left_sql(name: str, fact: str) -> str:
    key = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in _LEFT[name])
    return f"SELECT '{name}' AS table_name, concat_ws('/', {key}) AS key FROM {fact} AS x"


@register("cascade_delete_rows", """
WITH kept AS (SELECT id, if(author_id % 5 = 2, NULL, author_id) AS author_id FROM messages WHERE channel_id % 3 <> 2),
tags AS (SELECT * FROM message_mentions SEMI JOIN kept ON kept.id = message_id WHERE mentioned_user_id % 5 <> 2),
marks AS (SELECT * FROM reactions SEMI JOIN kept ON kept.id = message_id WHERE user_id % 5 <> 2)
""" + " UNION ALL ".join([
    _left_sql("messages", "kept"), _left_sql("message_mentions", "tags"), _left_sql("reactions", "marks"),
    _left_sql("users", "(SELECT id FROM users WHERE id % 5 <> 2)"),
    _left_sql("channels", "(SELECT id FROM channels WHERE id % 3 <> 2)"),
    _left_sql("server_members", "(SELECT server_id, user_id FROM server_members WHERE user_id % 5 <> 2)"),
    _left_sql("servers", "servers"), _left_sql("emojis", "emojis")]))
def _cascade_delete_rows(t):
    """What is left, row by row, when a third of the channels and a fifth of
    the users go; messages of such users lose their author."""
    out = G.cascade_delete({n: t[n] for n in _LEFT},
                           channels=t.channels.filter(F.col("id") % 3 == 2).select("tenant_id", "id"),
                           users=t.users.filter(F.col("id") % 5 == 2).select("tenant_id", "id"))
    return reduce(DataFrame.unionByName, [out[n].select(
        F.lit(n).alias("table_name"),
        F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in key]).alias("key"))
        for n, key in _LEFT.items()])


_ = SQL_AS_OF
