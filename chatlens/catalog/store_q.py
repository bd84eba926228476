"""Registered queries of the incremental store, the mergeable roll-ups and the
search index (SURVEY §2.2, 2.3, 2.5, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlens.catalog import time_q  # noqa: F401  (its overview is compared with)
from chatlens.catalog.base import AS_OF, REGISTRY, ratio, register, since
from chatlens.operators import distincts as B
from chatlens.operators import ledger as LG
from chatlens.operators import partials as P
from chatlens.operators import search as SE
from chatlens.sources.fixtures import TENANT

NEEDLE = "Haha!!"


def _batches(t, n: int = 2):
    """The history in batches that follow no order: replies, reactions and
    mentions come before or after the message they belong to."""
    for k in range(n):
        yield (t.messages.filter(F.col("id") % n == n - 1 - k), t.reactions.filter(F.col("user_id") % n == k),
               t.message_mentions.filter(F.col("mentioned_user_id") % n == (k + 1) % n))


def _folded(t):
    """Partial roll-ups of all batches; edges wait for their message."""
    seen = waiting = inter = daily = None
    for m, r, tags in _batches(t):
        edges = P.open_edges(m, r, tags)
        edges = edges if waiting is None else edges.unionByName(waiting)
        seen = m if seen is None else seen.unionByName(m)
        resolved = P.resolve(edges, seen)
        waiting = resolved.filter("found IS NULL").select(*P.OPEN_EDGES.names)
        i, d = P.interaction_parts(resolved, m), P.daily_parts(resolved, m)
        inter, daily = (i, d) if inter is None else (inter.unionByName(i), daily.unionByName(d))
    return inter, daily


@register("user_interactions_folded", """
SELECT tenant_id, from_user_id, to_user_id, server_id, interaction_type,
       CAST(interaction_count AS BIGINT) AS interaction_count, first_interaction, last_interaction
FROM user_interactions""")
def _user_interactions_folded(t):
    return P.combine_interactions(_folded(t)[0])


@register("daily_stats_folded", f"""
SELECT tenant_id, date_trunc('day', created_at) AS day, server_id, channel_id, author_id,
       COUNT(*) AS message_count, COUNT(DISTINCT reply_to_author_id) AS unique_users_replied_to,
       COUNT(reply_to_message_id) AS reply_count, CAST(SUM(word_count) AS BIGINT) AS total_words,
       {ratio('SUM(word_count)', 'COUNT(*)', 6)} AS avg_words_per_message
FROM messages_resolved GROUP BY ALL""")
def _daily_stats_folded(t):
    return P.combine_daily(_folded(t)[1])


def _stored(t, name: str):
    """A store that was loaded from two dumps out of order."""
    from chatlens.plans.incremental import load_facts
    from chatlens.plans.versions import TableStore
    from chatlens.session import shared_scratch

    root = shared_scratch(t.spark, name)
    for m, r, tags in _batches(t):
        load_facts(TableStore(t.spark, root, TENANT), m, r, tags)
    return TableStore(t.spark, root, TENANT)


@register("sync_state_ledger", """
SELECT tenant_id, server_id, channel_id, 'messages' AS sync_type, MAX(id) AS last_message_id,
       MIN(id) AS oldest_message_id, 'completed' AS status, MIN(created_at) AS started_at,
       MAX(created_at) AS completed_at, CAST(COUNT(*) AS INTEGER) AS message_count
FROM messages GROUP BY tenant_id, server_id, channel_id""")
def _sync_state_ledger(t):
    runs = None
    for m, _, _ in _batches(t):
        own = LG.run_intervals(m)
        runs = own if runs is None else LG.merge_intervals(runs.unionByName(own))
    return LG.sync_state(runs).drop("id", "error_message")


@register("incremental_backfill", """
SELECT id, channel_id, id % 4 = 1 AS in_hole FROM messages
WHERE id % 4 = 1 OR created_at >= TIMESTAMP '2024-01-20 00:00:00' OR created_at < TIMESTAMP '2024-01-05 00:00:00'""")
def _incremental_backfill(t):
    """What a dump of everything adds to a store that has the days from the 5th
    to the 20th without every fourth id: below the mark, above it, and holes."""
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp_ntz")
    old = t.messages.filter((F.col("created_at") >= day("05")) & (F.col("created_at") < day("20"))
                            & (F.col("id") % 4 != 1))
    slim = t.messages.select("tenant_id", "server_id", "channel_id", "id", "created_at")
    new = LG.fresh_rows(slim.unionByName(slim), old, LG.run_intervals(old), ["tenant_id", "id"])
    return new.select("id", "channel_id", (F.col("id") % 4 == 1).alias("in_hole"))


@register("interactions_after_loads", """
WITH left_over AS (SELECT * REPLACE (CASE WHEN author_id = 7 THEN NULL ELSE author_id END AS author_id)
                   FROM messages WHERE channel_id <> 2),
acted AS (
  SELECT a.tenant_id, a.author_id AS doer, o.author_id AS other, a.server_id, 'reply' AS kind, a.created_at AS ts
  FROM left_over a JOIN left_over o ON a.reply_to_message_id = o.id
  UNION ALL SELECT m.tenant_id, m.author_id, x.mentioned_user_id, m.server_id, 'mention', m.created_at
  FROM message_mentions x JOIN left_over m ON m.id = x.message_id WHERE x.mentioned_user_id <> 7
  UNION ALL SELECT m.tenant_id, r.user_id, m.author_id, m.server_id, 'reaction', r.reacted_at
  FROM reactions r JOIN left_over m ON m.id = r.message_id WHERE r.user_id <> 7)
SELECT tenant_id, doer AS from_user_id, other AS to_user_id, server_id, kind AS interaction_type,
       COUNT(*) AS interaction_count, MIN(ts) AS first_interaction, MAX(ts) AS last_interaction
FROM acted WHERE doer <> other GROUP BY ALL""")
def _interactions_after_loads(t):
    """Two loads out of order, then a channel and a user are deleted."""
    from chatlens.plans import incremental as I

    store = _stored(t, "store-loads")
    spark = t.spark
    I.delete_cascading(store, channels=spark.range(2, 3).toDF("id"), users=spark.range(7, 8).toDF("id"))
    return I.user_interactions(store)


def _maps(t):
    """The bitmap roll-up of two batches; the second numbers new users only."""
    known = maps = None
    for m, _, _ in _batches(t):
        none = t.spark.createDataFrame([], B.USER_NUMBERS)
        new = B.number_users(none if known is None else known, m)
        known = new if known is None else known.unionByName(new)
        own = B.author_maps(m, known)
        maps = own if maps is None else maps.unionByName(own)
    return maps


@register("monthly_trend_bitmaps", """
WITH g AS (SELECT strftime(created_at, '%Y-%m') AS month, COUNT(*) AS messages,
                  COUNT(DISTINCT author_id) AS active_users FROM messages GROUP BY ALL)
SELECT *, repeat('#', CAST(messages * 25 // (SELECT max(messages) FROM g) AS INTEGER)) AS bar FROM g""")
def _monthly_trend_bitmaps(t):
    return B.monthly_trend(_maps(t))


@register("daily_trend_bitmaps", f"""
SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS message_count, COUNT(DISTINCT author_id) AS active_users
FROM messages WHERE created_at >= {since(14)} GROUP BY ALL""")
def _daily_trend_bitmaps(t):
    return B.daily_trend(_maps(t), F.date_sub(F.lit(AS_OF).cast("date"), 14))


@register("channel_users_bitmaps", f"""
SELECT c.id, c.name, COUNT(m.id) AS messages, COUNT(DISTINCT m.author_id) AS active_users
FROM channels c LEFT JOIN messages m ON m.channel_id = c.id AND m.created_at >= {since(7)} GROUP BY ALL""")
def _channel_users_bitmaps(t):
    return B.channel_users(_maps(t), t.channels, F.date_sub(F.lit(AS_OF).cast("date"), 7))


@register("overview_bitmaps", f"""
SELECT total_messages, total_users, messages_change_percent, users_change_percent, avg_messages_per_day,
       avg_message_length FROM ({REGISTRY["overview"].body}) o""")
def _overview_bitmaps(t):
    return B.overview(_maps(t), F.date_sub(F.lit(AS_OF).cast("date"), 7), 7)


@register("search_index", f"""
SELECT u.username, m.content, c.name AS channel, m.created_at
FROM messages m JOIN users u ON u.id = m.author_id JOIN channels c ON c.id = m.channel_id
WHERE contains(lower(m.content), lower('{NEEDLE}')) ORDER BY m.created_at DESC, m.id DESC LIMIT 20""")
def _search_index(t):
    from chatlens.session import shared_scratch

    root = SE.write_index(t.messages, shared_scratch(t.spark, "search"))
    return SE.search(t.spark, root, t.users, t.channels, NEEDLE, TENANT)
