"""Registered integrity checks and whole-table counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.catalog.base import HUMANS, ratio, register, tally
from chatlens.operators import quality as Q
from chatlens.sources.schema import KEYS

_COUNTS = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS count FROM {n}"
    for n in ["servers", "users", "server_members", "channels", "messages", "message_mentions",
              "emojis", "reactions"])


@register("table_counts", _COUNTS + """ UNION ALL
SELECT 'sync_state', COUNT(*) FROM (SELECT DISTINCT tenant_id, server_id, channel_id FROM messages)""")
def _table_counts(t):
    return Q.table_counts(t)


def _lost(name: str, child: str, key: str, parent: str) -> str:
    """Rows of ``child`` by key, those whose key the parent lacks, and nulls."""
    return f"""
WITH lost AS (SELECT DISTINCT {key} AS k FROM {child} EXCEPT SELECT id FROM {parent})
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS {name}
FROM (SELECT {key} AS k, COUNT(*) AS n FROM {child} GROUP BY ALL) per
WHERE k IS NULL OR k IN (SELECT k FROM lost WHERE k IS NOT NULL)"""


@register("orphan_messages", _lost("orphan_messages", "messages", "author_id", "users"))
def _orphan_messages(t):
    return Q.orphan_messages(t.messages, t.users)


@register("orphan_reactions", _lost("orphan_reactions", "reactions", "message_id", "messages"))
def _orphan_reactions(t):
    return Q.orphan_reactions(t.reactions, t.messages)


@register("orphan_mentions", _lost("orphan_mentions", "message_mentions", "message_id", "messages"))
def _orphan_mentions(t):
    return Q.orphan_mentions(t.message_mentions, t.messages)


@register("orphan_channel_refs", _lost("orphan_channel_refs", "messages", "channel_id", "channels"))
def _orphan_channel_refs(t):
    return Q.orphan_channel_refs(t.messages, t.channels)


@register("big_numbers", """
WITH said AS (SELECT COUNT(*) AS total_messages, COUNT(DISTINCT author_id) AS active_users,
                     COUNT(reply_to_message_id) AS total_replies, MIN(created_at) AS first_msg,
                     MAX(created_at) AS last_msg FROM messages),
places AS (SELECT COUNT(*) AS channels FROM channels),
tags AS (SELECT COUNT(*) AS total_mentions FROM message_mentions)
SELECT * FROM said POSITIONAL JOIN places POSITIONAL JOIN tags""")
def _big_numbers(t):
    return Q.big_numbers(t.messages, t.channels, t.message_mentions)


@register("human_totals", f"""
WITH spoke AS (SELECT CAST(coalesce(SUM(n), 0) AS BIGINT) AS human_messages, COUNT(*) AS active_humans
               FROM {tally('messages', 'author_id AS id')} wrote SEMI JOIN {HUMANS} h USING (id)),
kinds AS (SELECT COUNT(*) FILTER (NOT coalesce(is_bot, false)) AS human_users,
                 COUNT(*) FILTER (is_bot) AS bot_users FROM users)
SELECT * FROM spoke POSITIONAL JOIN kinds""")
def _human_totals(t):
    return Q.human_totals(t.messages, t.users)


@register("message_span", f"""
SELECT MIN(created_at) AS first_message, MAX(created_at) AS last_message,
       {ratio("date_diff('microsecond', MIN(created_at), MAX(created_at))", '86400000000', 6)}
         AS days_span
FROM messages""")
def _message_span(t):
    return Q.message_span(t.messages)


@register("server_header", """
SELECT name, member_count FROM servers ORDER BY id LIMIT 1""")
def _server_header(t):
    return Q.server_header(t.servers)


@register("dedup_constraints", """
SELECT id, COUNT(*) AS n FROM messages GROUP BY id HAVING COUNT(*) > 1""")
def _dedup_constraints(t):
    return Q.dedup_constraints(t.messages, ["id"])


# The column that tells which rows a second dump brings again
_AGAIN = {"servers": "id", "users": "id", "server_members": "user_id", "channels": "id", "messages": "id",
          "message_mentions": "message_id", "emojis": "id", "reactions": "message_id", "sync_state": "channel_id"}
_SYNC = "(SELECT DISTINCT tenant_id, server_id, channel_id, 'messages' AS sync_type FROM messages)"


def _doubled_sql(name: str) -> str:
    key = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in KEYS[name])
    fact = _SYNC if name == "sync_state" else name
    return (f"SELECT '{name}' AS table_name, concat_ws('/', {key}) AS key, COUNT(*) + 1 AS n FROM {fact} x "
            f"WHERE {_AGAIN[name]} % 3 = 1 GROUP BY ALL")


@register("dedup_constraints_two_dumps", " UNION ALL ".join(_doubled_sql(n) for n in KEYS))
def _dedup_constraints_two_dumps(t):
    """The keys that two overlapping dumps hold twice, in every table."""
    parts = []
    for name, key in KEYS.items():
        twice = t[name].unionByName(t[name].filter(F.col(_AGAIN[name]) % 3 == 1))
        parts.append(Q.dedup_constraints(twice, key).select(
            F.lit(name).alias("table_name"),
            F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in key]).alias("key"), "n"))
    return reduce(DataFrame.unionByName, parts)


def _constraint_sql():
    parts = []
    for n, key in KEYS.items():
        src = "(SELECT DISTINCT tenant_id, server_id, channel_id, 'messages' AS sync_type FROM messages)" \
            if n == "sync_state" else n
        k = ", ".join(key)
        parts.append(f"SELECT '{n}' AS table_name, COUNT(*) AS violations FROM "
                     f"(SELECT {k} FROM {src} x GROUP BY {k} HAVING COUNT(*) > 1)")
    return " UNION ALL ".join(parts)


@register("constraint_report", _constraint_sql())
def _constraint_report(t):
    return Q.constraint_report(t)
