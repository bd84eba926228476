"""Registry plumbing and SQL text helpers for the DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from chatlens.sources.fixtures import oracle

# Parameters the registered queries pass (the driver data span 2024-01).
AS_OF = "2024-01-31 00:00:00"
SQL_AS_OF = f"TIMESTAMP '{AS_OF}'"


@dataclass
class Entry:
    name: str
    run: Callable[[object], DataFrame]
    sql: str | None
    body: str | None = None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, None if sql is None else oracle(sql), sql)
        return fn
    return deco


def since(days: int) -> str:
    return f"({SQL_AS_OF} - INTERVAL {int(days)} DAY)"


def ratio(num: str, den: str, digits: int = 1, scale: int = 1) -> str:
    """SQL twin of ``round_ratio``: exact half-away-from-zero rounding of
    scale*num/den for integers, as DOUBLE; NULL when den is 0."""
    m = scale * 10 ** digits
    n, d = f"CAST(({num}) AS BIGINT)", f"CAST(({den}) AS BIGINT)"
    return (f"(CASE WHEN {d} IS NULL OR {d} = 0 THEN NULL ELSE "
            f"CAST(sign({n}) * ((abs({n}) * {2 * m} + {d}) // (2 * {d})) AS DOUBLE) "
            f"/ {10 ** digits} END)")


def pct(num: str, den: str, digits: int = 1) -> str:
    return ratio(num, den, digits, 100)


HUMANS = "(SELECT * FROM users WHERE NOT coalesce(is_bot, false))"


def tally(fact: str, *keys: str, where: str = "true", **more: str) -> str:
    """A fact table reduced to one row per key: the keys, n rows, and more."""
    cols = [*keys, "COUNT(*) AS n", *(f"{what} AS {name}" for name, what in more.items())]
    return f"(SELECT {', '.join(cols)} FROM {fact} AS fact WHERE {where} GROUP BY ALL)"


def between(pairs: str, first: str, second: str, count: str, limit: int) -> str:
    """Pairs of user ids (a, b, n) under their names, most first."""
    return f"""
SELECT ua.username AS {first}, ub.username AS {second}, n AS {count}
FROM {pairs} AS pairs JOIN users ua ON ua.id = a JOIN users ub ON ub.id = b
ORDER BY n DESC, a, b LIMIT {limit}"""


# Messages under their author's name, and those of known channels
SIGNED = "(SELECT messages.*, username FROM messages JOIN users ON users.id = author_id)"
PLACED = f"(SELECT signed.*, channels.name AS channel FROM {SIGNED} signed JOIN channels ON channels.id = channel_id)"

# Who (a) did something to whom (b): reactions, mentions, replies
REACTED = """(SELECT user_id AS a, author_id AS b, emoji_id, reacted_at AS ts, server_id, channel_id
              FROM messages JOIN reactions ON message_id = id)"""
TAGGED = """(SELECT author_id AS a, mentioned_user_id AS b, server_id, channel_id
             FROM messages JOIN message_mentions ON message_id = id)"""
REPLIED = """(SELECT answer.author_id AS a, asked.author_id AS b, answer.server_id, answer.created_at AS ts,
                     date_diff('microsecond', asked.created_at, answer.created_at) AS us
              FROM messages asked JOIN messages answer ON answer.reply_to_message_id = asked.id)"""

# Replies of two people in both directions: once per pair, and once per direction
MUTUAL = f"""(SELECT least(a, b) AS lo, greatest(a, b) AS hi, COUNT(*) FILTER (a < b) AS up,
                     COUNT(*) FILTER (a > b) AS down FROM {REPLIED} r WHERE a <> b GROUP BY ALL)"""
BOTH_WAYS = f"""(SELECT lo AS a, hi AS b, up AS n, down AS back FROM {MUTUAL} m
                 UNION ALL SELECT hi, lo, down, up FROM {MUTUAL} m)"""

# What humans write, per channel and instant (first and last author of it), and
# the pause from each instant to the next one
PAUSES = f"""talk AS (SELECT id, author_id, created_at, coalesce(channel_id, -1) AS place
              FROM messages SEMI JOIN {HUMANS} h ON h.id = author_id),
moments AS (SELECT place, created_at AS ts, arg_min(author_id, id) AS opener, arg_max(author_id, id) AS closer
            FROM talk GROUP BY ALL),
pauses AS (SELECT m.place, m.ts, m.closer, next.ts AS next_ts, next.opener,
                  date_diff('microsecond', m.ts, next.ts) AS us
           FROM moments m ASOF JOIN moments next ON m.place = next.place AND m.ts < next.ts)"""
