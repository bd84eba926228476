"""Registered relationship-graph queries."""

from __future__ import annotations

from chatlens.catalog.base import (
    AS_OF, BOTH_WAYS, HUMANS, MUTUAL, REPLIED, TAGGED, between, pct, ratio, register, since, tally,
)
from chatlens.operators import graph as G

@register("interaction_summary", f"""
WITH pt AS (SELECT u1.username AS from_user, u2.username AS to_user, ui.interaction_type,
                   SUM(ui.interaction_count) AS n
            FROM user_interactions ui JOIN users u1 ON ui.from_user_id = u1.id
            JOIN users u2 ON ui.to_user_id = u2.id
            WHERE ui.server_id = 1 AND ui.last_interaction > {since(7)}
            GROUP BY 1, 2, 3)
SELECT from_user, to_user, CAST(SUM(n) AS BIGINT) AS total_interactions,
       map_from_entries(list_sort(list({{'k': interaction_type, 'v': CAST(n AS BIGINT)}}))) AS breakdown
FROM pt GROUP BY from_user, to_user ORDER BY total_interactions DESC, from_user, to_user LIMIT 20""")
def _interaction_summary(t):
    return G.interaction_summary(t.user_interactions, t.users, server_id=1, days=7, as_of=AS_OF)


@register("interaction_pairs", f"""
WITH w AS (SELECT * FROM messages_resolved WHERE created_at >= {since(7)}),
mi AS (SELECT w.author_id AS f, mm.mentioned_user_id AS t, COUNT(*) AS mention_count
       FROM w JOIN message_mentions mm ON w.id = mm.message_id
       WHERE w.author_id <> mm.mentioned_user_id GROUP BY 1, 2),
ri AS (SELECT author_id AS f, reply_to_author_id AS t, COUNT(*) AS reply_count FROM w
       WHERE reply_to_author_id IS NOT NULL AND author_id <> reply_to_author_id GROUP BY 1, 2),
j AS (SELECT coalesce(mi.f, ri.f) AS f, coalesce(mi.t, ri.t) AS t,
             coalesce(mi.mention_count, 0) AS mention_count, coalesce(ri.reply_count, 0) AS reply_count
      FROM mi FULL OUTER JOIN ri ON mi.f = ri.f AND mi.t = ri.t)
SELECT coalesce(fu.username, CAST(j.f AS VARCHAR)) AS from_user,
       coalesce(tu.username, CAST(j.t AS VARCHAR)) AS to_user, j.mention_count, j.reply_count
FROM j LEFT JOIN users fu ON j.f = fu.id LEFT JOIN users tu ON j.t = tu.id
ORDER BY j.mention_count + j.reply_count DESC, j.f, j.t LIMIT 20""")
def _interaction_pairs(t):
    return G.interaction_pairs(t.messages_resolved, t.message_mentions, t.users, as_of=AS_OF, days=7)


@register("best_friends", between(
    tally(REPLIED, "least(a, b) AS a", "greatest(a, b) AS b", where="a <> b"),
    "user_1", "user_2", "exchanges", 10))
def _best_friends(t):
    return G.best_friends(t.messages, t.users)


@register("best_friends_balance", f"""
SELECT ua.username AS user_1, ub.username AS user_2, up AS a_to_b, down AS b_to_a, up + down AS total,
       abs(up - down) AS imbalance
FROM {MUTUAL} p JOIN {HUMANS} ua ON ua.id = lo JOIN {HUMANS} ub ON ub.id = hi
WHERE up + down >= 4 ORDER BY total DESC, imbalance, lo, hi LIMIT 10""")
def _best_friends_balance(t):
    return G.best_friends_balance(t.messages, t.users, min_total=4)


@register("reciprocity", f"""
SELECT ua.username AS user_a, ub.username AS user_b, n AS a_to_b, back AS b_to_a, abs(n - back) AS imbalance
FROM {BOTH_WAYS} p JOIN {HUMANS} ua ON ua.id = a JOIN {HUMANS} ub ON ub.id = b
WHERE n >= 3 ORDER BY imbalance DESC, a, b LIMIT 10""")
def _reciprocity(t):
    return G.reciprocity(t.messages, t.users, min_replies=3)


@register("fan_relationships", f"""
SELECT ua.username AS fan, ub.username AS idol, n AS fan_to_idol, back AS idol_to_fan, n - back AS imbalance
FROM {BOTH_WAYS} p JOIN users ua ON ua.id = a JOIN users ub ON ub.id = b
WHERE n >= 3 ORDER BY imbalance DESC, a, b LIMIT 10""")
def _fan_relationships(t):
    return G.fan_relationships(t.messages, t.users, min_replies=3)


_REACH = f"""
WITH met AS (SELECT a, b FROM {REPLIED} r UNION SELECT a, b FROM {TAGGED} t),
r AS (SELECT a AS uid, COUNT(*) AS unique_interactions
      FROM met SEMI JOIN {HUMANS} h ON h.id = a SEMI JOIN {HUMANS} k ON k.id = b WHERE a <> b GROUP BY a)"""


@register("social_butterfly", f"""
{_REACH}
SELECT u.username, r.unique_interactions, (SELECT COUNT(*) FROM {HUMANS} h) AS total_humans,
       {pct('r.unique_interactions', f'(SELECT COUNT(*) FROM {HUMANS} h)')} AS pct
FROM r JOIN users u ON r.uid = u.id ORDER BY r.unique_interactions DESC, u.id LIMIT 15""")
def _social_butterfly(t):
    return G.social_butterfly(t.messages, t.message_mentions, t.users)


@register("selective_socializers", f"""
{_REACH}
SELECT u.username, r.unique_interactions FROM r JOIN users u ON r.uid = u.id
ORDER BY r.unique_interactions ASC, u.id LIMIT 5""")
def _selective_socializers(t):
    return G.selective_socializers(t.messages, t.message_mentions, t.users)


_MAG = f"""
WITH got AS (SELECT id, COUNT(*) FILTER (reply) AS replies, COUNT(*) FILTER (NOT reply) AS tags
             FROM (SELECT b AS id, true AS reply FROM {REPLIED} r
                   UNION ALL SELECT mentioned_user_id, false FROM message_mentions) x GROUP BY id),
x AS (SELECT id AS uid, username, n AS sent, coalesce(replies, 0) AS replies_received,
             coalesce(tags, 0) AS mentions_received
      FROM {tally('messages', 'author_id AS id')} wrote JOIN {HUMANS} h USING (id) LEFT JOIN got USING (id)
      WHERE n >= 50)
SELECT *, replies_received + mentions_received AS total_engagement,
       {ratio('replies_received + mentions_received', 'sent', 2)} AS engagement_ratio FROM x"""


@register("engagement_magnetism", f"""
SELECT username, sent, replies_received, mentions_received, total_engagement, engagement_ratio
FROM ({_MAG}) y ORDER BY engagement_ratio DESC, uid LIMIT 15""")
def _engagement_magnetism(t):
    return G.engagement_magnetism(t.messages, t.message_mentions, t.users)


@register("low_engagement", f"""
SELECT username, engagement_ratio FROM ({_MAG}) y ORDER BY engagement_ratio ASC, uid LIMIT 5""")
def _low_engagement(t):
    return G.low_engagement(t.messages, t.message_mentions, t.users)


@register("selective_socializers_within_top", f"""
{_REACH},
top AS (SELECT * FROM r JOIN users ON users.id = uid ORDER BY unique_interactions DESC, uid LIMIT 15)
SELECT username, unique_interactions FROM top ORDER BY unique_interactions, uid LIMIT 5""")
def _selective_socializers_within_top(t):
    return G.selective_socializers(t.messages, t.message_mentions, t.users, within_top=15)


@register("low_engagement_within_top", f"""
WITH top AS (SELECT * FROM ({_MAG}) y ORDER BY engagement_ratio DESC, uid LIMIT 15)
SELECT username, engagement_ratio FROM top ORDER BY engagement_ratio, uid LIMIT 5""")
def _low_engagement_within_top(t):
    return G.low_engagement(t.messages, t.message_mentions, t.users, within_top=15)


@register("late_night_crew", f"""
SELECT ua.username AS user_1, ub.username AS user_2, n AS exchanges
FROM {tally(REPLIED, 'least(a, b) AS a', 'greatest(a, b) AS b', where='a <> b AND hour(ts) < 6')} p
JOIN {HUMANS} ua ON ua.id = a JOIN {HUMANS} ub ON ub.id = b ORDER BY n DESC, a, b LIMIT 5""")
def _late_night_crew(t):
    return G.late_night_crew(t.messages, t.users)


@register("wrapped_users", f"""
SELECT id, username, n AS msg_count FROM {tally('messages', 'author_id AS id')} wrote JOIN {HUMANS} h USING (id)
WHERE n >= 50 ORDER BY n DESC, id LIMIT 10""")
def _wrapped_users(t):
    return G.wrapped_users(t.messages, t.users, min_messages=50)


# Cards from one tally per author, channel and day
_CARDS = f"""
WITH wrote AS {tally('messages', 'author_id AS id', 'channel_id', 'CAST(created_at AS DATE) AS day',
                     size='max(length(content))', asks="COUNT(*) FILTER (suffix(content, '?'))",
                     dark='COUNT(*) FILTER (hour(created_at) < 6)')},
people AS (SELECT id, username, SUM(n) AS n, max(size) AS size, SUM(asks) AS asks, SUM(dark) AS dark
           FROM wrote JOIN {HUMANS} h USING (id) GROUP BY ALL),
ladder AS (SELECT n, SUM(COUNT(*)) OVER (ORDER BY n DESC) - COUNT(*) + 1 AS place, SUM(COUNT(*)) OVER () AS everyone
           FROM people GROUP BY n),
homes AS (SELECT DISTINCT ON (id) id, name, n
          FROM (SELECT id, channel_id, SUM(n) AS n FROM wrote GROUP BY ALL) spread
          JOIN (SELECT id AS channel_id, name FROM channels) c USING (channel_id) ORDER BY id, n DESC, channel_id),
peaks AS (SELECT DISTINCT ON (id) id, day, n FROM (SELECT id, day, SUM(n) AS n FROM wrote GROUP BY ALL) days
          ORDER BY id, n DESC, day),
partners AS {tally(REPLIED, 'a AS id', 'b', where='a <> b')},
circles AS (SELECT id, COUNT(*) AS n FROM partners GROUP BY id),
friends AS (SELECT DISTINCT ON (p.id) p.id, username, p.n FROM partners p JOIN {HUMANS} h ON h.id = p.b
            ORDER BY p.id, p.n DESC, p.b),
callers AS {tally(TAGGED, 'b AS id', 'a')},
called AS (SELECT id, SUM(n) AS n, COUNT(a) AS people FROM callers GROUP BY id)
SELECT people.id AS user_id, people.username, CAST(people.n AS BIGINT) AS total_msgs,
       CAST(size AS INTEGER) AS longest_msg, CAST(asks AS BIGINT) AS questions_asked,
       CAST(dark AS BIGINT) AS late_night, CAST(place AS BIGINT) AS rank, CAST(everyone AS BIGINT) AS total_users,
       {ratio('everyone - place', 'everyone', 0, 100)} AS percentile, homes.name AS fav_channel,
       {pct('homes.n', 'people.n')} AS fav_channel_pct, friends.username AS best_friend, friends.n AS bf_exchanges,
       CAST(coalesce(called.n, 0) AS BIGINT) AS times_mentioned, coalesce(called.people, 0) AS by_people,
       peaks.day AS busiest_date, CAST(peaks.n AS BIGINT) AS busiest_count, coalesce(circles.n, 0) AS unique_convos
FROM people JOIN ladder USING (n) LEFT JOIN homes ON homes.id = people.id LEFT JOIN friends ON friends.id = people.id
LEFT JOIN called ON called.id = people.id LEFT JOIN peaks ON peaks.id = people.id
LEFT JOIN circles ON circles.id = people.id WHERE people.n >= 50"""


@register("personal_wrapped", _CARDS)
def _personal_wrapped(t):
    return G.personal_wrapped(t.messages, t.users, t.channels, t.message_mentions, min_messages=50)
