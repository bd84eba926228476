"""Registered reply queries."""

from __future__ import annotations

from chatlens.catalog.base import (
    HUMANS, PAUSES, PLACED, REPLIED, SIGNED, between, pct, ratio, register, tally,
)
from chatlens.operators import replies as R

@register("reply_vs_original", """
SELECT CASE WHEN reply_to_message_id IS NOT NULL THEN 'Reply' ELSE 'Original' END AS message_type,
       COUNT(*) AS count FROM messages GROUP BY 1""")
def _reply_vs_original(t):
    return R.reply_vs_original(t.messages)


@register("top_reply_pairs", between(
    tally(REPLIED, "a", "b"), "replier", "replied_to_user", "reply_count", 15))
def _top_reply_pairs(t):
    return R.top_reply_pairs(t.messages, t.users)


@register("server_reply_pairs", between(
    tally(REPLIED, "a", "b", where="server_id = 1 AND a <> b"),
    "replier", "replied_to_user", "reply_count", 10))
def _server_reply_pairs(t):
    return R.server_reply_pairs(t.messages, t.users, server_id=1)


@register("reply_pairs_direct", f"""
SELECT ua.username AS replier, ub.username AS replied_to, CAST(SUM(n) AS BIGINT) AS reply_count
FROM {tally('messages_resolved', 'author_id AS a', 'reply_to_author_id AS b')} p
JOIN users ua ON ua.id = a JOIN users ub ON ub.id = b
WHERE a <> b GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10""")
def _reply_pairs_direct(t):
    return R.reply_pairs_direct(t.messages_resolved, t.users)


@register("self_replies", f"""
SELECT COUNT(*) AS self_reply_count FROM {REPLIED} r WHERE a = b""")
def _self_replies(t):
    return R.self_replies(t.messages)


@register("replies_sent", f"""
SELECT username, global_name, n AS replies_sent
FROM {tally('messages', 'author_id AS id', where='reply_to_message_id IS NOT NULL')} sent
JOIN users USING (id) ORDER BY n DESC, id LIMIT 10""")
def _replies_sent(t):
    return R.replies_sent(t.messages, t.users)


@register("replies_received", f"""
SELECT username, global_name, n AS replies_received
FROM {tally(REPLIED, 'b AS id')} got JOIN users USING (id) ORDER BY n DESC, id LIMIT 10""")
def _replies_received(t):
    return R.replies_received(t.messages, t.users)


@register("reply_chains", f"""
SELECT id, username AS author, content, reply_to_message_id FROM {SIGNED} s
WHERE reply_to_message_id IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 20""")
def _reply_chains(t):
    return R.reply_chains(t.messages, t.users)


@register("viral_messages", f"""
WITH top AS (SELECT p.id, coalesce(n, 0) AS n
             FROM {PLACED} p SEMI JOIN {HUMANS} h ON h.id = p.author_id
             LEFT JOIN {tally('messages', 'reply_to_message_id AS id')} got ON got.id = p.id
             ORDER BY 2 DESC, 1 LIMIT 5)
SELECT username, replace(if(length(content) > 80, left(content, 80) || '...', content), chr(10), ' ') AS content,
       channel, created_at, n AS reply_count
FROM top JOIN {PLACED} p USING (id)""")
def _viral_messages(t):
    return R.viral_messages(t.messages, t.users, t.channels)


@register("low_reply_rate", f"""
WITH rates AS (SELECT id, wrote.n AS sent, coalesce(got.n, 0) AS got
               FROM {tally('messages', 'author_id AS id')} wrote
               LEFT JOIN {tally(REPLIED, 'b AS id')} got USING (id) WHERE wrote.n >= 10)
SELECT username, sent AS messages_sent, got AS replies_received, {pct('got', 'sent')} AS reply_rate
FROM rates JOIN users USING (id) ORDER BY reply_rate, id LIMIT 10""")
def _low_reply_rate(t):
    return R.low_reply_rate(t.messages, t.users)


@register("conversation_starters", f"""
SELECT username, opened AS conversations_started, {pct('opened', 'n')} AS pct_original
FROM {tally('messages', 'author_id AS id', opened='COUNT(*) - COUNT(reply_to_message_id)')} wrote
JOIN users USING (id) WHERE opened >= 50 ORDER BY opened DESC, id LIMIT 10""")
def _conversation_starters(t):
    return R.conversation_starters(t.messages, t.users)


_RT = f"""
WITH answers AS {tally(REPLIED, 'a AS id', where='a <> b AND us BETWEEN 6000000 AND 86400000000', us='SUM(us)')}
SELECT id AS uid, username, {ratio('us', 'n * 60000000', 1)} AS avg_response_min, n AS reply_count
FROM answers JOIN {HUMANS} h USING (id) WHERE n >= 3"""


@register("response_speed", f"""
SELECT username, avg_response_min, reply_count FROM ({_RT}) x
ORDER BY avg_response_min ASC, uid LIMIT 10""")
def _response_speed(t):
    return R.response_speed(t.messages, t.users, min_replies=3)


@register("slow_responders", f"""
SELECT username, avg_response_min FROM ({_RT}) x ORDER BY avg_response_min DESC, uid LIMIT 5""")
def _slow_responders(t):
    return R.slow_responders(t.messages, t.users, min_replies=3)


@register("slow_responders_within_top", f"""
WITH top AS (SELECT * FROM ({_RT}) x ORDER BY avg_response_min, uid LIMIT 10)
SELECT username, avg_response_min FROM top ORDER BY avg_response_min DESC, uid LIMIT 5""")
def _slow_responders_within_top(t):
    return R.slow_responders(t.messages, t.users, min_replies=3, within_top=10)


@register("left_on_read", f"""
WITH calls AS (SELECT b AS id, 1 AS ping, 0 AS answer FROM {REPLIED} r
               UNION ALL SELECT mentioned_user_id, 1, 0 FROM message_mentions
               UNION ALL SELECT author_id, 0, 1 FROM messages WHERE reply_to_message_id IS NOT NULL),
sums AS (SELECT id, CAST(SUM(ping) AS BIGINT) AS pings, CAST(SUM(answer) AS BIGINT) AS answers
         FROM calls GROUP BY id)
SELECT username, pings AS pings_received, answers AS responses_given,
       {pct('pings - answers', 'pings')} AS left_on_read_pct
FROM sums JOIN {HUMANS} h USING (id) WHERE pings >= 20 ORDER BY left_on_read_pct DESC, id LIMIT 10""")
def _left_on_read(t):
    return R.left_on_read(t.messages, t.message_mentions, t.users)


@register("conversation_killers", f"""
WITH {PAUSES},
last_words AS (SELECT closer AS id, COUNT(*) AS n FROM (SELECT arg_max(closer, ts) AS closer FROM moments
               GROUP BY place) x GROUP BY 1),
kills AS (SELECT closer AS id, COUNT(*) AS n FROM pauses WHERE us > 1800000000 GROUP BY 1),
totals AS (SELECT id, wrote.n - coalesce(last_words.n, 0) AS n
           FROM {tally('messages', 'author_id AS id')} wrote LEFT JOIN last_words USING (id))
SELECT username, totals.n AS total_msgs, coalesce(kills.n, 0) AS kills,
       {pct('coalesce(kills.n, 0)', 'totals.n')} AS kill_rate
FROM totals JOIN {HUMANS} h USING (id) LEFT JOIN kills USING (id)
WHERE totals.n >= 50 ORDER BY kill_rate DESC, id LIMIT 10""")
def _conversation_killers(t):
    return R.conversation_killers(t.messages, t.users)


@register("conversation_revivers", f"""
WITH {PAUSES},
first_words AS (SELECT opener AS id, COUNT(*) AS n FROM (SELECT arg_min(opener, ts) AS opener FROM moments
                GROUP BY place) x GROUP BY 1),
revived AS (SELECT opener AS id, COUNT(*) AS n FROM pauses WHERE us > 3600000000 GROUP BY 1)
SELECT username, coalesce(revived.n, 0) AS revivals
FROM {tally('messages', 'author_id AS id')} wrote JOIN {HUMANS} h USING (id)
LEFT JOIN first_words USING (id) LEFT JOIN revived USING (id)
WHERE wrote.n > coalesce(first_words.n, 0) ORDER BY revivals DESC, id LIMIT 10""")
def _conversation_revivers(t):
    return R.conversation_revivers(t.messages, t.users)


@register("conversation_catalysts", f"""
WITH {PAUSES},
sparks AS (SELECT place, ts, opener FROM moments
           ANTI JOIN (SELECT place, next_ts AS ts FROM pauses WHERE us <= 1800000000) soon USING (place, ts)),
chains AS (SELECT s.place, s.ts, s.opener AS id, COUNT(*) AS n, COUNT(DISTINCT t.author_id) AS people
           FROM talk t ASOF JOIN sparks s ON t.place = s.place AND t.created_at > s.ts
           WHERE date_diff('microsecond', s.ts, t.created_at) <= 1800000000 GROUP BY ALL),
per AS (SELECT id, COUNT(*) AS tries, COUNT(*) FILTER (n >= 2 AND people >= 2) AS lit, SUM(n) AS n
        FROM chains GROUP BY id)
SELECT username, tries AS spark_attempts, lit AS successful_ignitions, {pct('lit', 'tries')} AS success_rate,
       {ratio('n', 'tries', 1)} AS avg_chain_length
FROM per JOIN users USING (id) WHERE tries >= 5 ORDER BY lit DESC, id LIMIT 10""")
def _conversation_catalysts(t):
    return R.conversation_catalysts(t.messages, t.users, min_followups=2)
