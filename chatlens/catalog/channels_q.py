"""Registered channel queries."""

from __future__ import annotations

from chatlens.catalog.base import (
    AS_OF, REACTED, SQL_AS_OF, TAGGED, pct, ratio, register, since, tally,
)
from chatlens.operators import channels as C


@register("messages_per_channel", f"""
SELECT name AS channel_name, coalesce(n, 0) AS message_count
FROM channels LEFT JOIN {tally('messages', 'channel_id AS id')} held USING (id)""")
def _messages_per_channel(t):
    return C.messages_per_channel(t.channels, t.messages)


@register("channel_activity", f"""
SELECT name AS channel_name, coalesce(n, 0) AS message_count, coalesce(people, 0) AS unique_users
FROM channels LEFT JOIN {tally('messages', 'channel_id AS id', people='COUNT(DISTINCT author_id)')} held
USING (id)""")
def _channel_activity(t):
    return C.channel_activity(t.channels, t.messages)


@register("server_channel_activity", f"""
SELECT name, n AS message_count
FROM {tally('messages', 'channel_id AS id', where='server_id = 1')} held JOIN channels USING (id)""")
def _server_channel_activity(t):
    return C.server_channel_activity(t.messages, t.channels, server_id=1)


@register("channel_leaderboard", f"""
SELECT name, n AS message_count, people AS unique_users,
       {pct('n', '(SELECT COUNT(*) FROM messages)')} AS pct
FROM channels JOIN {tally('messages', 'channel_id AS id', people='COUNT(DISTINCT author_id)')} held
USING (id)""")
def _channel_leaderboard(t):
    return C.channel_leaderboard(t.messages, t.channels)


@register("active_channels_recent", f"""
SELECT name AS channel_name, n AS message_count
FROM {tally('messages', 'channel_id AS id', where=f'created_at >= {since(7)}')} held JOIN channels USING (id)
ORDER BY n DESC, id LIMIT 10""")
def _active_channels_recent(t):
    return C.active_channels_recent(t.channels, t.messages, as_of=AS_OF, days=7)


@register("top_channels_detail", f"""
WITH held AS {tally('messages', 'channel_id AS id', where=f'created_at >= {since(7)}',
                    people='COUNT(DISTINCT author_id)', chars='SUM(char_count)', sized='COUNT(char_count)')}
SELECT CAST(id AS VARCHAR) AS channel_id, name AS channel_name, coalesce(n, 0) AS message_count,
       coalesce(people, 0) AS unique_users, coalesce({ratio('chars', 'sized', 1)}, 0.0) AS avg_message_length
FROM channels LEFT JOIN held USING (id) ORDER BY message_count DESC, id LIMIT 10""")
def _top_channels_detail(t):
    return C.top_channels_detail(t.channels, t.messages, as_of=AS_OF, days=7)


@register("channel_reactions", f"""
SELECT name AS channel_name, coalesce(n, 0) AS reaction_count
FROM channels LEFT JOIN {tally(REACTED, 'channel_id AS id')} got USING (id)
ORDER BY reaction_count DESC, id LIMIT 10""")
def _channel_reactions(t):
    return C.channel_reactions(t.channels, t.messages, t.reactions)


@register("channel_mentions", f"""
SELECT name AS channel_name, coalesce(n, 0) AS mention_count
FROM channels LEFT JOIN {tally(TAGGED, 'channel_id AS id')} got USING (id)
ORDER BY mention_count DESC, id LIMIT 10""")
def _channel_mentions(t):
    return C.channel_mentions(t.channels, t.messages, t.message_mentions)


@register("empty_channels", f"""
SELECT name AS channel_name, type AS channel_type FROM channels
ANTI JOIN (SELECT channel_id AS id FROM messages WHERE created_at >= {since(30)}) busy USING (id)""")
def _empty_channels(t):
    return C.empty_channels(t.channels, t.messages, as_of=AS_OF, days=30)


@register("quiet_channels", f"""
SELECT name, type, latest AS last_message_at, coalesce(n, 0) AS total_messages
FROM channels LEFT JOIN {tally('messages', 'channel_id AS id', latest='MAX(created_at)')} held USING (id)
WHERE coalesce(n, 0) < 10""")
def _quiet_channels(t):
    return C.quiet_channels(t.channels, t.messages)


@register("channel_growth_window", f"""
WITH weeks AS {tally('messages', 'channel_id AS id', where=f'created_at >= {since(14)}',
                     fresh=f'COUNT(*) FILTER (created_at >= {since(7)})')}
SELECT name AS channel_name, fresh AS current_period, n - fresh AS previous_period,
       coalesce({pct('2 * fresh - n', 'n - fresh')}, 0.0) AS growth_percent
FROM weeks JOIN channels USING (id) ORDER BY fresh DESC, id LIMIT 10""")
def _channel_growth_window(t):
    return C.channel_growth_window(t.channels, t.messages, as_of=AS_OF, days=7)


@register("channel_daily", f"""
SELECT name AS channel_name, date, n AS daily_messages
FROM {tally('messages', 'channel_id AS id', 'CAST(created_at AS DATE) AS date')} held JOIN channels USING (id)
ORDER BY date DESC, n DESC, id LIMIT 100""")
def _channel_daily(t):
    return C.channel_daily(t.channels, t.messages)


@register("channel_message_length", f"""
WITH held AS {tally('messages', 'channel_id AS id', words='SUM(word_count)', worded='COUNT(word_count)',
                    chars='SUM(char_count)', sized='COUNT(char_count)')}
SELECT name AS channel_name, n AS total_messages, {ratio('words', 'worded', 1)} AS avg_words,
       {ratio('chars', 'sized', 0)} AS avg_chars
FROM held JOIN channels USING (id) WHERE n > 10""")
def _channel_message_length(t):
    return C.channel_message_length(t.channels, t.messages)


@register("channel_overview", """
SELECT name, topic, position, is_nsfw,
       CASE type WHEN 0 THEN 'Text' WHEN 2 THEN 'Voice' WHEN 4 THEN 'Category'
                 WHEN 5 THEN 'Announcement' WHEN 15 THEN 'Forum' ELSE 'Other' END AS channel_type
FROM channels""")
def _channel_overview(t):
    return C.channel_overview(t.channels)


@register("channel_detail", f"""
SELECT c.name, c.topic, COUNT(m.id) AS total_messages, COUNT(DISTINCT m.author_id) AS unique_users,
       coalesce({ratio('SUM(m.word_count)', 'COUNT(m.word_count)', 1)}, 0.0) AS avg_words_per_message,
       coalesce({ratio('SUM(m.char_count)', 'COUNT(m.char_count)', 1)}, 0.0) AS avg_chars_per_message,
       COUNT(m.reply_to_message_id) AS reply_count,
       COUNT(CASE WHEN m.attachment_count > 0 THEN 1 END) AS messages_with_attachments
FROM channels c LEFT JOIN messages m ON c.id = m.channel_id AND m.created_at >= {since(30)}
WHERE c.id = 2 GROUP BY c.id, c.name, c.topic""")
def _channel_detail(t):
    return C.channel_detail(t.channels, t.messages, channel_id=2, as_of=AS_OF, days=30)


@register("channel_message_gap", f"""
WITH spans AS {tally('messages', 'channel_id AS id', us="date_diff('microsecond', MIN(created_at), MAX(created_at))")}
SELECT name AS channel, {ratio('us', '(n - 1) * 1000000', 3)} AS avg_seconds_between
FROM spans JOIN channels USING (id) WHERE n - 1 > 10""")
def _channel_message_gap(t):
    return C.channel_message_gap(t.messages, t.channels)


_ = SQL_AS_OF
