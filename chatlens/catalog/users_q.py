"""Registered user-activity queries."""

from __future__ import annotations

from chatlens.catalog.base import AS_OF, HUMANS, REACTED, TAGGED, pct, ratio, register, since, tally
from chatlens.operators import users as U


@register("top_users", f"""
SELECT username, global_name, coalesce(n, 0) AS message_count
FROM users LEFT JOIN {tally('messages', 'author_id AS id')} wrote USING (id)
ORDER BY message_count DESC, id LIMIT 10""")
def _top_users(t):
    return U.top_users(t.users, t.messages)


@register("top_messagers_share", f"""
SELECT username, coalesce(global_name, username) AS display_name, n AS message_count,
       {pct('n', '(SELECT COUNT(*) FROM messages)')} AS pct
FROM {tally('messages', 'author_id AS id')} wrote JOIN users USING (id) ORDER BY n DESC, id LIMIT 10""")
def _top_messagers_share(t):
    return U.top_messagers_share(t.messages, t.users)


@register("messages_by_user_window", f"""
SELECT username, global_name, n AS message_count, places AS channels_active, replies AS reply_count
FROM {tally('messages', 'author_id AS id', where=f'server_id = 1 AND created_at > {since(7)}',
            places='COUNT(DISTINCT channel_id)', replies='COUNT(reply_to_message_id)')} wrote
JOIN users USING (id)""")
def _messages_by_user_window(t):
    return U.messages_by_user_window(t.messages, t.users, server_id=1, days=7, as_of=AS_OF)


@register("server_top_authors", f"""
SELECT username, global_name, n AS message_count
FROM {tally('messages', 'author_id AS id', where='server_id = 1')} wrote JOIN users USING (id)
ORDER BY n DESC, id LIMIT 10""")
def _server_top_authors(t):
    return U.server_top_authors(t.messages, t.users, server_id=1)


@register("message_count_by_user", f"""
SELECT username, n AS message_count FROM {tally('messages', 'author_id AS id')} wrote JOIN users USING (id)
ORDER BY n DESC, id LIMIT 15""")
def _message_count_by_user(t):
    return U.message_count_by_user(t.users, t.messages)


@register("top_users_detail", f"""
WITH win AS (SELECT * FROM messages_resolved WHERE created_at >= {since(7)}),
base AS (SELECT author_id AS uid, COUNT(id) AS message_count, SUM(char_count) AS chars,
                COUNT(char_count) AS n FROM win GROUP BY author_id),
ment AS (SELECT mm.mentioned_user_id AS uid, COUNT(*) AS mention_count
         FROM message_mentions mm JOIN win ON mm.message_id = win.id GROUP BY 1),
reps AS (SELECT reply_to_author_id AS uid, COUNT(*) AS reply_count FROM win
         WHERE reply_to_author_id IS NOT NULL GROUP BY 1)
SELECT CAST(u.id AS VARCHAR) AS user_id, u.username, coalesce(u.is_bot, false) AS is_bot,
       b.message_count, coalesce({ratio('b.chars', 'b.n', 1)}, 0.0) AS avg_message_length,
       coalesce(ment.mention_count, 0) AS mention_count,
       coalesce(reps.reply_count, 0) AS reply_count
FROM base b JOIN users u ON u.id = b.uid
LEFT JOIN ment ON ment.uid = b.uid LEFT JOIN reps ON reps.uid = b.uid
WHERE b.message_count > 0
ORDER BY b.message_count DESC, u.id LIMIT 15""")
def _top_users_detail(t):
    return U.top_users_detail(t.users, t.messages_resolved, t.message_mentions, as_of=AS_OF, days=7)


@register("reactions_given", f"""
SELECT username, global_name, coalesce(n, 0) AS reactions_given
FROM users LEFT JOIN {tally('reactions', 'user_id AS id')} gave USING (id)
ORDER BY reactions_given DESC, id LIMIT 10""")
def _reactions_given(t):
    return U.reactions_given(t.users, t.reactions)


@register("top_reaction_givers", f"""
SELECT username, CAST(SUM(n) AS BIGINT) AS reactions_given
FROM {tally('reactions', 'user_id AS id')} gave JOIN users USING (id)
GROUP BY username ORDER BY 2 DESC, 1 LIMIT 10""")
def _top_reaction_givers(t):
    return U.top_reaction_givers(t.reactions, t.users)


@register("reactions_received", f"""
SELECT username, global_name, coalesce(n, 0) AS reactions_received
FROM users LEFT JOIN {tally(REACTED, 'b AS id')} got USING (id)
ORDER BY reactions_received DESC, id LIMIT 10""")
def _reactions_received(t):
    return U.reactions_received(t.users, t.messages, t.reactions)


@register("reactors", f"""
WITH kinds AS {tally('reactions', 'user_id AS id', 'emoji_id')},
gave AS (SELECT id, CAST(SUM(n) AS BIGINT) AS total, COUNT(emoji_id) AS emojis FROM kinds GROUP BY id)
SELECT username, global_name, total AS total_reactions, emojis AS unique_emojis_used
FROM gave JOIN users USING (id) ORDER BY total DESC, id LIMIT 10""")
def _reactors(t):
    return U.reactors(t.reactions, t.users)


@register("mentions_given", f"""
SELECT username, global_name, coalesce(n, 0) AS mentions_given
FROM users LEFT JOIN {tally(TAGGED, 'a AS id')} gave USING (id)
ORDER BY mentions_given DESC, id LIMIT 10""")
def _mentions_given(t):
    return U.mentions_given(t.users, t.messages, t.message_mentions)


@register("mentions_received", f"""
SELECT username, global_name, coalesce(n, 0) AS mentions_received
FROM users LEFT JOIN {tally('message_mentions', 'mentioned_user_id AS id')} got USING (id)
ORDER BY mentions_received DESC, id LIMIT 10""")
def _mentions_received(t):
    return U.mentions_received(t.users, t.message_mentions)


@register("bot_vs_human", f"""
SELECT if(is_bot, 'Bot', 'Human') AS user_type, CAST(SUM(n) AS BIGINT) AS message_count, COUNT(*) AS unique_users
FROM {tally('messages', 'author_id AS id')} wrote JOIN users USING (id) GROUP BY 1""")
def _bot_vs_human(t):
    return U.bot_vs_human(t.messages, t.users)


@register("bot_vs_human_share", f"""
WITH sides AS (SELECT if(is_bot, 'Bot', 'Human') AS type, CAST(SUM(n) AS BIGINT) AS message_count
               FROM {tally('messages', 'author_id AS id')} wrote JOIN users USING (id) GROUP BY 1)
SELECT type, message_count, {pct('message_count', '(SELECT SUM(message_count) FROM sides)')} AS percentage
FROM sides""")
def _bot_vs_human_share(t):
    return U.bot_vs_human_share(t.messages, t.users)


@register("bot_vs_human_pivot", f"""
WITH c AS (
  SELECT CAST(coalesce(SUM(CASE WHEN NOT u.is_bot THEN 1 ELSE 0 END), 0) AS BIGINT) AS human_messages,
         CAST(coalesce(SUM(CASE WHEN u.is_bot THEN 1 ELSE 0 END), 0) AS BIGINT) AS bot_messages
  FROM messages m JOIN users u ON m.author_id = u.id WHERE m.created_at >= {since(30)})
SELECT human_messages, bot_messages,
       coalesce({pct('human_messages', 'human_messages + bot_messages')}, 0.0) AS human_percentage,
       coalesce({pct('bot_messages', 'human_messages + bot_messages')}, 0.0) AS bot_percentage
FROM c""")
def _bot_vs_human_pivot(t):
    return U.bot_vs_human_pivot(t.messages, t.users, as_of=AS_OF, days=30)


@register("activity_level", f"""
SELECT username, n AS messages,
       ['lurker', 'casual', 'active', 'power_user'][1 + len(list_filter([20, 100, 500], lambda x: n > x))]
         AS activity_level
FROM {tally('messages', 'author_id AS id', where=f'created_at >= {since(30)}')} wrote JOIN users USING (id)""")
def _activity_level(t):
    return U.activity_level(t.messages, t.users, as_of=AS_OF, days=30)


@register("activity_distribution", f"""
WITH steps(upto, level) AS (VALUES (1, '1 message'), (5, '2-5 messages'), (20, '6-20 messages'),
                                   (50, '21-50 messages'), (100, '51-100 messages'), (1000000000, '100+ messages'))
SELECT level, COUNT(*) AS users
FROM {tally('messages', 'author_id AS id', where=f'created_at >= {since(30)}')} wrote
ASOF JOIN steps ON n <= upto GROUP BY level""")
def _activity_distribution(t):
    return U.activity_distribution(t.messages, as_of=AS_OF, days=30)


@register("user_activity_score", f"""
WITH daily AS {tally('messages', 'author_id AS id', 'CAST(created_at AS DATE) AS day',
                     words='SUM(word_count)', worded='COUNT(word_count)')},
wrote AS (SELECT id, CAST(SUM(n) AS BIGINT) AS total, SUM(words) AS words, SUM(worded) AS worded,
                 COUNT(day) AS days FROM daily GROUP BY id)
SELECT username, total AS messages, CAST({ratio('words', 'worded', 0)} AS INTEGER) AS avg_words,
       days AS active_days
FROM wrote JOIN users USING (id) WHERE total > 5 ORDER BY total DESC, id LIMIT 15""")
def _user_activity_score(t):
    return U.user_activity_score(t.users, t.messages)


@register("weekly_active_users", f"""
SELECT username, n AS messages_this_week, last_message
FROM {tally('messages', 'author_id AS id', where=f'created_at >= {since(7)}', last_message='MAX(created_at)')} wrote
JOIN users USING (id)""")
def _weekly_active_users(t):
    return U.weekly_active_users(t.users, t.messages, as_of=AS_OF)


@register("consistency", f"""
SELECT username, {ratio('n', 'days', 4)} AS avg_daily, days AS active_days, n AS total_msgs,
       {ratio('n', 'days', 1)} AS msgs_per_active_day
FROM {tally('messages', 'author_id AS id', days='COUNT(DISTINCT CAST(created_at AS DATE))')} wrote
JOIN {HUMANS} h USING (id) WHERE days >= 10 ORDER BY days DESC, id LIMIT 15""")
def _consistency(t):
    return U.consistency(t.messages, t.users)


@register("longest_streak", f"""
WITH days AS (SELECT DISTINCT author_id AS id, CAST(created_at AS DATE) AS day FROM messages),
firsts AS (FROM days ANTI JOIN (SELECT id, day + 1 AS day FROM days) y USING (id, day)),
lasts AS (FROM days ANTI JOIN (SELECT id, day - 1 AS day FROM days) t USING (id, day)),
streaks AS (SELECT f.id, f.day AS start, CAST(l.day - f.day + 1 AS BIGINT) AS len
            FROM firsts f ASOF JOIN lasts l ON f.id = l.id AND f.day <= l.day),
best AS (SELECT DISTINCT ON (id) id, len, start FROM streaks ORDER BY id, len DESC, start)
SELECT username, len AS longest_streak, start AS best_streak_start
FROM best JOIN {HUMANS} h USING (id) ORDER BY len DESC, id LIMIT 10""")
def _longest_streak(t):
    return U.longest_streak(t.messages, t.users)


@register("ghost_gap", f"""
WITH times AS (SELECT author_id AS id, list_sort(list(epoch_us(created_at))) AS us
               FROM messages WHERE author_id IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 20),
gaps AS (SELECT id, len(us) - 1 AS n, us[-1] - us[1] AS span,
                list_max(list_transform(us[2:], lambda t, i: t - us[i])) AS widest FROM times)
SELECT username, {ratio('widest', '86400000000', 4)} AS longest_absence_days,
       {ratio('span', 'n * 86400000000', 1)} AS avg_gap_days
FROM gaps JOIN {HUMANS} h USING (id) ORDER BY widest DESC, id LIMIT 10""")
def _ghost_gap(t):
    return U.ghost_gap(t.messages, t.users)


_LOYAL = f"""
WITH spread AS (SELECT author_id AS id, channel_id, n FROM {tally('messages', 'author_id', 'channel_id')} t
                SEMI JOIN channels ON channels.id = channel_id),
homes AS (SELECT id, arg_max(channel_id, (n, -channel_id)) AS home, max(n) AS home_msgs,
                 CAST(SUM(n) AS BIGINT) AS total FROM spread GROUP BY id)
SELECT h.id AS uid, h.username, channels.name AS home_channel, home_msgs, total,
       {pct('home_msgs', 'total')} AS home_pct
FROM homes JOIN {HUMANS} h USING (id) JOIN channels ON channels.id = home WHERE total >= 50"""


@register("channel_loyalty", f"""
SELECT username, home_channel, home_msgs, total, home_pct FROM ({_LOYAL}) x
ORDER BY home_pct DESC, uid LIMIT 15""")
def _channel_loyalty(t):
    return U.channel_loyalty(t.messages, t.channels, t.users)


@register("channel_spread", f"""
SELECT username, home_channel, home_pct FROM ({_LOYAL}) x
ORDER BY home_pct ASC, username LIMIT 5""")
def _channel_spread(t):
    return U.channel_spread(t.messages, t.channels, t.users)


@register("channel_spread_within_top", f"""
WITH top AS (SELECT * FROM ({_LOYAL}) x ORDER BY home_pct DESC, username LIMIT 15)
SELECT username, home_channel, home_pct FROM top ORDER BY home_pct, username LIMIT 5""")
def _channel_spread_within_top(t):
    return U.channel_spread(t.messages, t.channels, t.users, within_top=15)


@register("activity_concentration", f"""
WITH wrote AS (SELECT id, username, n FROM {tally('messages', 'author_id AS id')} w JOIN {HUMANS} h USING (id)),
busy AS (SELECT list(struct_pack(username := username, n := n) ORDER BY n DESC, id)[:5] AS top,
                CAST(SUM(n) AS BIGINT) AS total FROM wrote),
shares AS (SELECT top, total, list_transform(top, lambda x: {pct('x.n', 'total')}) AS pcts FROM busy),
places AS (SELECT top, total, pcts, unnest(range(1, len(top) + 1)) AS rn FROM shares)
SELECT top[rn].username AS username, top[rn].n AS msgs, total, pcts[rn] AS pct, CAST(rn AS INTEGER) AS rn,
       round(list_sum(pcts[:rn]), 1) AS cumulative FROM places""")
def _activity_concentration(t):
    return U.activity_concentration(t.messages, t.users)


@register("new_users_by_day", """
SELECT CAST(joined_at AS DATE) AS join_date, COUNT(*) AS new_users
FROM server_members GROUP BY 1 ORDER BY join_date DESC NULLS FIRST LIMIT 30""")
def _new_users_by_day(t):
    return U.new_users_by_day(t.server_members)


@register("server_members_overview", """
SELECT u.username, u.global_name, u.is_bot, sm.joined_at, sm.nickname
FROM server_members sm JOIN users u ON sm.user_id = u.id
ORDER BY sm.joined_at DESC NULLS FIRST, sm.user_id LIMIT 50""")
def _server_members_overview(t):
    return U.server_members_overview(t.server_members, t.users)


@register("user_rank", """
WITH c AS (SELECT m.author_id AS uid, COUNT(*) AS msgs FROM messages m
           JOIN users u ON m.author_id = u.id AND NOT coalesce(u.is_bot, false) GROUP BY 1)
SELECT msgs, uid, RANK() OVER (ORDER BY msgs DESC) AS rank FROM c""")
def _user_rank(t):
    return U.user_rank(t.messages, t.users)
