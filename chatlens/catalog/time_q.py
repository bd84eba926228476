"""Registered time-pattern and dashboard queries."""

from __future__ import annotations

from chatlens.catalog.base import AS_OF, HUMANS, SIGNED, pct, ratio, register, since, tally
from chatlens.operators import timeline as T

DAYS = "['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday']"
WD = "CAST(dayofweek(created_at) AS INTEGER)"
WDM = "CAST(dayofweek(m.created_at) AS INTEGER)"


@register("messages_by_hour", """
SELECT strftime(created_at, '%H') AS hour, COUNT(*) AS message_count FROM messages GROUP BY 1""")
def _messages_by_hour(t):
    return T.messages_by_hour(t.messages)


@register("peak_hours_share", f"""
SELECT CAST(hour(created_at) AS INTEGER) AS hour, COUNT(*) AS message_count,
       {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()', 2)} AS percentage FROM messages GROUP BY 1""")
def _peak_hours_share(t):
    return T.peak_hours_share(t.messages)


@register("hourly_bars", """
WITH h AS (SELECT CAST(hour(created_at) AS INTEGER) AS hour, COUNT(*) AS messages FROM messages GROUP BY 1)
SELECT hour, messages, repeat('#', CAST(messages * 30 // (SELECT max(messages) FROM h) AS INTEGER)) AS bar
FROM h""")
def _hourly_bars(t):
    return T.hourly_bars(t.messages)


@register("peak_hour", """
WITH h AS (SELECT CAST(hour(created_at) AS INTEGER) AS hour, COUNT(*) AS messages FROM messages GROUP BY 1)
SELECT hour, messages FROM h ORDER BY messages DESC, hour LIMIT 1""")
def _peak_hour(t):
    return T.peak_hour(t.messages)


@register("hourly_activity_filled", f"""
WITH g AS (SELECT CAST(hour(created_at) AS INTEGER) AS hour, COUNT(*) AS message_count,
                  COUNT(DISTINCT author_id) AS unique_users
           FROM messages WHERE created_at >= {since(7)} GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS hour, coalesce(g.message_count, 0) AS message_count,
       coalesce(g.unique_users, 0) AS unique_users
FROM range(24) r LEFT JOIN g ON g.hour = r.range""")
def _hourly_activity_filled(t):
    return T.hourly_activity_filled(t.messages, t.spark, as_of=AS_OF, days=7)


@register("messages_by_weekday", f"""
SELECT {WD} AS day_num, {DAYS}[{WD} + 1] AS day_of_week, COUNT(*) AS message_count
FROM messages GROUP BY 1, 2""")
def _messages_by_weekday(t):
    return T.messages_by_weekday(t.messages)


@register("weekday_filled", f"""
WITH g AS (SELECT {WD} AS day, COUNT(*) AS message_count FROM messages
           WHERE created_at >= {since(3)} GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS day, {DAYS}[CAST(r.range AS INTEGER) + 1] AS day_name,
       coalesce(g.message_count, 0) AS message_count
FROM range(7) r LEFT JOIN g ON g.day = r.range""")
def _weekday_filled(t):
    return T.weekday_filled(t.messages, t.spark, as_of=AS_OF, days=3)


@register("weekday_weekend_ratio", f"""
WITH a AS (SELECT COUNT(CASE WHEN {WD} NOT IN (0, 6) THEN 1 END) AS weekday,
                  COUNT(CASE WHEN {WD} IN (0, 6) THEN 1 END) AS weekend FROM messages)
SELECT weekday, weekend, {pct('weekend', 'CASE WHEN weekday = 0 THEN 1 ELSE weekday END')} AS ratio FROM a""")
def _weekday_weekend_ratio(t):
    return T.weekday_weekend_ratio(t.messages)


@register("peak_weekday", f"""
WITH g AS (SELECT {WD} AS day, COUNT(*) AS n FROM messages GROUP BY 1)
SELECT {DAYS}[day + 1] AS day_name FROM g ORDER BY n DESC, day LIMIT 1""")
def _peak_weekday(t):
    return T.peak_weekday(t.messages)


@register("night_owls", f"""
WITH hours AS {tally('messages', 'author_id AS id', 'hour(created_at) AS hour')},
bands AS (SELECT id, SUM(n) FILTER (hour <= 5) AS night, SUM(n) FILTER (hour >= 5 AND hour <= 9) AS early,
                 SUM(n) FILTER (hour >= 9 AND hour <= 17) AS work, SUM(n) FILTER (hour >= 17) AS late,
                 SUM(n) AS total FROM hours GROUP BY id)
SELECT username, CAST(coalesce(night, 0) AS BIGINT) AS night_owl, CAST(coalesce(early, 0) AS BIGINT) AS early_bird,
       CAST(coalesce(work, 0) AS BIGINT) AS work_hours, CAST(coalesce(late, 0) AS BIGINT) AS evening,
       CAST(total AS BIGINT) AS total
FROM bands JOIN users USING (id) WHERE total >= 50""")
def _night_owls(t):
    return T.night_owls(t.messages, t.users)


@register("night_and_early", f"""
WITH own AS (SELECT author_id AS id, username, COUNT(*) AS total, COUNT(*) FILTER (hour(created_at) <= 5) AS night,
                    COUNT(*) FILTER (hour(created_at) IN (5, 6, 7, 8, 9)) AS early
             FROM {SIGNED} s GROUP BY ALL),
listed AS (SELECT 'night_owl' AS list, id, username, night AS messages, total FROM own WHERE total >= 50
           UNION ALL SELECT 'early_bird', id, username, early, total FROM own WHERE total >= 50)
SELECT list, CAST(ROW_NUMBER() OVER best AS INTEGER) AS place, username, messages, total,
       {pct('messages', 'total')} AS pct
FROM listed WINDOW best AS (PARTITION BY list ORDER BY messages DESC, id) QUALIFY ROW_NUMBER() OVER best <= 5""")
def _night_and_early(t):
    return T.night_and_early(t.messages, t.users)


@register("weekday_bars", f"""
WITH g AS (SELECT {WD} AS day_num, COUNT(*) AS message_count FROM messages GROUP BY 1)
SELECT day_num, {DAYS}[day_num + 1] AS day_of_week, message_count,
       repeat('#', CAST(message_count * 30 // (SELECT max(message_count) FROM g) AS INTEGER)) AS bar FROM g""")
def _weekday_bars(t):
    return T.weekday_bars(t.messages)


@register("night_owl_share", f"""
SELECT username, late AS late_msgs, n AS total, {pct('late', 'n')} AS pct
FROM {tally('messages', 'author_id AS id', late='COUNT(*) FILTER (hour(created_at) < 6)')} wrote
JOIN {HUMANS} h USING (id) WHERE n >= 50 ORDER BY pct DESC, id LIMIT 5""")
def _night_owl_share(t):
    return T.night_owl_share(t.messages, t.users)


@register("weekend_warriors", f"""
WITH wrote AS {tally('messages', 'author_id AS id', off='COUNT(*) FILTER (isodow(created_at) > 5)')}
SELECT username, off AS weekend_msgs, n - off AS weekday_msgs, n AS total,
       {pct('off', 'n - off')} AS weekend_ratio
FROM wrote JOIN users USING (id) WHERE n >= 50 ORDER BY weekend_ratio DESC, id LIMIT 10""")
def _weekend_warriors(t):
    return T.weekend_warriors(t.messages, t.users)


@register("busiest_dates", """
SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS message_count,
       COUNT(DISTINCT author_id) AS active_users
FROM messages GROUP BY 1 ORDER BY message_count DESC, date LIMIT 10""")
def _busiest_dates(t):
    return T.busiest_dates(t.messages)


@register("daily_trend", f"""
SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS message_count,
       COUNT(DISTINCT author_id) AS active_users
FROM messages WHERE created_at >= {since(14)} GROUP BY 1""")
def _daily_trend(t):
    return T.daily_trend(t.messages, as_of=AS_OF, days=14)


@register("monthly_trend", """
WITH g AS (SELECT strftime(created_at, '%Y-%m') AS month, COUNT(*) AS messages,
                  COUNT(DISTINCT author_id) AS active_users FROM messages GROUP BY 1)
SELECT month, messages, active_users,
       repeat('#', CAST(messages * 25 // (SELECT max(messages) FROM g) AS INTEGER)) AS bar FROM g""")
def _monthly_trend(t):
    return T.monthly_trend(t.messages)


@register("peak_and_slowest_month", """
WITH g AS (SELECT strftime(created_at, '%Y-%m') AS month, COUNT(*) AS messages FROM messages GROUP BY 1)
SELECT arg_min(month, (-messages, month)) AS peak_month, max(messages) AS peak_messages,
       arg_min(month, (messages, month)) AS slowest_month, min(messages) AS slowest_messages FROM g""")
def _peak_and_slowest_month(t):
    return T.peak_and_slowest_month(t.messages)


@register("timeline_hour", f"""
SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS period, COUNT(*) AS count
FROM messages WHERE created_at >= {since(7)} GROUP BY 1""")
def _timeline_hour(t):
    return T.timeline(t.messages, as_of=AS_OF, days=7, granularity="hour")


@register("timeline", f"""
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS period, COUNT(*) AS count
FROM messages WHERE created_at >= {since(30)} GROUP BY 1""")
def _timeline(t):
    return T.timeline(t.messages, as_of=AS_OF, days=30, granularity="day")


@register("timeline_week", f"""
SELECT strftime(date_trunc('week', created_at), '%Y-%m-%d %H:%M:%S') AS period, COUNT(*) AS count
FROM messages WHERE created_at >= {since(30)} GROUP BY 1""")
def _timeline_week(t):
    return T.timeline(t.messages, as_of=AS_OF, days=30, granularity="week")


@register("rolling_average", f"""
WITH d AS (SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS count FROM messages GROUP BY 1)
SELECT day, count, {ratio('SUM(count) OVER w', 'COUNT(count) OVER w', 4)} AS rolling_avg
FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _rolling_average(t):
    return T.rolling_average(t.messages)


@register("latest_per_author", """
SELECT author_id, created_at,
       CAST(ROW_NUMBER() OVER (PARTITION BY author_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS rn
FROM messages""")
def _latest_per_author(t):
    return T.latest_per_author(t.messages)


@register("overview", f"""
WITH a AS (
  SELECT COUNT(CASE WHEN created_at >= {since(7)} THEN 1 END) AS total_messages,
         COUNT(DISTINCT CASE WHEN created_at >= {since(7)} THEN author_id END) AS total_users,
         SUM(CASE WHEN created_at >= {since(7)} THEN char_count END) AS c,
         COUNT(CASE WHEN created_at >= {since(7)} THEN char_count END) AS nc,
         COUNT(CASE WHEN created_at < {since(7)} THEN 1 END) AS prev_messages,
         COUNT(DISTINCT CASE WHEN created_at < {since(7)} THEN author_id END) AS prev_users
  FROM messages WHERE created_at >= {since(14)})
SELECT total_messages, total_users, (SELECT COUNT(*) FROM channels) AS total_channels,
       (SELECT COUNT(*) FROM message_mentions WHERE message_id IN
          (SELECT id FROM messages WHERE created_at >= {since(7)})) AS total_mentions,
       CASE WHEN prev_messages > 0 THEN {pct('total_messages - prev_messages', 'prev_messages')}
            ELSE 0.0 END AS messages_change_percent,
       CASE WHEN prev_users > 0 THEN {pct('total_users - prev_users', 'prev_users')}
            ELSE 0.0 END AS users_change_percent,
       {ratio('total_messages', '7', 1)} AS avg_messages_per_day,
       coalesce({ratio('c', 'nc', 1)}, 0.0) AS avg_message_length
FROM a""")
def _overview(t):
    return T.overview(t.messages, t.channels, t.message_mentions, as_of=AS_OF, days=7)


@register("engagement_metrics", f"""
WITH a AS (SELECT COUNT(*) AS total, COUNT(reply_to_message_id) AS replies,
                  COUNT(CASE WHEN mention_count > 0 THEN 1 END) AS with_mentions,
                  COUNT(DISTINCT author_id) AS active
           FROM messages WHERE created_at >= {since(7)})
SELECT {pct('replies', 'greatest(total, 1)')} AS reply_rate,
       {pct('with_mentions', 'greatest(total, 1)')} AS mention_rate,
       {pct('active', 'greatest((SELECT COUNT(*) FROM users), 1)')} AS active_user_ratio,
       {ratio('greatest(total, 1)', 'greatest(active, 1)', 1)} AS messages_per_active_user
FROM a""")
def _engagement_metrics(t):
    return T.engagement_metrics(t.messages, t.users, as_of=AS_OF, days=7)
