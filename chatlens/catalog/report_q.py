"""The yearly report for humans, line by line against the bodies of the queries
whose figures it prints (SURVEY §2.11)."""

from __future__ import annotations

from chatlens.catalog import content_q, graph_q, replies_q, time_q, users_q  # noqa: F401
from chatlens.catalog.base import REGISTRY, register
from chatlens.plans import report

# Title, query, what differs from the query's own parameters, format, columns, order
_LINES = [
    ("THE BIG NUMBERS", "big_numbers", None, "messages %s, active users %s, channels %s, mentions %s, replies %s",
     "total_messages active_users channels total_mentions total_replies", "1"),
    ("TOP 10 MESSAGERS", "top_messagers_share", None, "%-28s %8d %5.1f%%", "display_name message_count pct",
     "message_count DESC, display_name"),
    ("CHANNEL LEADERBOARD", "channel_leaderboard", None, "#%-20s %8d %5d %5.1f%%",
     "name message_count unique_users pct", "message_count DESC, name"),
    ("BEST FRIENDS", "best_friends", None, "%s <-> %s %8d", "user_1 user_2 exchanges",
     "exchanges DESC, user_1, user_2"),
    ("MOST REPLIED-TO USERS", "replies_received", None, "%-28s %10d", "username replies_received",
     "replies_received DESC, username"),
    ("LOW REPLY RATE", "low_reply_rate", None, "%-22s %5d %7d %6.1f%%",
     "username messages_sent replies_received reply_rate", "reply_rate, username"),
    ("CONVERSATION STARTERS", "conversation_starters", None, "%-24s %7d %8.1f%%",
     "username conversations_started pct_original", "conversations_started DESC, username"),
    ("ACTIVITY BY HOUR", "hourly_bars", None, "%02d:00 %7d %s", "hour messages bar", "hour"),
    ("ACTIVITY BY WEEKDAY", "messages_by_weekday", None, "%-12s %7d", "day_of_week message_count", "day_num"),
    ("WEEKEND WARRIORS", "weekend_warriors", None, "%-24s %6d %6d", "username weekend_msgs weekday_msgs",
     "weekend_ratio DESC, username"),
    ("ESSAY WRITERS", "essay_writers", None, "%-24s %8.1f %6d", "username avg_length max_length",
     "avg_length DESC, username"),
    ("QUESTION ASKERS", "question_askers", None, "%-24s %6d %6.1f%%", "username questions question_pct",
     "questions DESC, username"),
    ("MOST MENTIONED", "most_mentioned", None, "%-24s %6d", "username times_mentioned",
     "times_mentioned DESC, username"),
    ("TAG HAPPY", "tag_happy", None, "%-24s %6d %6.2f", "username mentions_given mentions_per_msg",
     "mentions_given DESC, username"),
    ("MONTHLY TREND", "monthly_trend", None, "%s %7d %5d %s", "month messages active_users bar", "month"),
    ("BUSIEST DATES", "busiest_dates", None, "%s %7d %5d", "date message_count active_users",
     "message_count DESC, date"),
    ("FANS", "fan_relationships", ("n >= 3", "n >= 5"), "%s -> %s %4d / %4d", "fan idol fan_to_idol idol_to_fan",
     "imbalance DESC, fan, idol"),
    ("WEEKDAY BARS", "weekday_bars", None, "%-12s %7d %s", "day_of_week message_count bar", "day_num"),
    ("WEEKEND SHARE", "weekday_weekend_ratio", None, "weekday %d, weekend %d, %.1f%%", "weekday weekend ratio", "1"),
    ("PEAK HOUR", "peak_hour", None, "%02d:00 with %d messages", "hour messages", "1"),
    ("NIGHT OWLS", "night_and_early", "list = 'night_owl'", "%s: %d (%.1f%% of their total)",
     "username messages pct", "place"),
    ("EARLY BIRDS", "night_and_early", "list = 'early_bird'", "%s: %d (%.1f%% of their total)",
     "username messages pct", "place"),
    ("HYPE BUILDERS", "exclamations", None, "%-24s %6d %6.2f", "username exclamations excl_per_msg",
     "excl_per_msg DESC, username"),
    ("PEAK AND SLOWEST MONTH", "peak_and_slowest_month", None, "%s with %d, %s with %d",
     "peak_month peak_messages slowest_month slowest_messages", "1"),
    ("FIRST AND LAST MESSAGE", "first_and_last_message", None, "%s: %s in #%s", "which username channel", "which"),
    ("CONSISTENCY", "consistency", None, "%-24s %4d days %6.1f/day", "username active_days msgs_per_active_day",
     "active_days DESC, username"),
    ("LONGEST STREAKS", "longest_streak", None, "%-24s %4d days", "username longest_streak",
     "longest_streak DESC, username"),
    ("CONVERSATION KILLERS", "conversation_killers", None, "%-24s %6.1f%%", "username kill_rate",
     "kill_rate DESC, username"),
    ("CONVERSATION REVIVERS", "conversation_revivers", None, "%-24s %6d", "username revivals",
     "revivals DESC, username"),
    ("CONVERSATION CATALYSTS", "conversation_catalysts", ("n >= 2 AND", "n >= 5 AND"), "%-24s %5d of %5d",
     "username successful_ignitions spark_attempts", "successful_ignitions DESC, username"),
    ("RESPONSE SPEED", "response_speed", ("n >= 3", "n >= 10"), "%-24s %8.1f min %6d",
     "username avg_response_min reply_count", "avg_response_min, username"),
    ("SLOW RESPONDERS", "slow_responders", ("n >= 3", "n >= 10"), "%-24s %8.1f min", "username avg_response_min",
     "avg_response_min DESC, username"),
    ("LEFT ON READ", "left_on_read", None, "%-24s %6.1f%% of %d", "username left_on_read_pct pings_received",
     "left_on_read_pct DESC, username"),
    ("BALANCE OF FRIENDS", "best_friends_balance", ("up + down >= 4", "up + down >= 20"), "%s (%d) <-> %s (%d)",
     "user_1 a_to_b user_2 b_to_a", "total DESC, imbalance, user_1, user_2"),
    ("RECIPROCITY", "reciprocity", ("n >= 3", "n >= 10"), "%s -> %s %4d / %4d", "user_a user_b a_to_b b_to_a",
     "imbalance DESC, user_a, user_b"),
    ("SOCIAL BUTTERFLIES", "social_butterfly", None, "%-24s %5d of %d, %5.1f%%",
     "username unique_interactions total_humans pct", "unique_interactions DESC, username"),
    ("SELECTIVE SOCIALIZERS", "selective_socializers", None, "%-24s %5d", "username unique_interactions",
     "unique_interactions, username"),
    ("ENGAGEMENT MAGNETS", "engagement_magnetism", None, "%-24s %6.2f (%d for %d)",
     "username engagement_ratio total_engagement sent", "engagement_ratio DESC, username"),
    ("LOW ENGAGEMENT", "low_engagement", None, "%-24s %6.2f", "username engagement_ratio",
     "engagement_ratio, username"),
    ("LONGEST ABSENCES", "ghost_gap", None, "%-24s %8.4f days, %6.1f on average",
     "username longest_absence_days avg_gap_days", "longest_absence_days DESC, username"),
    ("CHANNEL LOYALTY", "channel_loyalty", None, "%-24s #%s %5.1f%%", "username home_channel home_pct",
     "home_pct DESC, username"),
    ("CHANNEL SPREAD", "channel_spread", None, "%-24s #%s %5.1f%%", "username home_channel home_pct",
     "home_pct, username"),
    ("CONCENTRATION", "activity_concentration", None, "%-24s %7d %5.1f%% %5.1f%%",
     "username msgs pct cumulative", "rn"),
    ("VIRAL MESSAGES", "viral_messages", None, "%-24s #%s %5d", "username channel reply_count",
     "reply_count DESC, created_at"),
    ("LATE NIGHT CREW", "late_night_crew", None, "%s <-> %s %5d", "user_1 user_2 exchanges",
     "exchanges DESC, user_1, user_2"),
    ("RAMBLERS", "rambler", None, "%-24s %8.1f %6d", "username avg_length max_length", "avg_length DESC, username"),
    ("SUCCINCT", "succinct", None, "%-24s %8.1f", "username avg_length", "avg_length, username"),
    ("LAUGHS", "laugh_count", None, "%-24s %6d", "username laugh_count", "laugh_count DESC, username"),
    ("LINKS", "link_count", None, "%-24s %6d", "username link_count", "link_count DESC, username"),
    ("OWN CARDS", "personal_wrapped", None, "%s: %d messages, rank %d of %d, #%s, %s, busiest %s (%d)",
     "username total_msgs rank total_users fav_channel best_friend busiest_date busiest_count",
     "total_msgs DESC, user_id"),
]


def _printed(fmt: str, cols: list[str]) -> str:
    """The columns of a line as arguments: what a text sign prints is text."""
    signs = [p[p.find("%") + 1:] for p in fmt.replace("%%", "").split() if "%" in p]
    kinds = [c for s in "".join("%" + x for x in signs).split("%") if s for c in s if c in "sdf"][:len(cols)]
    return ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" if k == "s" else c for c, k in zip(cols, kinds, strict=True))


def _section(no: int, title: str, query: str, change, fmt: str, cols: str, order: str) -> str:
    body = REGISTRY[query].body
    if isinstance(change, tuple):
        assert change[0] in body, title
        body = body.replace(*change)
    rows = f"SELECT * FROM ({body}) b" + (f" WHERE {change}" if isinstance(change, str) else "")
    if query in ("channel_leaderboard", "personal_wrapped"):
        rows += f" ORDER BY {order} LIMIT 10"
    return f"""
SELECT {no} AS section, CAST(0 AS BIGINT) AS line_no, '== {title} ==' AS text
UNION ALL SELECT {no}, line_no + 1, printf('%2d. {fmt}', line_no, {_printed(fmt, cols.split())})
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS line_no FROM ({rows}) r) s"""


# Bots and what they wrote leave before any section sees the tables
_REPORT = f"""
WITH h_messages AS (SELECT * FROM messages WHERE author_id IS NULL
                    OR author_id NOT IN (SELECT id FROM users WHERE is_bot)),
h_mentions AS (SELECT * FROM message_mentions SEMI JOIN h_messages ON h_messages.id = message_id),
h_users AS (SELECT * FROM users WHERE NOT coalesce(is_bot, false))
SELECT * FROM (
WITH messages AS (SELECT * FROM h_messages), message_mentions AS (SELECT * FROM h_mentions),
users AS (SELECT * FROM h_users)
SELECT * FROM ({" UNION ALL ".join(_section(i, *line) for i, line in enumerate(_LINES, 1))}) lines) report"""


@register("year_report", _REPORT)
def _year_report(t):
    return report.year_report(t, humans_only=True, min_card=50)
