"""The yearly text report: every section is an operator DataFrame, turned
into text lines by ``format_string`` on the executors. The result is a
DataFrame of (section, line_no, text); nothing is collected to format it.
The jobs run when the report is asked for; its lines lie in the shared folder."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.operators import channels as C
from chatlens.operators import content as X
from chatlens.operators import graph as G
from chatlens.operators import quality as Q
from chatlens.operators import reactions as RX
from chatlens.operators import replies as R
from chatlens.operators import timeline as T
from chatlens.operators import users as U
from chatlens.operators.common import humans
from chatlens.session import shared_scratch

PART = 5        # sections of one job
JOBS = 6        # jobs at a time


def _section(no: int, title: str, df: DataFrame, fmt: str, cols: list[str],
             order: list | None = None) -> DataFrame:
    """Title line plus one formatted line per row (rows of a top-k result)."""
    w = Window.orderBy(*(order or [F.lit(1)]))
    body = df.select(F.row_number().over(w).alias("_i"), *cols)
    lines = body.select(F.lit(no).alias("section"), (F.col("_i") + 1).cast("long").alias("line_no"),
                        F.format_string("%2d. " + fmt, F.col("_i"), *[F.col(c) for c in cols])
                        .alias("text"))
    head = df.sparkSession.range(1).select(F.lit(no).alias("section"),
                                           F.lit(0).cast("long").alias("line_no"),
                                           F.lit(f"== {title} ==").alias("text"))
    return head.unionByName(lines)


def _once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: all sections scan
    what one join left, each its own columns."""
    path = shared_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _in_parts(sections: list[DataFrame]) -> DataFrame:
    """The sections' lines (some hundreds), written a few sections a job by
    concurrent jobs and read again. A single plan of fifty sections would be
    planned anew, as a whole, after each of its stages."""
    spark = sections[0].sparkSession
    parts = [reduce(DataFrame.unionByName, sections[k:k + PART]) for k in range(0, len(sections), PART)]
    paths = [shared_scratch(spark, "report-lines") for _ in parts]
    with ThreadPoolExecutor(JOBS) as jobs:
        list(jobs.map(lambda part, path: part.write.parquet(path), parts, paths))
    return spark.read.schema(sections[0].schema).parquet(*paths)


def year_report(t, humans_only: bool = False, min_card: int = 100, whole: bool = False) -> DataFrame:
    """Sections of the yearly report over the tables mapping ``t``: the main
    ones, or with ``whole`` also those on weekdays, hours of the day and first
    and last messages. The edition for humans has all of them, leaves bots out
    of every section and has further ones, among
    them the cards of the ten busiest users with ``min_card`` messages."""
    m, u, c, mm = t["messages"], t["users"], t["channels"], t["message_mentions"]
    if humans_only:         # in every section; messages of deleted authors stay
        bots = u.filter("is_bot").select("tenant_id", F.col("id").alias("author_id"))
        m = m.join(bots, ["tenant_id", "author_id"], "left_anti")
        m = _once(m, "report-messages")
        mm = _once(mm.join(m.select("tenant_id", F.col("id").alias("message_id")), ["tenant_id", "message_id"],
                           "left_semi"), "report-mentions")
        u = humans(u)
    d = F.desc_nulls_last
    secs = [
        ("THE BIG NUMBERS", Q.big_numbers(m, c, mm),
         "messages %s, active users %s, channels %s, mentions %s, replies %s",
         ["total_messages", "active_users", "channels", "total_mentions", "total_replies"], None),
        ("TOP 10 MESSAGERS", U.top_messagers_share(m, u), "%-28s %8d %5.1f%%",
         ["display_name", "message_count", "pct"], [d("message_count"), "display_name"]),
        ("CHANNEL LEADERBOARD", C.channel_leaderboard(m, c).limit(10), "#%-20s %8d %5d %5.1f%%",
         ["name", "message_count", "unique_users", "pct"], [d("message_count"), "name"]),
        ("BEST FRIENDS", G.best_friends(m, u), "%s <-> %s %8d",
         ["user_1", "user_2", "exchanges"], [d("exchanges"), "user_1", "user_2"]),
        ("MOST REPLIED-TO USERS", R.replies_received(m, u), "%-28s %10d",
         ["username", "replies_received"], [d("replies_received"), "username"]),
        ("LOW REPLY RATE", R.low_reply_rate(m, u), "%-22s %5d %7d %6.1f%%",
         ["username", "messages_sent", "replies_received", "reply_rate"], ["reply_rate", "username"]),
        ("CONVERSATION STARTERS", R.conversation_starters(m, u), "%-24s %7d %8.1f%%",
         ["username", "conversations_started", "pct_original"],
         [d("conversations_started"), "username"]),
        ("ACTIVITY BY HOUR", T.hourly_bars(m), "%02d:00 %7d %s", ["hour", "messages", "bar"], ["hour"]),
        ("ACTIVITY BY WEEKDAY", T.messages_by_weekday(m), "%-12s %7d",
         ["day_of_week", "message_count"], ["day_num"]),
        ("WEEKEND WARRIORS", T.weekend_warriors(m, u), "%-24s %6d %6d",
         ["username", "weekend_msgs", "weekday_msgs"], [d("weekend_ratio"), "username"]),
        ("ESSAY WRITERS", X.essay_writers(m, u), "%-24s %8.1f %6d",
         ["username", "avg_length", "max_length"], [d("avg_length"), "username"]),
        ("QUESTION ASKERS", X.question_askers(m, u), "%-24s %6d %6.1f%%",
         ["username", "questions", "question_pct"], [d("questions"), "username"]),
        ("MOST MENTIONED", RX.most_mentioned(mm, u), "%-24s %6d",
         ["username", "times_mentioned"], [d("times_mentioned"), "username"]),
        ("TAG HAPPY", RX.tag_happy(m, u), "%-24s %6d %6.2f",
         ["username", "mentions_given", "mentions_per_msg"], [d("mentions_given"), "username"]),
        ("MONTHLY TREND", T.monthly_trend(m), "%s %7d %5d %s",
         ["month", "messages", "active_users", "bar"], ["month"]),
        ("BUSIEST DATES", T.busiest_dates(m), "%s %7d %5d",
         ["date", "message_count", "active_users"], [d("message_count"), "date"]),
        ("FANS", G.fan_relationships(m, u), "%s -> %s %4d / %4d",
         ["fan", "idol", "fan_to_idol", "idol_to_fan"], [d("imbalance"), "fan", "idol"]),
    ]
    if whole or humans_only:
        secs += [
            ("WEEKDAY BARS", T.weekday_bars(m), "%-12s %7d %s", ["day_of_week", "message_count", "bar"], ["day_num"]),
            ("WEEKEND SHARE", T.weekday_weekend_ratio(m), "weekday %d, weekend %d, %.1f%%",
             ["weekday", "weekend", "ratio"], None),
            ("PEAK HOUR", T.peak_hour(m), "%02d:00 with %d messages", ["hour", "messages"], None),
            ("NIGHT OWLS", T.night_and_early(m, u).filter("list = 'night_owl'"), "%s: %d (%.1f%% of their total)",
             ["username", "messages", "pct"], ["place"]),
            ("EARLY BIRDS", T.night_and_early(m, u).filter("list = 'early_bird'"), "%s: %d (%.1f%% of their total)",
             ["username", "messages", "pct"], ["place"]),
            ("HYPE BUILDERS", X.exclamations(m, u), "%-24s %6d %6.2f",
             ["username", "exclamations", "excl_per_msg"], [d("excl_per_msg"), "username"]),
            ("PEAK AND SLOWEST MONTH", T.peak_and_slowest_month(m), "%s with %d, %s with %d",
             ["peak_month", "peak_messages", "slowest_month", "slowest_messages"], None),
            ("FIRST AND LAST MESSAGE", X.first_and_last_message(m, u, c), "%s: %s in #%s",
             ["which", "username", "channel"], ["which"]),
        ]
    if humans_only:
        secs += [
            ("CONSISTENCY", U.consistency(m, u), "%-24s %4d days %6.1f/day",
             ["username", "active_days", "msgs_per_active_day"], [d("active_days"), "username"]),
            ("LONGEST STREAKS", U.longest_streak(m, u), "%-24s %4d days",
             ["username", "longest_streak"], [d("longest_streak"), "username"]),
            ("CONVERSATION KILLERS", R.conversation_killers(m, u), "%-24s %6.1f%%",
             ["username", "kill_rate"], [d("kill_rate"), "username"]),
            ("CONVERSATION REVIVERS", R.conversation_revivers(m, u), "%-24s %6d",
             ["username", "revivals"], [d("revivals"), "username"]),
            ("CONVERSATION CATALYSTS", R.conversation_catalysts(m, u), "%-24s %5d of %5d",
             ["username", "successful_ignitions", "spark_attempts"], [d("successful_ignitions"), "username"]),
            ("RESPONSE SPEED", R.response_speed(m, u), "%-24s %8.1f min %6d",
             ["username", "avg_response_min", "reply_count"], ["avg_response_min", "username"]),
            ("SLOW RESPONDERS", R.slow_responders(m, u), "%-24s %8.1f min",
             ["username", "avg_response_min"], [d("avg_response_min"), "username"]),
            ("LEFT ON READ", R.left_on_read(m, mm, u), "%-24s %6.1f%% of %d",
             ["username", "left_on_read_pct", "pings_received"], [d("left_on_read_pct"), "username"]),
            ("BALANCE OF FRIENDS", G.best_friends_balance(m, u), "%s (%d) <-> %s (%d)",
             ["user_1", "a_to_b", "user_2", "b_to_a"], [d("total"), "imbalance", "user_1", "user_2"]),
            ("RECIPROCITY", G.reciprocity(m, u), "%s -> %s %4d / %4d",
             ["user_a", "user_b", "a_to_b", "b_to_a"], [d("imbalance"), "user_a", "user_b"]),
            ("SOCIAL BUTTERFLIES", G.social_butterfly(m, mm, u), "%-24s %5d of %d, %5.1f%%",
             ["username", "unique_interactions", "total_humans", "pct"], [d("unique_interactions"), "username"]),
            ("SELECTIVE SOCIALIZERS", G.selective_socializers(m, mm, u), "%-24s %5d",
             ["username", "unique_interactions"], ["unique_interactions", "username"]),
            ("ENGAGEMENT MAGNETS", G.engagement_magnetism(m, mm, u), "%-24s %6.2f (%d for %d)",
             ["username", "engagement_ratio", "total_engagement", "sent"], [d("engagement_ratio"), "username"]),
            ("LOW ENGAGEMENT", G.low_engagement(m, mm, u), "%-24s %6.2f",
             ["username", "engagement_ratio"], ["engagement_ratio", "username"]),
            ("LONGEST ABSENCES", U.ghost_gap(m, u), "%-24s %8.4f days, %6.1f on average",
             ["username", "longest_absence_days", "avg_gap_days"], [d("longest_absence_days"), "username"]),
            ("CHANNEL LOYALTY", U.channel_loyalty(m, c, u), "%-24s #%s %5.1f%%",
             ["username", "home_channel", "home_pct"], [d("home_pct"), "username"]),
            ("CHANNEL SPREAD", U.channel_spread(m, c, u), "%-24s #%s %5.1f%%",
             ["username", "home_channel", "home_pct"], ["home_pct", "username"]),
            ("CONCENTRATION", U.activity_concentration(m, u), "%-24s %7d %5.1f%% %5.1f%%",
             ["username", "msgs", "pct", "cumulative"], ["rn"]),
            ("VIRAL MESSAGES", R.viral_messages(m, u, c), "%-24s #%s %5d",
             ["username", "channel", "reply_count"], [d("reply_count"), "created_at"]),
            ("LATE NIGHT CREW", G.late_night_crew(m, u), "%s <-> %s %5d",
             ["user_1", "user_2", "exchanges"], [d("exchanges"), "user_1", "user_2"]),
            ("RAMBLERS", X.rambler(m, u), "%-24s %8.1f %6d",
             ["username", "avg_length", "max_length"], [d("avg_length"), "username"]),
            ("SUCCINCT", X.succinct(m, u), "%-24s %8.1f", ["username", "avg_length"], ["avg_length", "username"]),
            ("LAUGHS", X.laugh_count(m, u), "%-24s %6d", ["username", "laugh_count"], [d("laugh_count"), "username"]),
            ("LINKS", X.link_count(m, u), "%-24s %6d", ["username", "link_count"], [d("link_count"), "username"]),
            ("OWN CARDS", G.personal_wrapped(m, u, c, mm, min_card).orderBy(d("total_msgs"), "user_id").limit(10)
             .withColumn("best_friend", F.coalesce("best_friend", F.lit("-")))
             .withColumn("fav_channel", F.coalesce("fav_channel", F.lit("-"))),
             "%s: %d messages, rank %d of %d, #%s, %s, busiest %s (%d)",
             ["username", "total_msgs", "rank", "total_users", "fav_channel", "best_friend", "busiest_date",
              "busiest_count"], [d("total_msgs"), "user_id"]),
        ]
    def dates_as_text(df: DataFrame) -> DataFrame:
        days = [c for c in ("date", "busiest_date") if c in df.columns]
        return df.withColumns({c: F.col(c).cast("string") for c in days}) if days else df

    return _in_parts([_section(i, title, dates_as_text(df), fmt, cols, order)
                      for i, (title, df, fmt, cols, order) in enumerate(secs, 1)])


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The report as a text file: lines range-sorted by (section, line), so
    the part files read in order."""
    report.orderBy("section", "line_no").select("text").write.mode(mode).text(path)
