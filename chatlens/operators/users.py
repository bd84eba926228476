"""User activity.

Rank lists order by the metric, then by user id (the reference leaves ties
open). Fact tables are aggregated to one row per user *before* they meet
the users dimension, so joins carry small inputs and partial aggregation
absorbs hot authors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.functions.columns import micros_between, round_ratio
from chatlens.operators.common import (adjacent, humans, in_window, rank_desc, share,
                                       top_k, total_of)

DESC, ASC = F.desc_nulls_last, F.asc_nulls_first
DAY_US = 86_400_000_000


def _per_author(messages: DataFrame, *aggs) -> DataFrame:
    return messages.groupBy(F.col("author_id").alias("uid")).agg(*aggs)


def _u(users: DataFrame, *extra: str) -> DataFrame:
    return users.select(F.col("id").alias("uid"), "username", "global_name", *extra)


def top_users(users: DataFrame, messages: DataFrame, k: int | None = 10) -> DataFrame:
    """Messages per user, users without messages included (count 0)."""
    cnt = _per_author(messages, F.count("id").alias("message_count"))
    j = _u(users).join(cnt, "uid", "left").withColumn(
        "message_count", F.coalesce("message_count", F.lit(0)))
    return top_k(j, [DESC("message_count"), ASC("uid")], k).select(
        "username", "global_name", "message_count")


def top_messagers_share(messages: DataFrame, users: DataFrame, k: int | None = 10) -> DataFrame:
    total = total_of(messages, F.count(F.lit(1)))
    cnt = _per_author(messages, F.count(F.lit(1)).alias("message_count"))
    j = cnt.join(_u(users), "uid")
    j = j.select("uid", "username",
                 F.coalesce("global_name", "username").alias("display_name"),
                 "message_count", share(F.col("message_count"), total).alias("pct"))
    return top_k(j, [DESC("message_count"), ASC("uid")], k).drop("uid")


def messages_by_user_window(messages: DataFrame, users: DataFrame, server_id: int,
                            days: int = 30, as_of=None) -> DataFrame:
    m = messages.filter((F.col("server_id") == server_id)
                        & in_window("created_at", as_of, days, strict=True))
    agg = _per_author(m, F.count(F.lit(1)).alias("message_count"),
                      F.countDistinct("channel_id").alias("channels_active"),
                      F.count(F.when(F.col("reply_to_message_id").isNotNull(), 1))
                      .alias("reply_count"))
    j = agg.join(_u(users), "uid")
    return top_k(j, [DESC("message_count"), ASC("uid")], None).select(
        "username", "global_name", "message_count", "channels_active", "reply_count")


def server_top_authors(messages: DataFrame, users: DataFrame, server_id: int,
                       k: int | None = 10) -> DataFrame:
    cnt = _per_author(messages.filter(F.col("server_id") == server_id),
                      F.count(F.lit(1)).alias("message_count"))
    j = cnt.join(_u(users), "uid")
    return top_k(j, [DESC("message_count"), ASC("uid")], k).select(
        "username", "global_name", "message_count")


def message_count_by_user(users: DataFrame, messages: DataFrame, k: int | None = 15) -> DataFrame:
    cnt = _per_author(messages, F.count(F.lit(1)).alias("message_count"))
    j = cnt.join(_u(users), "uid")
    return top_k(j, [DESC("message_count"), ASC("uid")], k).select("username", "message_count")


def top_users_detail(users: DataFrame, messages: DataFrame, mentions: DataFrame,
                     as_of=None, days: int = 30, k: int | None = 15) -> DataFrame:
    """Dashboard user list: users with a message in the window, their mean
    length, mentions and replies received in the window. The reference's
    two correlated subqueries become two pre-aggregations joined by user."""
    win = messages.filter(in_window("created_at", as_of, days))
    base = _per_author(win, F.count("id").alias("message_count"),
                       F.sum("char_count").alias("_chars"), F.count("char_count").alias("_n"))
    ment = mentions.join(win.select(F.col("id").alias("message_id")), "message_id") \
        .groupBy(F.col("mentioned_user_id").alias("uid")).agg(
            F.count(F.lit(1)).alias("mention_count"))
    reps = win.filter(F.col("reply_to_author_id").isNotNull()) \
        .groupBy(F.col("reply_to_author_id").alias("uid")).agg(
            F.count(F.lit(1)).alias("reply_count"))
    j = base.filter(F.col("message_count") > 0).join(
        users.select(F.col("id").alias("uid"), "username", "is_bot"), "uid") \
        .join(ment, "uid", "left").join(reps, "uid", "left")
    j = j.select(F.col("uid").cast("string").alias("user_id"), "uid", "username",
                 F.coalesce("is_bot", F.lit(False)).alias("is_bot"), "message_count",
                 F.coalesce(round_ratio(F.col("_chars"), F.col("_n"), 1), F.lit(0.0))
                 .alias("avg_message_length"),
                 F.coalesce("mention_count", F.lit(0)).alias("mention_count"),
                 F.coalesce("reply_count", F.lit(0)).alias("reply_count"))
    return top_k(j, [DESC("message_count"), ASC("uid")], k).drop("uid")


def reactions_given(users: DataFrame, reactions: DataFrame, k: int | None = 10) -> DataFrame:
    cnt = reactions.groupBy(F.col("user_id").alias("uid")).agg(
        F.count("user_id").alias("reactions_given"))
    j = _u(users).join(cnt, "uid", "left").withColumn(
        "reactions_given", F.coalesce("reactions_given", F.lit(0)))
    return top_k(j, [DESC("reactions_given"), ASC("uid")], k).select(
        "username", "global_name", "reactions_given")


def top_reaction_givers(reactions: DataFrame, users: DataFrame, k: int | None = 10) -> DataFrame:
    """Grouped by username, as the reference does (same names merge)."""
    cnt = reactions.groupBy(F.col("user_id").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    j = cnt.join(_u(users), "uid").groupBy("username").agg(
        F.sum("n").alias("reactions_given"))
    return top_k(j, [DESC("reactions_given"), ASC("username")], k)


def reactions_received(users: DataFrame, messages: DataFrame, reactions: DataFrame,
                       k: int | None = 10) -> DataFrame:
    per_msg = reactions.groupBy("message_id").agg(F.count("message_id").alias("n"))
    per_author = messages.select(F.col("id").alias("message_id"), F.col("author_id").alias("uid")) \
        .join(per_msg, "message_id").groupBy("uid").agg(F.sum("n").alias("reactions_received"))
    j = _u(users).join(per_author, "uid", "left").withColumn(
        "reactions_received", F.coalesce("reactions_received", F.lit(0)).cast("long"))
    return top_k(j, [DESC("reactions_received"), ASC("uid")], k).select(
        "username", "global_name", "reactions_received")


def reactors(reactions: DataFrame, users: DataFrame, k: int | None = 10) -> DataFrame:
    cnt = reactions.groupBy(F.col("user_id").alias("uid")).agg(
        F.count(F.lit(1)).alias("total_reactions"),
        F.countDistinct("emoji_id").alias("unique_emojis_used"))
    j = cnt.join(_u(users), "uid")
    return top_k(j, [DESC("total_reactions"), ASC("uid")], k).select(
        "username", "global_name", "total_reactions", "unique_emojis_used")


def mentions_given(users: DataFrame, messages: DataFrame, mentions: DataFrame,
                   k: int | None = 10) -> DataFrame:
    per_msg = mentions.groupBy("message_id").agg(F.count("message_id").alias("n"))
    per_author = messages.select(F.col("id").alias("message_id"), F.col("author_id").alias("uid")) \
        .join(per_msg, "message_id").groupBy("uid").agg(F.sum("n").alias("mentions_given"))
    j = _u(users).join(per_author, "uid", "left").withColumn(
        "mentions_given", F.coalesce("mentions_given", F.lit(0)).cast("long"))
    return top_k(j, [DESC("mentions_given"), ASC("uid")], k).select(
        "username", "global_name", "mentions_given")


def mentions_received(users: DataFrame, mentions: DataFrame, k: int | None = 10) -> DataFrame:
    cnt = mentions.groupBy(F.col("mentioned_user_id").alias("uid")).agg(
        F.count("mentioned_user_id").alias("mentions_received"))
    j = _u(users).join(cnt, "uid", "left").withColumn(
        "mentions_received", F.coalesce("mentions_received", F.lit(0)))
    return top_k(j, [DESC("mentions_received"), ASC("uid")], k).select(
        "username", "global_name", "mentions_received")


def _by_bot_flag(messages: DataFrame, users: DataFrame) -> DataFrame:
    cnt = _per_author(messages, F.count("id").alias("n"))
    return cnt.join(users.select(F.col("id").alias("uid"), "is_bot"), "uid")


def bot_vs_human(messages: DataFrame, users: DataFrame) -> DataFrame:
    j = _by_bot_flag(messages, users)
    return j.groupBy("is_bot").agg(F.sum("n").alias("message_count"),
                                   F.count(F.lit(1)).alias("unique_users")).select(
        F.when(F.col("is_bot"), "Bot").otherwise("Human").alias("user_type"),
        "message_count", "unique_users")


def bot_vs_human_share(messages: DataFrame, users: DataFrame) -> DataFrame:
    j = _by_bot_flag(messages, users).groupBy("is_bot").agg(F.sum("n").alias("message_count"))
    total = total_of(j, F.sum("message_count"))
    return j.select(F.when(F.col("is_bot"), "Bot").otherwise("Human").alias("type"),
                    "message_count", share(F.col("message_count"), total).alias("percentage"))


def bot_vs_human_pivot(messages: DataFrame, users: DataFrame, as_of=None,
                       days: int = 30) -> DataFrame:
    win = messages.filter(in_window("created_at", as_of, days))
    j = _by_bot_flag(win, users)
    a = j.agg(F.coalesce(F.sum(F.when(~F.col("is_bot"), F.col("n"))), F.lit(0)).alias("human_messages"),
              F.coalesce(F.sum(F.when(F.col("is_bot"), F.col("n"))), F.lit(0)).alias("bot_messages"))
    tot = F.col("human_messages") + F.col("bot_messages")
    return a.select("human_messages", "bot_messages",
                    F.coalesce(share(F.col("human_messages"), tot), F.lit(0.0)).alias("human_percentage"),
                    F.coalesce(share(F.col("bot_messages"), tot), F.lit(0.0)).alias("bot_percentage"))


def activity_level(messages: DataFrame, users: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    win = messages.filter(in_window("created_at", as_of, days))
    cnt = _per_author(win, F.count(F.lit(1)).alias("messages")).join(_u(users), "uid")
    n = F.col("messages")
    lvl = (F.when(n > 500, "power_user").when(n > 100, "active").when(n > 20, "casual")
           .otherwise("lurker"))
    return top_k(cnt.withColumn("activity_level", lvl), [DESC("messages"), ASC("uid")], None) \
        .select("username", "messages", "activity_level")


def activity_distribution(messages: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    win = messages.filter(in_window("created_at", as_of, days))
    n = F.col("msg_count")
    lvl = (F.when(n == 1, "1 message").when(n.between(2, 5), "2-5 messages")
           .when(n.between(6, 20), "6-20 messages").when(n.between(21, 50), "21-50 messages")
           .when(n.between(51, 100), "51-100 messages").otherwise("100+ messages"))
    per = win.groupBy("author_id").agg(F.count(F.lit(1)).alias("msg_count"))
    return per.groupBy(lvl.alias("level")).agg(F.count(F.lit(1)).alias("users"),
                                                F.min("msg_count").alias("_o")) \
        .orderBy("_o").drop("_o")


def user_activity_score(users: DataFrame, messages: DataFrame, min_messages: int = 5,
                        k: int | None = 15) -> DataFrame:
    """PostgreSQL ``AVG(word_count)::int`` rounds half away from zero."""
    per = _per_author(messages, F.count(F.lit(1)).alias("messages"),
                      F.sum("word_count").alias("_w"), F.count("word_count").alias("_nw"),
                      F.countDistinct(F.to_date("created_at")).alias("active_days"))
    j = per.filter(F.col("messages") > min_messages).join(_u(users), "uid")
    j = j.withColumn("avg_words", round_ratio(F.col("_w"), F.col("_nw"), 0).cast("int"))
    return top_k(j, [DESC("messages"), ASC("uid")], k).select(
        "username", "messages", "avg_words", "active_days")


def weekly_active_users(users: DataFrame, messages: DataFrame, as_of=None,
                        days: int = 7) -> DataFrame:
    win = messages.filter(in_window("created_at", as_of, days))
    per = _per_author(win, F.count(F.lit(1)).alias("messages_this_week"),
                      F.max("created_at").alias("last_message"))
    j = per.join(_u(users), "uid")
    return top_k(j, [DESC("messages_this_week"), ASC("uid")], None).select(
        "username", "messages_this_week", "last_message")


def consistency(messages: DataFrame, users: DataFrame, min_days: int = 10,
                k: int | None = 15) -> DataFrame:
    h = humans(users)
    daily = messages.groupBy(F.col("author_id").alias("uid"),
                             F.to_date("created_at").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    per = daily.groupBy("uid").agg(F.count(F.lit(1)).alias("active_days"),
                                   F.sum("n").alias("total_msgs"))
    j = per.filter(F.col("active_days") >= min_days).join(_u(h), "uid")
    j = j.select("uid", "username",
                 round_ratio(F.col("total_msgs"), F.col("active_days"), 4).alias("avg_daily"),
                 "active_days", "total_msgs",
                 round_ratio(F.col("total_msgs"), F.col("active_days"), 1)
                 .alias("msgs_per_active_day"))
    return top_k(j, [DESC("active_days"), ASC("uid")], k).drop("uid")


def longest_streak(messages: DataFrame, users: DataFrame, k: int | None = 10) -> DataFrame:
    """Gaps and islands over distinct (author, UTC day). The window runs per
    author over days, so a task holds at most one row per active day."""
    h = humans(users).select(F.col("id").alias("uid"), "username")
    days = messages.select(F.col("author_id").alias("uid"), F.to_date("created_at").alias("d")) \
        .distinct()
    w = Window.partitionBy("uid").orderBy("d")
    isl = days.withColumn("grp", F.date_sub(F.col("d"), F.row_number().over(w).cast("int")))
    streaks = isl.groupBy("uid", "grp").agg(F.min("d").alias("start"),
                                            F.count(F.lit(1)).alias("len"))
    best = streaks.groupBy("uid").agg(
        F.max("len").alias("longest_streak"),
        F.min_by("start", F.struct(-F.col("len"), F.col("start"))).alias("best_streak_start"))
    j = best.join(h, "uid")
    return top_k(j, [DESC("longest_streak"), ASC("uid")], k).select(
        "username", "longest_streak", "best_streak_start")


def ghost_gap(messages: DataFrame, users: DataFrame, min_gaps: int = 20,
              k: int | None = 10) -> DataFrame:
    """Longest and mean gap (days) between a user's consecutive messages.

    The mean needs only the count and both ends. The longest gap is looked for
    between a user's days (one row each: first and last message), so no window
    runs over raw rows; only days that last longer than the longest gap between
    days can hold a longer one, and of these alone the messages are read again
    (neighbours by hour, so a user who writes all day is spread)."""
    h = humans(users).select(F.col("id").alias("uid"), "username")
    m = messages.filter(F.col("author_id").isNotNull()).select(
        F.col("author_id").alias("uid"), F.to_date("created_at").alias("d"), "created_at", "id")
    days = m.groupBy("uid", "d").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first"),
                                     F.max("created_at").alias("last"))
    own = Window.partitionBy("uid")
    days = days.withColumn("gap", micros_between(F.lag("last").over(own.orderBy("d")), "first")) \
        .withColumn("across", F.coalesce(F.max("gap").over(own), F.lit(0)))
    per = days.groupBy("uid").agg((F.sum("n") - 1).alias("_n"), F.max("across").alias("_across"),
                                  micros_between(F.min("first"), F.max("last")).alias("_sum")) \
        .filter(F.col("_n") >= min_gaps).join(h, "uid")
    wide = days.filter(micros_between("first", "last") > F.col("across")).join(per, "uid", "left_semi")
    inside = adjacent(m.join(wide.select("uid", "d"), ["uid", "d"], "left_semi"), ["uid", "d"],
                      "created_at", "id", ["created_at"], which="prev")
    inside = inside.groupBy("uid").agg(F.max(micros_between("prev_created_at", "created_at")).alias("_inside"))
    j = per.join(inside, "uid", "left").withColumn("_max", F.greatest("_across", "_inside")).select(
        "uid", "username", round_ratio(F.col("_max"), F.lit(DAY_US), 4).alias("longest_absence_days"),
        round_ratio(F.col("_sum"), F.col("_n") * DAY_US, 1).alias("avg_gap_days"), "_max")
    return top_k(j, [DESC("_max"), ASC("uid")], k).drop("uid", "_max")


def channel_loyalty(messages: DataFrame, channels: DataFrame, users: DataFrame,
                    min_total: int = 50, k: int | None = 15) -> DataFrame:
    """Home channel of each user: the most used one (lowest id on ties)."""
    h = humans(users).select(F.col("id").alias("uid"), "username")
    uc = messages.groupBy(F.col("author_id").alias("uid"), "channel_id").agg(
        F.count(F.lit(1)).alias("msgs")).join(
        channels.select(F.col("id").alias("channel_id"), F.col("name").alias("home_channel")),
        "channel_id")
    per = uc.groupBy("uid").agg(
        F.sum("msgs").alias("total"),
        F.max_by(F.struct("home_channel", "msgs"),
                 F.struct(F.col("msgs"), -F.col("channel_id"))).alias("home"))
    j = per.filter(F.col("total") >= min_total).join(h, "uid").select(
        "uid", "username", F.col("home.home_channel").alias("home_channel"),
        F.col("home.msgs").alias("home_msgs"), "total",
        share(F.col("home.msgs"), F.col("total")).alias("home_pct"))
    return top_k(j, [DESC("home_pct"), ASC("uid")], k).drop("uid")


def channel_spread(messages: DataFrame, channels: DataFrame, users: DataFrame,
                   min_total: int = 50, k: int = 5, within_top: int | None = None) -> DataFrame:
    """Least loyal users; ``within_top=15`` picks them from the most loyal 15
    as the reference report does, ``None`` from everyone."""
    loyal = channel_loyalty(messages, channels, users, min_total, None)
    if within_top is not None:
        loyal = loyal.orderBy(DESC("home_pct"), ASC("username")).limit(within_top)
    return top_k(loyal, [ASC("home_pct"), ASC("username")], k).select(
        "username", "home_channel", "home_pct")


def activity_concentration(messages: DataFrame, users: DataFrame, k: int = 5) -> DataFrame:
    """Top k humans with share and running share (sum of rounded shares)."""
    h = humans(users).select(F.col("id").alias("uid"), "username")
    cnt = _per_author(messages, F.count(F.lit(1)).alias("msgs")).join(h, "uid")
    total = total_of(cnt, F.sum("msgs"))
    top = cnt.orderBy(DESC("msgs"), ASC("uid")).limit(k).withColumn("total", total)
    w = Window.orderBy(DESC("msgs"), ASC("uid"))
    top = top.withColumn("pct", share(F.col("msgs"), F.col("total"))) \
        .withColumn("rn", F.row_number().over(w))
    cum = Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    return top.select("username", "msgs", F.col("total").cast("long").alias("total"), "pct", "rn",
                      F.round(F.sum("pct").over(cum), 1).alias("cumulative"))


def new_users_by_day(server_members: DataFrame, k: int | None = 30) -> DataFrame:
    """Members per join day, newest first; members without a join time form
    one NULL day, listed first as PostgreSQL orders NULL on DESC."""
    per = server_members.groupBy(F.to_date("joined_at").alias("join_date")).agg(
        F.count(F.lit(1)).alias("new_users"))
    return top_k(per, [F.desc_nulls_first("join_date")], k)


def server_members_overview(server_members: DataFrame, users: DataFrame,
                            k: int | None = 50) -> DataFrame:
    """Newest members first; NULL join times first as PostgreSQL orders DESC."""
    j = server_members.select("user_id", "joined_at", "nickname").join(
        users.select(F.col("id").alias("user_id"), "username", "global_name", "is_bot"), "user_id")
    return top_k(j, [F.desc_nulls_first("joined_at"), ASC("user_id")], k).select(
        "username", "global_name", "is_bot", "joined_at", "nickname")


def user_rank(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Rank of every human by messages: 1 + humans with more (ties share)."""
    h = humans(users).select(F.col("id").alias("uid"))
    cnt = _per_author(messages, F.count(F.lit(1)).alias("msgs")).join(h, "uid")
    return rank_desc(cnt, "msgs")
