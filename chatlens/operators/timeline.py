"""Time patterns, trends and dashboard figures.

All hours and days are UTC. Aggregates run per hour / weekday / day first;
the few windows that follow run over those small results (at most one row
per day), never over the raw messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlens.functions.columns import idiv, round_ratio, weekday_sun0
from chatlens.operators.common import humans, in_window, share, since, top_k, total_of

DESC, ASC = F.desc_nulls_last, F.asc_nulls_first

# Weekday names, Sunday = 0.
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def _day_name(day: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), day + 1)


def messages_by_hour(messages: DataFrame, as_string: bool = True) -> DataFrame:
    h = F.date_format("created_at", "HH") if as_string else F.hour("created_at")
    return messages.groupBy(h.alias("hour")).agg(F.count(F.lit(1)).alias("message_count")) \
        .orderBy("hour")


def peak_hours_share(messages: DataFrame) -> DataFrame:
    g = messages.groupBy(F.hour("created_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("message_count"))
    total = total_of(g, F.sum("message_count"))
    return g.withColumn("percentage", share(F.col("message_count"), total, 2)).orderBy("hour")


def hourly_bars(messages: DataFrame, width: int = 30) -> DataFrame:
    g = messages.groupBy(F.hour("created_at").alias("hour")).agg(F.count(F.lit(1)).alias("messages"))
    peak = total_of(g, F.max("messages"))
    return g.withColumn("bar", F.repeat(F.lit("#"), idiv(F.col("messages") * width, peak).cast("int"))) \
        .orderBy("hour")


def peak_hour(messages: DataFrame) -> DataFrame:
    """Busiest hour (the earliest one on ties)."""
    g = messages.groupBy(F.hour("created_at").alias("hour")).agg(F.count(F.lit(1)).alias("messages"))
    return g.agg(F.max_by(F.struct("hour", "messages"), F.struct(F.col("messages"), -F.col("hour")))
                 .alias("p")).select("p.hour", "p.messages")


def hourly_activity_filled(messages: DataFrame, spark: SparkSession, as_of=None,
                           days: int = 30) -> DataFrame:
    """All 24 hours, zeros filled (a 24-row range joined to the counts)."""
    win = messages.filter(in_window("created_at", as_of, days))
    g = win.groupBy(F.hour("created_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("message_count"), F.countDistinct("author_id").alias("unique_users"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(F.broadcast(g), "hour", "left").select(
        "hour", F.coalesce("message_count", F.lit(0)).alias("message_count"),
        F.coalesce("unique_users", F.lit(0)).alias("unique_users")).orderBy("hour")


def messages_by_weekday(messages: DataFrame) -> DataFrame:
    g = messages.groupBy(weekday_sun0("created_at").alias("day_num")).agg(
        F.count(F.lit(1)).alias("message_count"))
    return g.select("day_num", _day_name(F.col("day_num")).alias("day_of_week"), "message_count") \
        .orderBy("day_num")


def weekday_bars(messages: DataFrame, width: int = 30) -> DataFrame:
    """Messages per weekday with a bar; the busiest day's bar is ``width`` long."""
    g = messages_by_weekday(messages)
    peak = total_of(g, F.max("message_count"))
    return g.withColumn("bar", F.repeat(F.lit("#"), idiv(F.col("message_count") * width, peak).cast("int"))) \
        .orderBy("day_num")


def weekday_filled(messages: DataFrame, spark: SparkSession, as_of=None, days: int = 30) -> DataFrame:
    win = messages.filter(in_window("created_at", as_of, days))
    g = win.groupBy(weekday_sun0("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("message_count"))
    d = spark.range(7).select(F.col("id").cast("int").alias("day"))
    return d.join(F.broadcast(g), "day", "left").select(
        "day", _day_name(F.col("day")).alias("day_name"),
        F.coalesce("message_count", F.lit(0)).alias("message_count")).orderBy("day")


def weekday_weekend_ratio(messages: DataFrame) -> DataFrame:
    wd = weekday_sun0("created_at")
    a = messages.agg(F.count(F.when(~wd.isin(0, 6), 1)).alias("weekday"),
                     F.count(F.when(wd.isin(0, 6), 1)).alias("weekend"))
    denom = F.when(F.col("weekday") == 0, F.lit(1)).otherwise(F.col("weekday"))
    return a.select("weekday", "weekend", share(F.col("weekend"), denom).alias("ratio"))


def peak_weekday(messages: DataFrame) -> DataFrame:
    g = messages.groupBy(weekday_sun0("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    p = g.agg(F.max_by("day", F.struct(F.col("n"), -F.col("day"))).alias("day"))
    return p.select(_day_name(F.col("day")).alias("day_name"))


def night_owls(messages: DataFrame, users: DataFrame, min_messages: int = 50, with_id: bool = False) -> DataFrame:
    """Hour bands, both ends inclusive as in the reference (5, 9 and 17 fall
    in two bands)."""
    h = F.hour("created_at")
    per = messages.groupBy(F.col("author_id").alias("uid")).agg(
        F.count(F.when(h.between(0, 5), 1)).alias("night_owl"),
        F.count(F.when(h.between(5, 9), 1)).alias("early_bird"),
        F.count(F.when(h.between(9, 17), 1)).alias("work_hours"),
        F.count(F.when(h.between(17, 24), 1)).alias("evening"),
        F.count(F.lit(1)).alias("total"))
    j = per.filter(F.col("total") >= min_messages).join(
        users.select(F.col("id").alias("uid"), "username"), "uid")
    return top_k(j, [DESC("night_owl"), ASC("uid")], None).select(
        *(["uid"] if with_id else []), "username", "night_owl", "early_bird", "work_hours", "evening", "total")


def night_and_early(messages: DataFrame, users: DataFrame, min_messages: int = 50, k: int = 5) -> DataFrame:
    """The k users with the most messages at night and those with the most in
    the early morning, each with the share of their own messages. Both lists
    come from one row per user."""
    per = night_owls(messages, users, min_messages, with_id=True)
    lists = []
    for name, band in (("night_owl", "night_owl"), ("early_bird", "early_bird")):
        top = per.orderBy(DESC(band), ASC("uid")).limit(k)
        w = Window.orderBy(DESC(band), ASC("uid"))      # over k rows
        lists.append(top.select(F.lit(name).alias("list"), F.row_number().over(w).alias("place"), "username",
                                F.col(band).alias("messages"), "total",
                                share(F.col(band), F.col("total")).alias("pct")))
    return lists[0].unionByName(lists[1])


def night_owl_share(messages: DataFrame, users: DataFrame, min_messages: int = 50,
                    k: int | None = 5) -> DataFrame:
    per = messages.groupBy(F.col("author_id").alias("uid")).agg(
        F.count(F.when(F.hour("created_at").between(0, 5), 1)).alias("late_msgs"),
        F.count(F.lit(1)).alias("total"))
    j = per.filter(F.col("total") >= min_messages).join(
        humans(users).select(F.col("id").alias("uid"), "username"), "uid")
    j = j.withColumn("pct", share(F.col("late_msgs"), F.col("total")))
    return top_k(j, [DESC("pct"), ASC("uid")], k).select("username", "late_msgs", "total", "pct")


def weekend_warriors(messages: DataFrame, users: DataFrame, min_messages: int = 50,
                     k: int | None = 10) -> DataFrame:
    wd = weekday_sun0("created_at")
    per = messages.groupBy(F.col("author_id").alias("uid")).agg(
        F.count(F.when(wd.isin(0, 6), 1)).alias("weekend_msgs"),
        F.count(F.when(~wd.isin(0, 6), 1)).alias("weekday_msgs"),
        F.count(F.lit(1)).alias("total"))
    j = per.filter(F.col("total") >= min_messages).join(
        users.select(F.col("id").alias("uid"), "username"), "uid")
    j = j.withColumn("weekend_ratio", share(F.col("weekend_msgs"), F.col("weekday_msgs")))
    return top_k(j, [DESC("weekend_ratio"), ASC("uid")], k).select(
        "username", "weekend_msgs", "weekday_msgs", "total", "weekend_ratio")


def busiest_dates(messages: DataFrame, k: int | None = 10) -> DataFrame:
    g = messages.groupBy(F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("message_count"), F.countDistinct("author_id").alias("active_users"))
    return top_k(g, [DESC("message_count"), ASC("date")], k)


def daily_trend(messages: DataFrame, as_of=None, days: int = 14) -> DataFrame:
    win = messages.filter(in_window("created_at", as_of, days))
    return win.groupBy(F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("message_count"), F.countDistinct("author_id").alias("active_users")) \
        .orderBy("date")


def monthly_trend(messages: DataFrame, width: int = 25) -> DataFrame:
    g = messages.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("messages"), F.countDistinct("author_id").alias("active_users"))
    peak = total_of(g, F.max("messages"))
    return g.withColumn("bar", F.repeat(F.lit("#"), idiv(F.col("messages") * width, peak).cast("int"))) \
        .orderBy("month")


def peak_and_slowest_month(messages: DataFrame) -> DataFrame:
    g = messages.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("messages"))
    # earliest month on ties, for both picks
    return g.agg(F.min_by("month", F.struct(-F.col("messages"), F.col("month"))).alias("peak_month"),
                 F.max("messages").alias("peak_messages"),
                 F.min_by("month", F.struct(F.col("messages"), F.col("month"))).alias("slowest_month"),
                 F.min("messages").alias("slowest_messages"))


def timeline(messages: DataFrame, as_of=None, days: int = 30, granularity: str = "day") -> DataFrame:
    if granularity not in ("hour", "day", "week"):
        raise ValueError("granularity must be hour, day or week")
    win = messages.filter(in_window("created_at", as_of, days))
    if granularity == "day":
        period = F.date_format(F.to_date("created_at"), "yyyy-MM-dd")
    else:
        period = F.date_format(F.date_trunc(granularity, "created_at"), "yyyy-MM-dd HH:mm:ss")
    return win.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("count")).orderBy("period")


def rolling_average(messages: DataFrame, window_days: int = 7) -> DataFrame:
    """Mean of the daily counts over the current and previous 6 *rows*
    (days without messages are absent, as in the reference). The window
    runs over the per-day table, one row per active day."""
    d = messages.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.orderBy("day").rowsBetween(-(window_days - 1), 0)
    return d.select("day", "count", round_ratio(F.sum("count").over(w), F.count("count").over(w), 4)
                    .alias("rolling_avg")).orderBy(F.desc("day"))


def latest_per_author(messages: DataFrame, bucket: str = "hour") -> DataFrame:
    """``row_number() over (partition by author order by created_at desc)``
    without one task per author: rows are numbered inside (author, bucket)
    and offset by the messages of that author in later buckets, taken from
    a per-(author, bucket) count table with a running sum per author. The
    NULL author (deleted users) is a group of its own, keyed by a sentinel
    (ids are non-negative) so the join back reuses the window partitioning."""
    key = F.coalesce(F.col("author_id"), F.lit(-(2 ** 63)).cast("long"))
    m = messages.select("author_id", "created_at", "id").withColumn("_k", key) \
        .withColumn("_b", F.date_trunc(bucket, "created_at"))
    inner = Window.partitionBy("_k", "_b").orderBy(F.desc("created_at"), F.desc("id"))
    m = m.withColumn("_r", F.row_number().over(inner))
    counts = m.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy("_k").orderBy(F.desc("_b")).rowsBetween(
        Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(later), F.lit(0))).drop("_n")
    j = m.join(counts, ["_k", "_b"])
    return j.select("author_id", "created_at", (F.col("_off") + F.col("_r")).cast("int").alias("rn"))


def overview(messages: DataFrame, channels: DataFrame, mentions: DataFrame, as_of=None,
             days: int = 30) -> DataFrame:
    """Dashboard header: current against previous period in one scan."""
    start, prev = since(as_of, days), since(as_of, 2 * days)
    ts = F.col("created_at")
    cur = ts >= start
    old = (ts >= prev) & (ts < start)
    a = messages.filter(ts >= prev).agg(
        F.count(F.when(cur, 1)).alias("total_messages"),
        F.countDistinct(F.when(cur, F.col("author_id"))).alias("total_users"),
        F.sum(F.when(cur, F.col("char_count"))).alias("_c"),
        F.count(F.when(cur, F.col("char_count"))).alias("_nc"),
        F.count(F.when(old, 1)).alias("prev_messages"),
        F.countDistinct(F.when(old, F.col("author_id"))).alias("prev_users"))
    in_win = messages.filter(cur).select(F.col("id").alias("message_id"))
    n_mentions = total_of(mentions.join(in_win, "message_id", "left_semi"), F.count(F.lit(1)))
    n_channels = total_of(channels, F.count(F.lit(1)))

    def change(c, p):
        return F.when(F.col(p) > 0, share(F.col(c) - F.col(p), F.col(p))).otherwise(F.lit(0.0))

    return a.select(
        "total_messages", "total_users", n_channels.alias("total_channels"),
        n_mentions.alias("total_mentions"),
        change("total_messages", "prev_messages").alias("messages_change_percent"),
        change("total_users", "prev_users").alias("users_change_percent"),
        round_ratio(F.col("total_messages"), F.lit(max(days, 1)), 1).alias("avg_messages_per_day"),
        F.coalesce(round_ratio(F.col("_c"), F.col("_nc"), 1), F.lit(0.0)).alias("avg_message_length"))


def engagement_metrics(messages: DataFrame, users: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    win = messages.filter(in_window("created_at", as_of, days))
    a = win.agg(F.count(F.lit(1)).alias("total"),
                F.count(F.when(F.col("reply_to_message_id").isNotNull(), 1)).alias("replies"),
                F.count(F.when(F.col("mention_count") > 0, 1)).alias("with_mentions"),
                F.countDistinct("author_id").alias("active"))
    n_users = total_of(users, F.count(F.lit(1)))
    tm = F.greatest(F.col("total"), F.lit(1))
    return a.select(
        share(F.col("replies"), tm).alias("reply_rate"),
        share(F.col("with_mentions"), tm).alias("mention_rate"),
        share(F.col("active"), F.greatest(n_users, F.lit(1))).alias("active_user_ratio"),
        round_ratio(tm, F.greatest(F.col("active"), F.lit(1)), 1).alias("messages_per_active_user"))
