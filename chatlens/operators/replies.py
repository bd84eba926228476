"""Replies and conversation dynamics.

Reply relations come from one self-join of replies to their targets on
message id (``reply_edges``): the reply side is pre-filtered and both sides
are pruned to a few columns before the shuffle. Per-channel sequences use
the skew-safe ``adjacent``; the catalyst range join is an equi-join on
(channel, 30-minute bucket) followed by the exact time test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.columns import micros_between, round_ratio
from chatlens.operators.common import adjacent, humans, narrow, reply_edges, share, top_k, with_content
from chatlens.session import shared_scratch

DESC, ASC = F.desc_nulls_last, F.asc_nulls_first
MIN_US = 60_000_000


def _names(users: DataFrame, id_col: str, name_col: str = "username") -> DataFrame:
    return users.select(F.col("id").alias(id_col), F.col("username").alias(name_col))


def _human_ids(users: DataFrame, id_col: str) -> DataFrame:
    return humans(users).select(F.col("id").alias(id_col))


def reply_vs_original(messages: DataFrame) -> DataFrame:
    kind = F.when(F.col("reply_to_message_id").isNotNull(), "Reply").otherwise("Original")
    return messages.groupBy(kind.alias("message_type")).agg(F.count(F.lit(1)).alias("count"))


def _pairs(edges: DataFrame, users: DataFrame, k, names=("replier", "replied_to_user")):
    cnt = edges.groupBy("replier_id", "original_author_id").agg(
        F.count(F.lit(1)).alias("reply_count"))
    j = cnt.join(_names(users, "replier_id", names[0]), "replier_id") \
           .join(_names(users, "original_author_id", names[1]), "original_author_id")
    return top_k(j, [DESC("reply_count"), ASC("replier_id"), ASC("original_author_id")], k) \
        .select(names[0], names[1], "reply_count")


def top_reply_pairs(messages: DataFrame, users: DataFrame, k: int | None = 15) -> DataFrame:
    return _pairs(reply_edges(messages), users, k)


def server_reply_pairs(messages: DataFrame, users: DataFrame, server_id: int,
                       k: int | None = 10) -> DataFrame:
    e = reply_edges(messages.filter(F.col("server_id") == server_id))
    e = e.filter(F.col("replier_id") != F.col("original_author_id"))
    return _pairs(e, users, k)


def reply_pairs_direct(messages: DataFrame, users: DataFrame, k: int | None = 10) -> DataFrame:
    """By the stored reply_to_author_id, grouped by usernames."""
    m = messages.filter(F.col("reply_to_author_id").isNotNull()
                        & (F.col("author_id") != F.col("reply_to_author_id")))
    cnt = m.groupBy("author_id", "reply_to_author_id").agg(F.count(F.lit(1)).alias("n"))
    j = cnt.join(_names(users, "author_id", "replier"), "author_id") \
           .join(_names(users, "reply_to_author_id", "replied_to"), "reply_to_author_id")
    g = j.groupBy("replier", "replied_to").agg(F.sum("n").alias("reply_count"))
    return top_k(g, [DESC("reply_count"), ASC("replier"), ASC("replied_to")], k)


def self_replies(messages: DataFrame) -> DataFrame:
    e = reply_edges(messages)
    return e.filter(F.col("replier_id") == F.col("original_author_id")).agg(
        F.count(F.lit(1)).alias("self_reply_count"))


def replies_sent(messages: DataFrame, users: DataFrame, k: int | None = 10) -> DataFrame:
    cnt = messages.filter(F.col("reply_to_message_id").isNotNull()).groupBy(
        F.col("author_id").alias("uid")).agg(F.count(F.lit(1)).alias("replies_sent"))
    j = cnt.join(users.select(F.col("id").alias("uid"), "username", "global_name"), "uid")
    return top_k(j, [DESC("replies_sent"), ASC("uid")], k).select(
        "username", "global_name", "replies_sent")


def replies_received(messages: DataFrame, users: DataFrame, k: int | None = 10) -> DataFrame:
    cnt = reply_edges(messages).groupBy(F.col("original_author_id").alias("uid")).agg(
        F.count(F.lit(1)).alias("replies_received"))
    j = cnt.join(users.select(F.col("id").alias("uid"), "username", "global_name"), "uid")
    return top_k(j, [DESC("replies_received"), ASC("uid")], k).select(
        "username", "global_name", "replies_received")


def reply_chains(messages: DataFrame, users: DataFrame, k: int | None = 20) -> DataFrame:
    m = narrow(messages).filter(F.col("reply_to_message_id").isNotNull()).join(
        _names(users, "author_id", "author"), "author_id")
    order = [DESC("created_at"), DESC("id")]
    return with_content(top_k(m, order, k), messages, order).select(
        "id", "author", "content", "reply_to_message_id")


def viral_messages(messages: DataFrame, users: DataFrame, channels: DataFrame,
                   k: int | None = 5, preview: int = 80) -> DataFrame:
    """Messages of humans with the most replies (zero kept)."""
    per = messages.filter(F.col("reply_to_message_id").isNotNull()).groupBy(
        F.col("reply_to_message_id").alias("id")).agg(F.count(F.lit(1)).alias("reply_count"))
    m = narrow(messages).join(_human_ids(users, "author_id"), "author_id") \
        .join(channels.select(F.col("id").alias("channel_id")), "channel_id", "left_semi") \
        .join(per, "id", "left").withColumn("reply_count", F.coalesce("reply_count", F.lit(0)))
    top = top_k(m, [DESC("reply_count"), ASC("id")], k)
    j = top.join(_names(users, "author_id"), "author_id").join(
        channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel")), "channel_id")
    j = with_content(j, messages, [DESC("reply_count"), ASC("id")])
    c = F.col("content")
    cut = F.when(F.length(c) > preview, F.concat(F.substring(c, 1, preview), F.lit("..."))).otherwise(c)
    return j.select("username", F.replace(cut, F.lit("\n"), F.lit(" ")).alias("content"),
                    "channel", "created_at", "reply_count")


def low_reply_rate(messages: DataFrame, users: DataFrame, min_messages: int = 10,
                   k: int | None = 10) -> DataFrame:
    sent = messages.groupBy(F.col("author_id").alias("uid")).agg(
        F.count(F.lit(1)).alias("messages_sent")).filter(F.col("messages_sent") >= min_messages)
    rec = reply_edges(messages).groupBy(F.col("original_author_id").alias("uid")).agg(
        F.count(F.lit(1)).alias("replies_received"))
    j = sent.join(users.select(F.col("id").alias("uid"), "username"), "uid") \
        .join(rec, "uid", "left").withColumn("replies_received",
                                             F.coalesce("replies_received", F.lit(0)))
    j = j.withColumn("reply_rate", share(F.col("replies_received"), F.col("messages_sent")))
    return top_k(j, [ASC("reply_rate"), ASC("uid")], k).select(
        "username", "messages_sent", "replies_received", "reply_rate")


def conversation_starters(messages: DataFrame, users: DataFrame, min_started: int = 50,
                          k: int | None = 10) -> DataFrame:
    """The reference's correlated subquery becomes two conditional counts."""
    per = messages.groupBy(F.col("author_id").alias("uid")).agg(
        F.count(F.when(F.col("reply_to_message_id").isNull(), 1)).alias("conversations_started"),
        F.count(F.lit(1)).alias("_all"))
    j = per.filter(F.col("conversations_started") >= min_started).join(
        users.select(F.col("id").alias("uid"), "username"), "uid")
    j = j.withColumn("pct_original", share(F.col("conversations_started"), F.col("_all")))
    return top_k(j, [DESC("conversations_started"), ASC("uid")], k).select(
        "username", "conversations_started", "pct_original")


def _response_times(messages, users, min_replies, lo_us=6_000_000, hi_us=1440 * MIN_US):
    e = reply_edges(messages).filter(F.col("replier_id") != F.col("original_author_id")) \
        .withColumn("us", micros_between("original_at", "reply_at"))
    e = e.filter(F.col("us").between(lo_us, hi_us))
    per = e.groupBy(F.col("replier_id").alias("uid")).agg(
        F.count(F.lit(1)).alias("reply_count"), F.sum("us").alias("_s"))
    j = per.filter(F.col("reply_count") >= min_replies).join(
        humans(users).select(F.col("id").alias("uid"), "username"), "uid")
    return j.withColumn("avg_response_min",
                        round_ratio(F.col("_s"), F.col("reply_count") * MIN_US, 1))


def response_speed(messages: DataFrame, users: DataFrame, min_replies: int = 10,
                   k: int | None = 10) -> DataFrame:
    j = _response_times(messages, users, min_replies)
    return top_k(j, [ASC("avg_response_min"), ASC("uid")], k).select(
        "username", "avg_response_min", "reply_count")


def slow_responders(messages: DataFrame, users: DataFrame, min_replies: int = 10, k: int = 5,
                    within_top: int | None = None) -> DataFrame:
    j = _response_times(messages, users, min_replies)
    if within_top is not None:
        j = j.orderBy(ASC("avg_response_min"), ASC("uid")).limit(within_top)
    return top_k(j, [DESC("avg_response_min"), ASC("uid")], k).select(
        "username", "avg_response_min")


def left_on_read(messages: DataFrame, mentions: DataFrame, users: DataFrame,
                 min_pings: int = 20, k: int | None = 10) -> DataFrame:
    h = humans(users).select(F.col("id").alias("uid"), "username")
    ment = mentions.groupBy(F.col("mentioned_user_id").alias("uid")).agg(
        F.count(F.lit(1)).alias("n"))
    reps = reply_edges(messages).groupBy(F.col("original_author_id").alias("uid")).agg(
        F.count(F.lit(1)).alias("n"))
    pings = ment.unionByName(reps).groupBy("uid").agg(F.sum("n").alias("pings_received"))
    given = messages.filter(F.col("reply_to_message_id").isNotNull()).groupBy(
        F.col("author_id").alias("uid")).agg(F.count(F.lit(1)).alias("responses_given"))
    j = h.join(pings, "uid", "left").join(given, "uid", "left").select(
        "uid", "username", F.coalesce("pings_received", F.lit(0)).cast("long").alias("pings_received"),
        F.coalesce("responses_given", F.lit(0)).alias("responses_given"))
    j = j.filter(F.col("pings_received") >= min_pings)
    p, g = F.col("pings_received"), F.col("responses_given")
    j = j.withColumn("left_on_read_pct", F.when(p > 0, share(p - g, p)).otherwise(F.lit(0.0)))
    return top_k(j, [DESC("left_on_read_pct"), ASC("uid")], k).drop("uid")


def _human_stream(messages: DataFrame, users: DataFrame) -> DataFrame:
    return messages.select("id", "author_id", "channel_id", "created_at") \
        .join(_human_ids(users, "author_id"), "author_id")


def conversation_killers(messages: DataFrame, users: DataFrame, silence_min: int = 30,
                         min_messages: int = 50, k: int | None = 10) -> DataFrame:
    s = adjacent(_human_stream(messages, users), ["channel_id"], "created_at", "id",
                 ["created_at"], which="next")
    s = s.filter(F.col("next_created_at").isNotNull())
    kill = micros_between("created_at", "next_created_at") > silence_min * MIN_US
    per = s.groupBy(F.col("author_id").alias("uid")).agg(
        F.count(F.lit(1)).alias("total_msgs"), F.count(F.when(kill, 1)).alias("kills"))
    j = per.filter(F.col("total_msgs") >= min_messages).join(
        users.select(F.col("id").alias("uid"), "username"), "uid")
    j = j.withColumn("kill_rate", share(F.col("kills"), F.col("total_msgs")))
    return top_k(j, [DESC("kill_rate"), ASC("uid")], k).select(
        "username", "total_msgs", "kills", "kill_rate")


def conversation_revivers(messages: DataFrame, users: DataFrame, silence_min: int = 60,
                          k: int | None = 10) -> DataFrame:
    s = adjacent(_human_stream(messages, users), ["channel_id"], "created_at", "id",
                 ["created_at"], which="prev")
    s = s.filter(F.col("prev_created_at").isNotNull())
    rev = micros_between("prev_created_at", "created_at") > silence_min * MIN_US
    per = s.groupBy(F.col("author_id").alias("uid")).agg(F.count(F.when(rev, 1)).alias("revivals"))
    j = per.join(users.select(F.col("id").alias("uid"), "username"), "uid")
    return top_k(j, [DESC("revivals"), ASC("uid")], k).select("username", "revivals")


def conversation_catalysts(messages: DataFrame, users: DataFrame, silence_min: int = 30,
                           window_min: int = 30, min_followups: int = 5, min_responders: int = 2,
                           min_sparks: int = 5, k: int | None = 10) -> DataFrame:
    """Sparks (first human message of a channel, or one after more than
    ``silence_min`` of silence) and the human messages of the same channel
    strictly later and within ``window_min`` after them.

    Range join as an equi-join: time is cut into buckets of ``window_min``;
    the follow-ups of a spark in bucket b lie in bucket b or b+1, so each
    spark (few: they need a silence before them) is offered to those two
    buckets, each follow-up keeps its own bucket, and the exact time test
    runs after the join. Each (spark, follow-up) pair meets once. A spark
    needs ``silence_min`` of silence before it, so a channel bucket meets at
    most two sparks (when silence_min >= window_min) and the join emits at
    most two rows per message."""
    stream = _human_stream(messages, users)
    s = adjacent(stream, ["channel_id"], "created_at", "id", ["created_at"], which="prev")
    gap = micros_between("prev_created_at", "created_at")
    sparks = s.filter(F.col("prev_created_at").isNull() | (gap > silence_min * MIN_US)).select(
        F.col("id").alias("spark_id"), F.col("author_id").alias("spark_author"),
        F.col("channel_id").alias("s_channel"), F.col("created_at").alias("spark_time"))
    width = window_min * MIN_US
    us = F.unix_micros(F.col("spark_time").cast("timestamp"))
    sb = F.floor(us / width).cast("long")
    sparks = sparks.withColumn("bucket", F.explode(F.array(sb, sb + 1)))
    fu = stream.select(F.col("author_id").alias("f_author"),
                       F.col("channel_id").alias("f_channel"), F.col("created_at").alias("f_time"))
    fu = fu.withColumn("bucket", F.floor(
        F.unix_micros(F.col("f_time").cast("timestamp")) / width).cast("long"))
    j = sparks.join(fu, (F.col("s_channel") == F.col("f_channel"))
                    & (sparks["bucket"] == fu["bucket"]))
    d = micros_between("spark_time", "f_time")
    j = j.filter((F.col("f_time") > F.col("spark_time")) & (d <= width))
    res = j.groupBy("spark_id", "spark_author").agg(
        F.count(F.lit(1)).alias("follow_ups"), F.countDistinct("f_author").alias("responders"))
    ok = (F.col("follow_ups") >= min_followups) & (F.col("responders") >= min_responders)
    per = res.groupBy(F.col("spark_author").alias("uid")).agg(
        F.count(F.lit(1)).alias("spark_attempts"),
        F.count(F.when(ok, 1)).alias("successful_ignitions"),
        F.sum("follow_ups").alias("_f"))
    j2 = per.filter(F.col("spark_attempts") >= min_sparks).join(
        users.select(F.col("id").alias("uid"), "username"), "uid")
    j2 = j2.select("uid", "username", "spark_attempts", "successful_ignitions",
                   share(F.col("successful_ignitions"), F.col("spark_attempts")).alias("success_rate"),
                   round_ratio(F.col("_f"), F.col("spark_attempts"), 1).alias("avg_chain_length"))
    return top_k(j2, [DESC("successful_ignitions"), ASC("uid")], k).drop("uid")


def thread_depths(messages: DataFrame) -> DataFrame:
    """(id, depth, n): how many replies lie between a message and the one that
    starts its thread, on n ways (one, where ids do not repeat). Messages that
    lead to no start are left out, as in a recursive query from the starts.

    Links are doubled: after k rounds each message knows the one 2^k replies
    above, and all depths under 2^k are found, so a thread of a million replies
    takes twenty rounds, each a join of the messages that reach so far up. The
    rounds are written to the shared folder. A circle that a thread runs into
    has no depth and is an error."""
    spark = messages.sparkSession
    root = shared_scratch(spark, "threads")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    links = keep(messages.filter("reply_to_message_id IS NOT NULL").groupBy(
        "id", F.col("reply_to_message_id").alias("up")).agg(F.count(F.lit(1)).alias("n")), "links-0")
    starts = messages.filter("reply_to_message_id IS NULL").groupBy("id").agg(
        F.lit(0).cast("long").alias("depth"), F.count(F.lit(1)).alias("n"))
    found = [keep(starts, "depth-0")]
    # of the starts only those with replies are looked up again
    below = [keep(found[0].join(links.select(F.col("up").alias("id")), "id", "left_semi"), "answered")]
    n_links, step, k = links.count(), 1, 0
    while not links.isEmpty():
        known = below[0]
        for more in below[1:]:
            known = known.unionByName(more)
        known = known.select(F.col("id").alias("up"), "depth", F.col("n").alias("_n"))
        new = keep(links.join(known, "up").groupBy("id", (F.col("depth") + step).alias("depth")).agg(
            F.sum(F.col("n") * F.col("_n")).alias("n")), f"depth-{k + 1}")
        found.append(new)
        below.append(new)
        if step > n_links:          # a way longer than there are links runs in a circle
            if not new.isEmpty():
                raise ValueError("replies run in a circle below the start of a thread")
            break
        on = links.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("n").alias("_n"))
        links = keep(links.join(on, "up").groupBy("id", F.col("_up").alias("up")).agg(
            F.sum(F.col("n") * F.col("_n")).alias("n")), f"links-{k + 1}")
        step, k = 2 * step, k + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
