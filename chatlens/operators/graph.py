"""Relationship graph.

Edges are rows: reply edges come from one self-join on message id, mention
edges from message_mentions joined to their message. Pair counts are
aggregated by id pairs (partial aggregation absorbs hot pairs) before the
users dimension is joined for names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.columns import round_ratio
from chatlens.operators.common import (humans, in_window, pair_key, rank_desc, reply_edges, share,
                                       top_k, total_of)

DESC, ASC = F.desc_nulls_last, F.asc_nulls_first


def _names(users: DataFrame, id_col: str, name_col: str) -> DataFrame:
    return users.select(F.col("id").alias(id_col), F.col("username").alias(name_col))


def _hid(users: DataFrame, id_col: str) -> DataFrame:
    return humans(users).select(F.col("id").alias(id_col))


def _directed(e: DataFrame) -> DataFrame:
    """Replies counted per (replier x, replied-to y)."""
    return e.groupBy(F.col("replier_id").alias("x"), F.col("original_author_id").alias("y")) \
        .agg(F.count(F.lit(1)).alias("n"))


def _human_pairs(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Reply counts between two different humans. Edges are counted per pair
    before bots leave, so a busy user is a row per partner in the joins."""
    d = _directed(edges.filter(F.col("replier_id") != F.col("original_author_id")))
    return d.join(_hid(users, "x"), "x").join(_hid(users, "y"), "y")


def interaction_summary(user_interactions: DataFrame, users: DataFrame, server_id: int,
                        days: int = 7, as_of=None, k: int | None = 20) -> DataFrame:
    """Top pairs by total interactions with a type → count map. Sums per
    (pair names, type) first, so two users sharing a name cannot produce a
    duplicated map key."""
    ui = user_interactions.filter((F.col("server_id") == server_id)
                                  & in_window("last_interaction", as_of, days, strict=True))
    j = ui.join(_names(users, "from_user_id", "from_user"), "from_user_id") \
          .join(_names(users, "to_user_id", "to_user"), "to_user_id")
    per_type = j.groupBy("from_user", "to_user", "interaction_type").agg(
        F.sum("interaction_count").alias("n"))
    g = per_type.groupBy("from_user", "to_user").agg(
        F.sum("n").cast("long").alias("total_interactions"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.col("interaction_type"), F.col("n").cast("long"))))).alias("breakdown"))
    return top_k(g, [DESC("total_interactions"), ASC("from_user"), ASC("to_user")], k)


def interaction_pairs(messages: DataFrame, mentions: DataFrame, users: DataFrame, as_of=None,
                      days: int = 30, k: int | None = 20) -> DataFrame:
    """Mentions and replies per directed pair side by side (full outer join);
    unknown users show as their id. Replies use ``reply_to_author_id``."""
    win = messages.filter(in_window("created_at", as_of, days))
    men = mentions.join(win.select(F.col("id").alias("message_id"), "author_id"), "message_id") \
        .filter(F.col("author_id") != F.col("mentioned_user_id")) \
        .groupBy(F.col("author_id").alias("f"), F.col("mentioned_user_id").alias("t")) \
        .agg(F.count(F.lit(1)).alias("mention_count"))
    rep = win.filter(F.col("reply_to_author_id").isNotNull()
                     & (F.col("author_id") != F.col("reply_to_author_id"))) \
        .groupBy(F.col("author_id").alias("f"), F.col("reply_to_author_id").alias("t")) \
        .agg(F.count(F.lit(1)).alias("reply_count"))
    j = men.join(rep, ["f", "t"], "full_outer").select(
        "f", "t", F.coalesce("mention_count", F.lit(0)).alias("mention_count"),
        F.coalesce("reply_count", F.lit(0)).alias("reply_count"))
    j = j.join(_names(users, "f", "fu"), "f", "left").join(_names(users, "t", "tu"), "t", "left")
    j = j.select("f", "t", F.coalesce("fu", F.col("f").cast("string")).alias("from_user"),
                 F.coalesce("tu", F.col("t").cast("string")).alias("to_user"),
                 "mention_count", "reply_count",
                 (F.col("mention_count") + F.col("reply_count")).alias("_s"))
    return top_k(j, [DESC("_s"), ASC("f"), ASC("t")], k).select(
        "from_user", "to_user", "mention_count", "reply_count")


def best_friends(messages: DataFrame, users: DataFrame, k: int | None = 10) -> DataFrame:
    """Unordered pairs by replies in both directions (bots kept)."""
    e = reply_edges(messages).filter(F.col("replier_id") != F.col("original_author_id"))
    a, b = pair_key("replier_id", "original_author_id")
    g = e.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("exchanges"))
    j = g.join(_names(users, "a", "user_1"), "a").join(_names(users, "b", "user_2"), "b")
    return top_k(j, [DESC("exchanges"), ASC("a"), ASC("b")], k).select(
        "user_1", "user_2", "exchanges")


def best_friends_balance(messages: DataFrame, users: DataFrame, min_total: int = 20,
                         k: int | None = 10) -> DataFrame:
    d = _human_pairs(reply_edges(messages), users)
    a, b = pair_key("x", "y")

    def sent_by(who):
        return F.sum(F.when(F.col("x") == who, F.col("n")).otherwise(F.lit(0)))

    g = d.groupBy(a.alias("a"), b.alias("b")).agg(
        sent_by(a).alias("a_to_b"), sent_by(b).alias("b_to_a"), F.sum("n").alias("total"))
    g = g.filter(F.col("total") >= min_total).withColumn(
        "imbalance", F.abs(F.col("a_to_b") - F.col("b_to_a")))
    j = g.join(_names(users, "a", "user_1"), "a").join(_names(users, "b", "user_2"), "b")
    return top_k(j, [DESC("total"), ASC("imbalance"), ASC("a"), ASC("b")], k).select(
        "user_1", "user_2", "a_to_b", "b_to_a", "total", "imbalance")


def _with_reverse(d: DataFrame) -> DataFrame:
    rev = d.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("n").alias("back"))
    return d.join(rev, ["x", "y"], "left").withColumn("back", F.coalesce("back", F.lit(0)))


def reciprocity(messages: DataFrame, users: DataFrame, min_replies: int = 10,
                k: int | None = 10) -> DataFrame:
    d = _with_reverse(_human_pairs(reply_edges(messages), users))
    d = d.filter(F.col("n") >= min_replies).withColumn(
        "imbalance", F.abs(F.col("n") - F.col("back")))
    j = d.join(_names(users, "x", "user_a"), "x").join(_names(users, "y", "user_b"), "y")
    return top_k(j, [DESC("imbalance"), ASC("x"), ASC("y")], k).select(
        "user_a", "user_b", F.col("n").alias("a_to_b"), F.col("back").alias("b_to_a"), "imbalance")


def fan_relationships(messages: DataFrame, users: DataFrame, min_replies: int = 5,
                      k: int | None = 10) -> DataFrame:
    e = reply_edges(messages).filter(F.col("replier_id") != F.col("original_author_id"))
    d = _with_reverse(_directed(e)).filter(F.col("n") >= min_replies)
    d = d.withColumn("imbalance", F.col("n") - F.col("back"))
    j = d.join(_names(users, "x", "fan"), "x").join(_names(users, "y", "idol"), "y")
    return top_k(j, [DESC("imbalance"), ASC("x"), ASC("y")], k).select(
        "fan", "idol", F.col("n").alias("fan_to_idol"), F.col("back").alias("idol_to_fan"),
        "imbalance")


def _reach(messages: DataFrame, mentions: DataFrame, users: DataFrame) -> DataFrame:
    """Distinct people each human reached by a reply or a mention."""
    r = reply_edges(messages).select(F.col("replier_id").alias("uid"),
                                     F.col("original_author_id").alias("other"))
    m = mentions.join(messages.select(F.col("id").alias("message_id"),
                                      F.col("author_id").alias("uid")), "message_id") \
        .select("uid", F.col("mentioned_user_id").alias("other"))
    # pairs are made distinct before bots leave: a busy user is a row per partner
    edges = r.unionByName(m).filter(F.col("uid") != F.col("other")).distinct() \
        .join(_hid(users, "uid"), "uid").join(_hid(users, "other"), "other")
    return edges.groupBy("uid").agg(F.count(F.lit(1)).alias("unique_interactions"))


def social_butterfly(messages: DataFrame, mentions: DataFrame, users: DataFrame,
                     k: int | None = 15) -> DataFrame:
    total = total_of(humans(users), F.count(F.lit(1)))
    j = _reach(messages, mentions, users).join(_names(users, "uid", "username"), "uid") \
        .withColumn("total_humans", total)
    j = j.withColumn("pct", share(F.col("unique_interactions"), F.col("total_humans")))
    return top_k(j, [DESC("unique_interactions"), ASC("uid")], k).select(
        "username", "unique_interactions", "total_humans", "pct")


def selective_socializers(messages: DataFrame, mentions: DataFrame, users: DataFrame, k: int = 5,
                          within_top: int | None = None) -> DataFrame:
    j = _reach(messages, mentions, users).join(_names(users, "uid", "username"), "uid")
    if within_top is not None:
        j = j.orderBy(DESC("unique_interactions"), ASC("uid")).limit(within_top)
    return top_k(j, [ASC("unique_interactions"), ASC("uid")], k).select(
        "username", "unique_interactions")


def _magnetism(messages, mentions, users, min_sent):
    sent = messages.groupBy(F.col("author_id").alias("uid")).agg(F.count(F.lit(1)).alias("sent")) \
        .join(_hid(users, "uid"), "uid").filter(F.col("sent") >= min_sent)
    rr = reply_edges(messages).groupBy(F.col("original_author_id").alias("uid")).agg(
        F.count(F.lit(1)).alias("replies_received"))
    mr = mentions.groupBy(F.col("mentioned_user_id").alias("uid")).agg(
        F.count(F.lit(1)).alias("mentions_received"))
    j = sent.join(rr, "uid", "left").join(mr, "uid", "left").join(
        _names(users, "uid", "username"), "uid")
    j = j.select("uid", "username", "sent",
                 F.coalesce("replies_received", F.lit(0)).alias("replies_received"),
                 F.coalesce("mentions_received", F.lit(0)).alias("mentions_received"))
    j = j.withColumn("total_engagement", F.col("replies_received") + F.col("mentions_received"))
    return j.withColumn("engagement_ratio",
                        round_ratio(F.col("total_engagement"), F.col("sent"), 2))


def engagement_magnetism(messages: DataFrame, mentions: DataFrame, users: DataFrame,
                         min_sent: int = 50, k: int | None = 15) -> DataFrame:
    j = _magnetism(messages, mentions, users, min_sent)
    return top_k(j, [DESC("engagement_ratio"), ASC("uid")], k).drop("uid")


def low_engagement(messages: DataFrame, mentions: DataFrame, users: DataFrame, min_sent: int = 50,
                   k: int = 5, within_top: int | None = None) -> DataFrame:
    j = _magnetism(messages, mentions, users, min_sent)
    if within_top is not None:
        j = j.orderBy(DESC("engagement_ratio"), ASC("uid")).limit(within_top)
    return top_k(j, [ASC("engagement_ratio"), ASC("uid")], k).select("username", "engagement_ratio")


def late_night_crew(messages: DataFrame, users: DataFrame, first_hour: int = 0,
                    last_hour: int = 5, k: int | None = 5) -> DataFrame:
    late = reply_edges(messages).filter(F.hour("reply_at").between(first_hour, last_hour))
    a, b = pair_key("x", "y")
    g = _human_pairs(late, users).groupBy(a.alias("a"), b.alias("b")).agg(F.sum("n").alias("exchanges"))
    j = g.join(_names(users, "a", "user_1"), "a").join(_names(users, "b", "user_2"), "b")
    return top_k(j, [DESC("exchanges"), ASC("a"), ASC("b")], k).select("user_1", "user_2", "exchanges")


def wrapped_users(messages: DataFrame, users: DataFrame, min_messages: int = 100,
                  k: int | None = 10) -> DataFrame:
    cnt = messages.groupBy(F.col("author_id").alias("id")).agg(F.count(F.lit(1)).alias("msg_count"))
    j = cnt.filter(F.col("msg_count") >= min_messages).join(
        humans(users).select("id", "username"), "id")
    return top_k(j, [DESC("msg_count"), ASC("id")], k).select("id", "username", "msg_count")


def personal_wrapped(messages: DataFrame, users: DataFrame, channels: DataFrame,
                     mentions: DataFrame, min_messages: int = 100) -> DataFrame:
    """The per-user yearly card for every human with at least
    ``min_messages`` messages, all users in one job (the reference runs one
    query per user). Each figure is a per-user aggregate; picks (favourite
    channel, best friend, busiest day) are ``max_by`` with a deterministic
    tie-break; the rank counts humans with more messages via a histogram."""
    hid = _hid(users, "uid")
    # One tally of the messages per user, channel and day; the three groupings
    # (per user, per user and channel, per user and day, told apart by
    # grouping_id) expand its narrow rows, never a text.
    tally = messages.groupBy(F.col("author_id").alias("uid"), "channel_id",
                             F.to_date("created_at").alias("d")).agg(
        F.count(F.lit(1)).alias("cnt"), F.max(F.length("content")).alias("longest_msg"),
        F.count(F.when(F.col("content").endswith("?"), 1)).alias("questions_asked"),
        F.count(F.when(F.hour("created_at").between(0, 5), 1)).alias("late_night"))
    sets = tally.groupingSets([["uid"], ["uid", "channel_id"], ["uid", "d"]], "uid", "channel_id", "d") \
        .agg(F.grouping_id().alias("_g"), F.sum("cnt").alias("cnt"), F.max("longest_msg").alias("longest_msg"),
             F.sum("questions_asked").alias("questions_asked"), F.sum("late_night").alias("late_night"))
    # grouping_id bits (channel_id, d): 3 = neither, 1 = channel, 2 = day
    base = sets.filter(F.col("_g") == 3).select(
        "uid", F.col("cnt").alias("total_msgs"), "longest_msg", "questions_asked", "late_night")
    hbase = base.join(hid, "uid")
    ranked = rank_desc(hbase.select("uid", F.col("total_msgs").alias("msgs")), "msgs") \
        .select("uid", "rank")
    total_users = total_of(hbase, F.count(F.lit(1)))
    ch = sets.filter(F.col("_g") == 1).select("uid", "channel_id", "cnt").join(
        channels.select(F.col("id").alias("channel_id"), F.col("name").alias("fav_channel")),
        "channel_id")
    fav = ch.groupBy("uid").agg(F.max_by(F.struct("fav_channel", "cnt"),
                                         F.struct(F.col("cnt"), -F.col("channel_id"))).alias("f"))
    e = reply_edges(messages).filter(F.col("replier_id") != F.col("original_author_id"))
    pair = e.groupBy(F.col("replier_id").alias("uid"), F.col("original_author_id").alias("o")) \
        .agg(F.count(F.lit(1)).alias("x"))
    # one aggregation for both: distinct partners (any), best human partner
    # (max_by skips rows whose ordering is NULL, i.e. bots and unknown ids)
    human_o = humans(users).select(F.col("id").alias("o"), F.lit(True).alias("_h"))
    bf = pair.join(human_o, "o", "left").groupBy("uid").agg(
        F.count(F.lit(1)).alias("unique_convos"),
        F.max_by(F.struct("o", "x"), F.when(F.col("_h"), F.struct(F.col("x"), -F.col("o"))))
        .alias("b"))
    bf = bf.join(_names(users, "bo", "best_friend"), F.col("b.o") == F.col("bo"), "left") \
        .select("uid", "best_friend", F.col("b.x").alias("bf_exchanges"), "unique_convos")
    men = mentions.join(messages.select(F.col("id").alias("message_id"),
                                        F.col("author_id").alias("by")), "message_id") \
        .groupBy(F.col("mentioned_user_id").alias("uid")).agg(
            F.count(F.lit(1)).alias("times_mentioned"), F.countDistinct("by").alias("by_people"))
    days = sets.filter(F.col("_g") == 2).select("uid", "d", F.col("cnt").alias("c"))
    busy = days.groupBy("uid").agg(F.max_by(F.struct("d", "c"),
                                            F.struct(F.col("c"), -F.unix_date("d"))).alias("bd"))
    out = hbase.filter(F.col("total_msgs") >= min_messages) \
        .join(_names(users, "uid", "username"), "uid") \
        .join(ranked, "uid", "left").join(fav, "uid", "left").join(bf, "uid", "left") \
        .join(men, "uid", "left").join(busy, "uid", "left")
    tu = F.lit(total_users)
    return out.select(
        F.col("uid").alias("user_id"), "username", "total_msgs", "longest_msg", "questions_asked",
        "late_night", F.col("rank").cast("long").alias("rank"), tu.alias("total_users"),
        round_ratio(tu - F.col("rank"), tu, 0, 100).alias("percentile"),
        F.col("f.fav_channel").alias("fav_channel"),
        share(F.col("f.cnt"), F.col("total_msgs")).alias("fav_channel_pct"),
        "best_friend", "bf_exchanges",
        F.coalesce("times_mentioned", F.lit(0)).alias("times_mentioned"),
        F.coalesce("by_people", F.lit(0)).alias("by_people"),
        F.col("bd.d").alias("busiest_date"), F.col("bd.c").alias("busiest_count"),
        F.coalesce("unique_convos", F.lit(0)).alias("unique_convos"))
