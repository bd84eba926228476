"""Content measures. Text work uses built-in string functions
over whole texts (no Python UDF, no prefixes except the previews that are
part of a report)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.columns import count_occurrences, round_ratio
from chatlens.operators.common import humans, in_window, narrow, share, top_k, with_content

DESC, ASC = F.desc_nulls_last, F.asc_nulls_first


def _newest() -> list:
    return [DESC("created_at"), DESC("id")]


def _nonempty(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("content").isNotNull() & (F.col("content") != ""))


def _names(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("author_id"), "username")


def message_length_stats(messages: DataFrame) -> DataFrame:
    a = _nonempty(messages).agg(
        F.sum("word_count").alias("_w"), F.count("word_count").alias("_nw"),
        F.sum("char_count").alias("_c"), F.count("char_count").alias("_nc"),
        F.min("word_count").alias("min_words"), F.max("word_count").alias("max_words"),
        F.min("char_count").alias("min_chars"), F.max("char_count").alias("max_chars"))
    return a.select(round_ratio(F.col("_w"), F.col("_nw"), 4).alias("avg_words"),
                    round_ratio(F.col("_c"), F.col("_nc"), 4).alias("avg_chars"),
                    "min_words", "max_words", "min_chars", "max_chars")


def _count_stats(messages: DataFrame, col: str, prefix: str) -> DataFrame:
    a = messages.filter(F.col(col) > 0).agg(
        F.count(F.lit(1)).alias(f"total_with_{prefix}"), F.sum(col).cast("long").alias(f"total_{prefix}"))
    return a.select(f"total_with_{prefix}", f"total_{prefix}",
                    round_ratio(F.col(f"total_{prefix}"), F.col(f"total_with_{prefix}"), 4)
                    .alias(f"avg_{prefix}_per_message"))


def attachment_stats(messages: DataFrame) -> DataFrame:
    return _count_stats(messages, "attachment_count", "attachments")


def embed_stats(messages: DataFrame) -> DataFrame:
    return _count_stats(messages, "embed_count", "embeds")


def longest_messages(messages: DataFrame, users: DataFrame, channels: DataFrame,
                     k: int | None = 10, preview: int = 50) -> DataFrame:
    # only messages whose author and channel exist (the reference joins
    # first), then the top k, then the names for those k rows
    m = narrow(messages).filter(F.col("word_count").isNotNull()) \
        .join(users.select(F.col("id").alias("author_id")), "author_id", "left_semi") \
        .join(channels.select(F.col("id").alias("channel_id")), "channel_id", "left_semi")
    top = top_k(m, [DESC("word_count"), ASC("id")], k)
    j = top.join(_names(users), "author_id").join(
        channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel")), "channel_id")
    return with_content(j, messages, [DESC("word_count"), ASC("id")]).select(
        "username", "channel", "word_count", "char_count",
        F.substring("content", 1, preview).alias("content_preview"))


def longest_messages_chars(messages: DataFrame, users: DataFrame, k: int | None = 20,
                           preview: int = 100) -> DataFrame:
    m = narrow(messages.filter(F.col("content").isNotNull()).withColumn("content_length", F.length("content")))
    order = [DESC("content_length"), ASC("id")]
    top = top_k(m.join(_names(users), "author_id"), order, k)
    return with_content(top, messages, order).select(
        "username", "content_length", F.substring("content", 1, preview).alias("preview"),
        "created_at")


def empty_messages(messages: DataFrame) -> DataFrame:
    e = messages.filter(F.col("content").isNull() | (F.col("content") == ""))
    return e.agg(F.count(F.lit(1)).alias("empty_content_count"),
                 F.count(F.when(F.col("attachment_count") > 0, 1)).alias("with_attachments"),
                 F.count(F.when(F.col("embed_count") > 0, 1)).alias("with_embeds"))


def content_metrics(messages: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    w = messages.filter(in_window("created_at", as_of, days))
    a = w.agg(F.coalesce(F.sum("word_count"), F.lit(0)).cast("long").alias("total_words"),
              F.coalesce(F.sum("char_count"), F.lit(0)).cast("long").alias("total_characters"),
              F.count("word_count").alias("_n"),
              F.count(F.when(F.col("attachment_count") > 0, 1)).alias("messages_with_attachments"),
              F.count(F.when(F.col("embed_count") > 0, 1)).alias("messages_with_embeds"),
              F.count(F.when(F.col("mention_count") > 0, 1)).alias("messages_with_mentions"),
              F.count(F.when(F.col("is_pinned"), 1)).alias("pinned_messages"))
    return a.select("total_words", "total_characters",
                    F.coalesce(round_ratio(F.col("total_words"), F.col("_n"), 1), F.lit(0.0))
                    .alias("avg_words_per_message"),
                    "messages_with_attachments", "messages_with_embeds",
                    "messages_with_mentions", "pinned_messages")


def messages_with_attachments(messages: DataFrame, users: DataFrame, k: int | None = 20) -> DataFrame:
    m = narrow(messages).filter(F.col("attachment_count") > 0).join(_names(users), "author_id")
    return with_content(top_k(m, _newest(), k), messages, _newest()).select(
        "username", "content", "attachment_count", "created_at")


def search_messages(messages: DataFrame, users: DataFrame, channels: DataFrame, needle: str,
                    k: int | None = 20) -> DataFrame:
    """Case-insensitive substring search (ILIKE '%needle%'), newest first."""
    m = narrow(messages.filter(F.lower("content").contains(needle.lower())))
    j = m.join(_names(users), "author_id").join(
        channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel")), "channel_id")
    return with_content(top_k(j, _newest(), k), messages, _newest()).select(
        "username", "content", "channel", "created_at")


def pinned_messages(messages: DataFrame, users: DataFrame, channels: DataFrame) -> DataFrame:
    m = narrow(messages).filter(F.col("is_pinned"))
    j = m.join(_names(users), "author_id").join(
        channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel")), "channel_id")
    return with_content(j, messages, _newest()).select(
        "username", "channel", "content", "created_at")


def recent_messages(messages: DataFrame, users: DataFrame, k: int | None = 20) -> DataFrame:
    j = narrow(messages).join(_names(users), "author_id")
    return with_content(top_k(j, _newest(), k), messages, _newest()).select(
        "id", "username", "content", "created_at")


def first_and_last_message(messages: DataFrame, users: DataFrame, channels: DataFrame,
                           preview: int = 100) -> DataFrame:
    """Earliest and latest message with a known author and channel: one
    aggregate with min_by / max_by (no sort of all messages)."""
    key = F.struct("created_at", "id")
    scope = [c for c in ("tenant_id",) if c in messages.columns]
    val = F.struct(*scope, "id", "author_id", "channel_id", "created_at")
    known = narrow(messages).join(users.select(F.col("id").alias("author_id")), "author_id", "left_semi") \
        .join(channels.select(F.col("id").alias("channel_id")), "channel_id", "left_semi")
    a = known.agg(F.min_by(val, key).alias("first"), F.max_by(val, key).alias("last"))
    rows = a.select(F.explode(F.array(
        F.struct(F.lit("first").alias("which"), F.col("first").alias("m")),
        F.struct(F.lit("last").alias("which"), F.col("last").alias("m")))).alias("r"))
    r = rows.select("r.which", "r.m.*")
    r = r.join(messages.select(*scope, "id", "content"), [*scope, "id"], "left")
    r = r.join(_names(users), "author_id", "left").join(
        channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel")),
        "channel_id", "left")
    c = F.col("content")
    prev = F.when(F.length(c) > preview, F.concat(F.substring(c, 1, preview), F.lit("...")))\
        .otherwise(c)
    return r.select("which", "username", "channel", "created_at", prev.alias("preview"))


def essay_writers(messages: DataFrame, users: DataFrame, min_messages: int = 20,
                  k: int | None = 10) -> DataFrame:
    per = _nonempty(messages).groupBy("author_id").agg(
        F.sum("char_count").alias("_c"), F.count(F.lit(1)).alias("total_msgs"),
        F.max("char_count").alias("max_length"))
    j = per.filter(F.col("total_msgs") >= min_messages).join(_names(users), "author_id")
    j = j.withColumn("avg_length", round_ratio(F.col("_c"), F.col("total_msgs"), 1))
    return top_k(j, [DESC("avg_length"), ASC("author_id")], k).select(
        "username", "avg_length", "max_length", "total_msgs")


def _length_by_human(messages, users, min_messages):
    per = _nonempty(messages).groupBy("author_id").agg(
        F.sum("char_count").alias("_c"), F.count(F.lit(1)).alias("_n"),
        F.max("char_count").alias("max_length"))
    j = per.filter(F.col("_n") >= min_messages).join(
        humans(users).select(F.col("id").alias("author_id"), "username"), "author_id")
    return j.withColumn("avg_length", round_ratio(F.col("_c"), F.col("_n"), 1))


def rambler(messages: DataFrame, users: DataFrame, min_messages: int = 50,
            k: int | None = 5) -> DataFrame:
    j = _length_by_human(messages, users, min_messages)
    return top_k(j, [DESC("avg_length"), ASC("author_id")], k).select(
        "username", "avg_length", "max_length")


def succinct(messages: DataFrame, users: DataFrame, min_messages: int = 50,
             k: int | None = 5) -> DataFrame:
    j = _length_by_human(messages, users, min_messages)
    return top_k(j, [ASC("avg_length"), ASC("author_id")], k).select("username", "avg_length")


def exclamations(messages: DataFrame, users: DataFrame, min_messages: int = 20,
                 k: int | None = 10) -> DataFrame:
    per = _nonempty(messages).groupBy("author_id").agg(
        F.sum(count_occurrences(F.col("content"), "!")).alias("exclamations"),
        F.count(F.lit(1)).alias("msgs"))
    j = per.filter(F.col("msgs") >= min_messages).join(_names(users), "author_id")
    j = j.withColumn("excl_per_msg", round_ratio(F.col("exclamations"), F.col("msgs"), 2))
    return top_k(j, [DESC("excl_per_msg"), ASC("author_id")], k).select(
        "username", "exclamations", "msgs", "excl_per_msg")


def question_askers(messages: DataFrame, users: DataFrame, min_messages: int = 20,
                    k: int | None = 10) -> DataFrame:
    """Messages ending in '?'; NULL content counts in the total."""
    per = messages.groupBy("author_id").agg(
        F.count(F.when(F.col("content").endswith("?"), 1)).alias("questions"),
        F.count(F.lit(1)).alias("total"))
    j = per.filter(F.col("total") >= min_messages).join(_names(users), "author_id")
    j = j.withColumn("question_pct", share(F.col("questions"), F.col("total")))
    return top_k(j, [DESC("questions"), ASC("author_id")], k).select(
        "username", "questions", "total", "question_pct")


# The laugh words counted by the report (lower-cased text).
LAUGH_WORDS = ["lol", "lmao", "haha", "hehe"]
# The link prefixes counted by the report (case-sensitive).
LINK_PREFIXES = ["http://", "https://"]


def laugh_count(messages: DataFrame, users: DataFrame, k: int | None = 5) -> DataFrame:
    # lower-case each text once (a projection Catalyst keeps, since the
    # lowered text feeds several counts), then count each word in it
    low = messages.filter(F.col("content").isNotNull()).select(
        "author_id", F.lower("content").alias("_lc"))
    n = sum((count_occurrences(F.col("_lc"), w) for w in LAUGH_WORDS), F.lit(0))
    per = low.groupBy("author_id").agg(F.sum(n).alias("laugh_count"))
    j = per.join(humans(users).select(F.col("id").alias("author_id"), "username"), "author_id")
    return top_k(j, [DESC("laugh_count"), ASC("author_id")], k).select("username", "laugh_count")


def link_count(messages: DataFrame, users: DataFrame, k: int | None = 5) -> DataFrame:
    c = F.col("content")
    n = sum((count_occurrences(c, p) for p in LINK_PREFIXES), F.lit(0))
    per = messages.filter(c.isNotNull()).groupBy("author_id").agg(F.sum(n).alias("link_count"))
    j = per.join(humans(users).select(F.col("id").alias("author_id"), "username"), "author_id")
    return top_k(j, [DESC("link_count"), ASC("author_id")], k).select("username", "link_count")
