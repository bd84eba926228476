"""Raw records as a history dump holds them, and their readers.

Two record kinds, as the source API delivers them:

* **message records** (``RECORD_SCHEMA``): one per message, with author,
  mentions, a reaction *summary* (emoji and count) and attachment / embed
  lists;
* **reactor pages** (``REACTOR_PAGE_SCHEMA``): the users behind one emoji of
  one message, fetched by a separate paged call, at most about
  ``PAGE_SIZE`` users per page.

``nest_messages`` / ``nest_reactor_pages`` rebuild both from the flat tables
(to test that flatten(nest(x)) = x on the driver data). Every group they
collect is bounded: mentions and reaction kinds of one message are bounded
by the message itself, and reactors are cut into pages by a hash of the
user id, so a message with millions of reactions yields many small pages,
never one huge array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.columns import idiv

L, I, S, B = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
TS = T.TimestampNTZType()
PAGE_SIZE = 100

USER = T.StructType([T.StructField(n, t) for n, t in [
    ("id", L), ("name", S), ("discriminator", S), ("global_name", S), ("avatar", S), ("bot", B)]])
REACTOR = T.StructType(USER.fields + [T.StructField("reacted_at", TS), T.StructField("burst", B)])
EMOJI = T.StructType([T.StructField("id", L), T.StructField("name", S),
                      T.StructField("animated", B)])
REACTION = T.StructType([T.StructField("emoji", EMOJI), T.StructField("count", I)])
REFERENCE = T.StructType([T.StructField("message_id", L), T.StructField("channel_id", L)])

RECORD_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("id", L), ("guild_id", L), ("channel_id", L), ("author", USER), ("content", S),
    ("created_at", TS), ("edited_at", TS), ("tts", B), ("pinned", B), ("mention_everyone", B),
    ("type", I), ("reference", REFERENCE), ("mentions", T.ArrayType(USER)),
    ("reactions", T.ArrayType(REACTION)), ("attachments", T.ArrayType(S)),
    ("embeds", T.ArrayType(S))]])

REACTOR_PAGE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("message_id", L), ("guild_id", L), ("emoji", EMOJI), ("page", I),
    ("users", T.ArrayType(REACTOR))]])


REJECT = "_corrupt_record"


def with_rejects(reader):
    """A JSON reader that keeps lines that are no records in column REJECT."""
    schema = T.StructType([*RECORD_SCHEMA.fields, T.StructField(REJECT, T.StringType())])
    return reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECT)


def split_rejects(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records, and the lines that are none (also those without an id). Spark
    parses the whole line for both, so the input should be persisted."""
    bad = F.col(REJECT).isNotNull() | F.col("id").isNull()
    rejects = lines.filter(bad).select(F.coalesce(F.col(REJECT), F.to_json(F.struct(
        *[f.name for f in RECORD_SCHEMA.fields]))).alias("value"))
    return lines.filter(~bad).drop(REJECT), rejects


def read_records(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Read a dump folder of message records with the explicit schema. A JSON
    line that is no record fails the job (a dump is loaded whole or not at
    all); ``split_rejects`` of ``with_rejects(spark.read).json(path)`` sets
    such lines aside instead."""
    reader = spark.read.schema(RECORD_SCHEMA)
    if fmt == "json":
        return reader.option("mode", "FAILFAST").json(path)
    return reader.format(fmt).load(path)


def read_reactor_pages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Read a dump folder of reactor pages; a JSON line that is no page fails
    the job, as for records."""
    reader = spark.read.schema(REACTOR_PAGE_SCHEMA)
    return reader.option("mode", "FAILFAST").json(path) if fmt == "json" else reader.format(fmt).load(path)


def _user_struct(users: DataFrame, id_col: str, prefix: str) -> DataFrame:
    return users.select(
        F.col("id").alias(id_col),
        F.struct(F.col("id"), F.col("username").alias("name"), "discriminator", "global_name",
                 F.col("avatar_hash").alias("avatar"), F.col("is_bot").alias("bot"))
        .alias(prefix))


def _bare(id_col: str):
    return F.struct(F.col(id_col).alias("id"), *[F.lit(None).cast(f.dataType).alias(f.name)
                                                 for f in USER.fields[1:]])


def _emoji_struct(emojis: DataFrame) -> DataFrame:
    return emojis.select(F.col("id").alias("emoji_id"),
                         F.struct(F.col("discord_id").alias("id"), "name",
                                  F.col("is_animated").alias("animated")).alias("emoji"))


def nest_messages(messages: DataFrame, users: DataFrame, mentions: DataFrame,
                  reactions: DataFrame, emojis: DataFrame,
                  texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Message records from flat tables (children grouped by message id).
    ``messages`` may come without their text: ``texts`` then puts it on the
    finished rows, so that no text is shuffled by the message id."""
    mu = mentions.join(_user_struct(users, "mentioned_user_id", "u"), "mentioned_user_id", "left")
    ment = mu.groupBy("message_id").agg(F.sort_array(F.collect_list(
        F.coalesce(F.col("u"), _bare("mentioned_user_id")))).alias("mentions"))
    per_emoji = reactions.groupBy("message_id", "emoji_id").agg(
        F.count(F.lit(1)).cast("int").alias("count")).join(_emoji_struct(emojis), "emoji_id", "left")
    reacts = per_emoji.groupBy("message_id").agg(
        F.sort_array(F.collect_list(F.struct("emoji", "count"))).alias("reactions"))
    # what belongs to a message is put together on its ids alone; then the
    # texts are shuffled once, and pass by a hash table without being sorted
    own = messages.select("id", "author_id").distinct() \
        .join(_user_struct(users, "author_id", "author"), "author_id", "left") \
        .join(ment.withColumnRenamed("message_id", "id"), "id", "left") \
        .join(reacts.withColumnRenamed("message_id", "id"), "id", "left") \
        .select(F.col("id").alias("_id"), F.col("author_id").alias("_author"), "author", "mentions", "reactions")
    m = messages.join(own if texts else own.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id"))
                      & F.col("author_id").eqNullSafe(F.col("_author")), "left")
    m = texts(m) if texts else m
    ref = F.when(F.col("reply_to_message_id").isNotNull(),
                 F.struct(F.col("reply_to_message_id").alias("message_id"),
                          F.col("channel_id").alias("channel_id")))
    author = F.when(F.col("author_id").isNull(), F.lit(None)).otherwise(
        F.coalesce(F.col("author"), _bare("author_id")))
    return m.select(
        "id", F.col("server_id").alias("guild_id"), "channel_id", author.alias("author"),
        "content", "created_at", "edited_at", F.col("is_tts").alias("tts"),
        F.col("is_pinned").alias("pinned"), F.col("mentions_everyone").alias("mention_everyone"),
        F.col("message_type").alias("type"), ref.alias("reference"),
        F.coalesce("mentions", F.array().cast(T.ArrayType(USER))).alias("mentions"),
        F.coalesce("reactions", F.array().cast(T.ArrayType(REACTION))).alias("reactions"),
        F.array_repeat(F.lit("attachment"), F.coalesce("attachment_count", F.lit(0))).alias("attachments"),
        F.array_repeat(F.lit("embed"), F.coalesce("embed_count", F.lit(0))).alias("embeds"))


def nest_reactor_pages(messages: DataFrame, users: DataFrame, reactions: DataFrame,
                       emojis: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Reactor pages from flat tables. The page of a reactor is a hash of
    its user id modulo the page count of its (message, emoji), so pages hold
    about ``page_size`` users each and no group grows with a hot message."""
    counts = reactions.groupBy("message_id", "emoji_id").agg(F.count(F.lit(1)).alias("_n"))
    r = reactions.join(counts, ["message_id", "emoji_id"])
    pages = idiv(F.col("_n") + (page_size - 1), page_size)
    r = r.withColumn("page", F.pmod(F.xxhash64("user_id"), pages).cast("int"))
    r = r.join(_user_struct(users, "user_id", "u"), "user_id", "left")
    reactor = F.struct(*[F.coalesce(F.col("u")[f.name], _bare("user_id")[f.name]).alias(f.name)
                         for f in USER.fields],
                       F.col("reacted_at"), F.col("is_super_reaction").alias("burst"))
    g = r.groupBy("message_id", "emoji_id", "page").agg(F.sort_array(F.collect_list(reactor))
                                                        .alias("users"))
    g = g.join(_emoji_struct(emojis), "emoji_id", "left").join(
        messages.select(F.col("id").alias("message_id"), F.col("server_id").alias("guild_id")),
        "message_id", "left")
    return g.select("message_id", "guild_id", "emoji", "page", "users")
