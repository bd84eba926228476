"""Exact distinct users of any window from mergeable bitmaps.

Each user of a tenant gets a dense number once. The roll-up has a row for each
(day, channel, server, bucket of numbers, word of 64 numbers within the bucket)
with the bitmap of the authors seen, one long; bitmaps of any days, channels or months are joined by bitwise or, and
the bits counted, so a window reads no message. A channel and day with few
authors thus holds few short rows, never more than it has authors (and one for
authorless messages).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.columns import idiv, round_ratio
from chatlens.operators.common import share, total_of

SPREAD = 1024           # groups of ids that are numbered on their own
BITS = 64               # numbers of a word: the bits of a long
L, S, D = T.LongType(), T.StringType(), T.DateType()
USER_NUMBERS = T.StructType([T.StructField(n, t) for n, t in (("tenant_id", S), ("user_id", L), ("number", L))])
AUTHOR_MAPS = T.StructType([T.StructField(n, t) for n, t in (
    ("tenant_id", S), ("day", D), ("server_id", L), ("channel_id", L), ("bucket", L), ("word", L),
    ("authors", L), ("messages", L), ("chars", L), ("with_chars", L))])


def number_users(known: DataFrame, messages: DataFrame) -> DataFrame:
    """Numbers for authors that have none yet; known ones never change. New ids
    are numbered within groups by their hash, which are shifted by the sizes of
    the groups before, so no task sees all users of a tenant."""
    new = (messages.select("tenant_id", F.col("author_id").alias("user_id")).filter("user_id IS NOT NULL").distinct()
           .join(known.select("tenant_id", "user_id"), ["tenant_id", "user_id"], "left_anti")
           .withColumn("_g", F.pmod(F.xxhash64("user_id"), F.lit(SPREAD))))
    before = Window.partitionBy("tenant_id").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    shift = (new.groupBy("tenant_id", "_g").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    base = known.groupBy("tenant_id").agg((F.max("number") + 1).alias("_base"))
    row = F.row_number().over(Window.partitionBy("tenant_id", "_g").orderBy("user_id"))
    return (new.withColumn("_row", row).join(shift, ["tenant_id", "_g"]).join(base, "tenant_id", "left")
            .select("tenant_id", "user_id",
                    (F.coalesce("_base", F.lit(0)) + F.col("_shift") + F.col("_row") - 1).cast("long").alias("number")))


def author_maps(messages: DataFrame, numbers: DataFrame) -> DataFrame:
    """The roll-up's rows of some messages (one batch, or all). Messages are
    counted per author first; authorless ones count without a bit."""
    per = messages.groupBy("tenant_id", F.to_date("created_at").alias("day"), "server_id", "channel_id",
                           F.col("author_id").alias("user_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("char_count").alias("c"), F.count("char_count").alias("k"))
    j = per.join(numbers, ["tenant_id", "user_id"], "left")
    no_bit = F.col("number").isNull()
    at = F.bitmap_bit_position("number") % BITS                     # null for an authorless row
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
    return (j.withColumn("bucket", F.when(no_bit, F.lit(-1).cast("long")).otherwise(F.bitmap_bucket_number("number")))
            .withColumn("word", F.coalesce(idiv(F.bitmap_bit_position("number"), BITS), F.lit(0).cast("long")))
            .groupBy("tenant_id", "day", "server_id", "channel_id", "bucket", "word").agg(
                F.bit_or(bit).alias("authors"), F.sum("n").alias("messages"), F.sum("c").alias("chars"),
                F.sum("k").alias("with_chars")).select(*AUTHOR_MAPS.names))


def distinct_authors(maps: DataFrame, *by: str | Column) -> DataFrame:
    """Messages and distinct authors of the given rows, in all or for each
    value of ``by``: bitmaps of a word are merged, then words added up."""
    keys = [F.col(c) if isinstance(c, str) else c for c in by]
    merged = maps.groupBy(*keys, "bucket", "word").agg(
        F.bit_count(F.bit_or("authors")).alias("_d"), F.sum("messages").alias("_m"),
        F.sum("chars").alias("_c"), F.sum("with_chars").alias("_k"))
    names = [c for c in merged.columns if c not in ("bucket", "word", "_d", "_m", "_c", "_k")]
    out = merged.groupBy(*names) if names else merged.groupBy()
    return out.agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("messages"),
                   F.coalesce(F.sum(F.when(F.col("bucket") >= 0, F.col("_d"))), F.lit(0)).alias("active_users"),
                   F.coalesce(F.sum("_c"), F.lit(0)).alias("chars"),
                   F.coalesce(F.sum("_k"), F.lit(0)).alias("with_chars"))


def monthly_trend(maps: DataFrame, width: int = 25) -> DataFrame:
    """``timeline.monthly_trend`` from the roll-up."""
    g = distinct_authors(maps, F.date_format("day", "yyyy-MM").alias("month")).select("month", "messages", "active_users")
    peak = total_of(g, F.max("messages"))
    return g.withColumn("bar", F.repeat(F.lit("#"), idiv(F.col("messages") * width, peak).cast("int"))).orderBy("month")


def daily_trend(maps: DataFrame, first_day: Column) -> DataFrame:
    return distinct_authors(maps.filter(F.col("day") >= first_day), F.col("day").alias("date")).select(
        "date", F.col("messages").alias("message_count"), "active_users").orderBy("date")


def channel_users(maps: DataFrame, channels: DataFrame, first_day: Column) -> DataFrame:
    """Messages and distinct authors of each channel since a day, none included."""
    per = distinct_authors(maps.filter(F.col("day") >= first_day), "tenant_id", F.col("channel_id").alias("id"))
    return channels.select("tenant_id", "id", "name").join(per, ["tenant_id", "id"], "left").select(
        "id", "name", F.coalesce("messages", F.lit(0)).alias("messages"),
        F.coalesce("active_users", F.lit(0)).alias("active_users"))


def overview(maps: DataFrame, first_day: Column, days: int) -> DataFrame:
    """The figures of ``timeline.overview`` that messages give, for windows that
    start with a day: the current one and the one of ``days`` days before it."""
    day = F.col("day")
    old_day = F.date_sub(first_day, days)
    parts = distinct_authors(maps.filter(day >= old_day), (day >= first_day).alias("current"))
    a = parts.agg(*[F.coalesce(F.max(F.when(F.col("current") == now, F.col(c))), F.lit(0)).alias(name)
                    for c, now, name in (("messages", True, "total_messages"), ("active_users", True, "total_users"),
                                         ("chars", True, "_c"), ("with_chars", True, "_k"),
                                         ("messages", False, "_pm"), ("active_users", False, "_pu"))])

    def change(c, p):
        return F.when(F.col(p) > 0, share(F.col(c) - F.col(p), F.col(p))).otherwise(F.lit(0.0))

    return a.select("total_messages", "total_users", change("total_messages", "_pm").alias("messages_change_percent"),
                    change("total_users", "_pu").alias("users_change_percent"),
                    round_ratio(F.col("total_messages"), F.lit(max(days, 1)), 1).alias("avg_messages_per_day"),
                    F.coalesce(round_ratio(F.col("_c"), F.col("_k"), 1), F.lit(0.0)).alias("avg_message_length"))
