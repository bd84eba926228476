"""Interval ledger of loaded message ids: which stretches of a
channel's ids have been loaded, in place of one mark.

A run adds the interval from its least to its greatest id of each channel.
Intervals that overlap are merged, so a channel has as many as there are gaps
between its runs. An id outside all intervals is new for sure; one inside may
be, as a dump can have holes. Only for the latter the stored keys are read, in
the range of the intervals that are hit, so no id is lost whatever the order of
the dumps: also a backfill below the mark, or into a hole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.sources.schema import conform

CHANNEL = ["tenant_id", "server_id", "channel_id"]
L, S, TS = T.LongType(), T.StringType(), T.TimestampNTZType()
LEDGER = T.StructType([T.StructField(n, t) for n, t in (
    ("tenant_id", S), ("server_id", L), ("channel_id", L), ("lo", L), ("hi", L), ("message_count", L),
    ("started_at", TS), ("completed_at", TS))])


def run_intervals(fresh: DataFrame, started_at=None, completed_at=None) -> DataFrame:
    """One interval a channel for the rows that a run stored. The times are the
    run's, or those of its first and last message."""
    g = fresh.groupBy(*CHANNEL).agg(
        F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("message_count"),
        F.min("created_at").alias("_a"), F.max("created_at").alias("_b"))
    time = lambda given, own: (F.col(own) if given is None else F.lit(given)).cast("timestamp_ntz")
    return g.withColumn("started_at", time(started_at, "_a")).withColumn("completed_at", time(completed_at, "_b")) \
        .select(*LEDGER.names)


def merge_intervals(ledger: DataFrame) -> DataFrame:
    """Overlapping intervals of a channel as one (a window over a channel's
    intervals, of which there are as many as runs since the last merge)."""
    before = Window.partitionBy(*CHANNEL).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*CHANNEL).orderBy("lo", "hi")
    opened = F.coalesce(F.col("lo") > F.max("hi").over(before), F.lit(True))
    return (ledger.withColumn("_new", opened.cast("int")).withColumn("_nr", F.sum("_new").over(so_far))
            .groupBy(*CHANNEL, "_nr").agg(
                F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("message_count").alias("message_count"),
                F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"))
            .select(*LEDGER.names))


def split_batch(batch: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a batch that are new for sure, and those that lie in an interval.

    A channel's intervals are few after merging (the gaps between its runs), so
    they travel as one list."""
    marks = ledger.groupBy(*CHANNEL).agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_held"))     # as many as gaps between runs
    held = F.coalesce(F.exists("_held", lambda x: (x["lo"] <= F.col("id")) & (F.col("id") <= x["hi"])), F.lit(False))
    j = batch.join(marks, CHANNEL, "left").withColumn("_in", held).drop("_held")
    return j.filter("NOT _in").drop("_in"), j.filter("_in").drop("_in")


def _slim(batch: DataFrame, key: list[str]) -> DataFrame:
    """The keys of a batch with the channel of their least row, and how often
    they come; no text is read."""
    rest = [c for c in batch.columns if c not in key]
    upto = 1 + max(rest.index(c) for c in CHANNEL if c in rest)     # the least row begins with the least of these
    return (batch.groupBy(*key).agg(F.min(F.struct(*rest[:upto])).alias("_row"), F.count(F.lit(1)).alias("_n"))
            .select(*key, "_row.*", "_n").select(*key, *[c for c in CHANNEL if c not in key], "_n"))


def _held(slim: DataFrame, stored: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Keys of ``slim`` that are stored; stored keys are read for the intervals
    that the batch hits only."""
    _, perhaps = split_batch(slim, ledger)
    bounds = perhaps.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    known = stored.select(*key).filter(F.col("id").between(bounds.select("lo").scalar(), bounds.select("hi").scalar()))
    return perhaps.join(known, key, "left_semi").select(*key)


def _least_rows(batch: DataFrame, key: list[str]) -> DataFrame:
    rest = [c for c in batch.columns if c not in key]
    return (batch.repartition(*key).groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row"))
            .select(*key, "_row.*").select(*batch.columns))


def doubtful_keys(batch: DataFrame, stored: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Keys that come more than once in the batch or are stored, with ``held``
    for the latter. A row of any other key is fresh as it is."""
    slim = _slim(batch, key)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    held = _held(slim, stored, ledger, key).select(*[F.col(c).alias(f"_{c}") for c in key], F.lit(True).alias("_held"))
    return (slim.join(held, same, "left").filter("_n > 1 OR _held")
            .select(*key, F.coalesce("_held", F.lit(False)).alias("held")))


def fresh_rows(batch: DataFrame, stored: DataFrame, ledger: DataFrame, key: list[str],
               doubtful: DataFrame | None = None) -> DataFrame:
    """Rows of the batch whose key is not stored, one per key (the least row).
    Stored keys are read for the intervals that the batch hits only. Which keys
    are stored is found on the keys and channels alone; the rows themselves,
    which may hold long texts, are shuffled once, by the key. With the
    ``doubtful_keys``, if these are few, only their rows are."""
    if doubtful is not None:
        few = F.broadcast(doubtful.select(*[F.col(c).alias(f"_{c}") for c in key], "held"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
        again = batch.join(few.filter("NOT held"), same, "left_semi")
        return batch.join(few, same, "left_anti").unionByName(_least_rows(again, key))
    held = _held(_slim(batch, key), stored, ledger, key)
    return _least_rows(batch, key).join(held, key, "left_anti").select(*batch.columns)


def sync_state(ledger: DataFrame, sync_type: str = "messages", status: str = "completed",
               error_message: str | None = None) -> DataFrame:
    """One row a channel: the marks, the counts and the times of its runs. The
    id is a hash of the channel, so no task numbers all channels."""
    g = ledger.groupBy(*CHANNEL).agg(
        F.max("hi").alias("last_message_id"), F.min("lo").alias("oldest_message_id"),
        F.sum("message_count").alias("message_count"), F.min("started_at").alias("started_at"),
        F.max("completed_at").alias("completed_at"))
    return conform(g.select("*", F.lit(sync_type).alias("sync_type"), F.lit(status).alias("status"),
                            F.lit(error_message).cast("string").alias("error_message"),
                            F.hash(*CHANNEL).alias("id")), "sync_state")
