"""Storage of the chat tables and roll-ups as parquet.

Merges never overwrite what they read: a merged table is written to a new
version folder and the caller switches to it, so each load starts from stored
tables and lineages stay short. Roll-ups are rewritten only for the
days a batch touched (dynamic partition overwrite).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.operators.rollups import daily_stats, user_interactions

# Fact tables are partitioned by tenant and UTC day, so tenant views and
# time windows prune files; dimensions only by tenant.
PARTITIONING = {
    "messages": ["tenant_id", "created_day"],
    "reactions": ["tenant_id"],
    "message_mentions": ["tenant_id"],
    "daily_stats": ["tenant_id", "day_part"],
    "user_interactions": ["tenant_id", "interaction_type"],
}


def write_table(df: DataFrame, root: str, name: str, version: str | None = None) -> str:
    """Write ``df`` as a new version of table ``name``; returns its path."""
    version = version or uuid.uuid4().hex[:12]
    path = f"{root.rstrip('/')}/{name}/v={version}"
    out = df
    parts = PARTITIONING.get(name, ["tenant_id"] if "tenant_id" in df.columns else [])
    if "created_day" in parts:
        out = out.withColumn("created_day", F.to_date("created_at"))
    if "day_part" in parts:
        out = out.withColumn("day_part", F.to_date("day"))
    # rows of a partition folder come together, but a large one is split
    # into several tasks and files (AQE)
    w = out.hint("rebalance", *parts) if parts else out
    (w.write.mode("errorifexists").partitionBy(*parts).parquet(path) if parts
     else w.write.mode("errorifexists").parquet(path))
    return path


# Co-location: the facts joined on message id are bucketed by it with one
# bucket count, so reactions ⋈ messages and mentions ⋈ messages need no
# shuffle, and the reply self-join shuffles only the (pruned) reply side.
BUCKETING = {"messages": ("tenant_id", "id"), "reactions": ("tenant_id", "message_id"),
             "message_mentions": ("tenant_id", "message_id")}


def save_bucketed(df: DataFrame, name: str, buckets: int, database: str | None = None,
                  path: str | None = None) -> str:
    """Write ``df`` as a catalog table bucketed (and sorted) by tenant and
    message id; returns the table name. The catalog keeps the bucketing (a
    metastore on a cluster, the in-memory catalog in tests); with ``path``
    the files go there (an external table, e.g. in a shared folder)."""
    key = BUCKETING[name]
    table = f"{database}.{name}" if database else name
    # Sorted by tenant, then message id: tenant views skip the row groups of
    # other tenants by their statistics; snowflake ids grow with time, so the
    # statistics on created_at are tight too and time windows skip row groups.
    w = (df.repartition(buckets, *key).write.mode("overwrite")
         .bucketBy(buckets, *key).sortBy(*key).format("parquet"))
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
    return table


def read_table(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """A stored table. ``since`` and ``until`` (days, both included) are tested
    on the partition column of a table stored by day, so files of other days
    are not opened; an operator's own time window stays exact within them."""
    df = spark.read.parquet(path)
    for day in ("created_day", "day_part"):
        if day in df.columns:
            if since is not None:
                df = df.filter(F.col(day) >= F.lit(since).cast("date"))
            if until is not None:
                df = df.filter(F.col(day) <= F.lit(until).cast("date"))
    return df.drop(*[c for c in ("created_day", "day_part") if c in df.columns])


def refresh_rollups(messages: DataFrame, reactions: DataFrame, mentions: DataFrame, root: str,
                    touched_days: DataFrame | None = None) -> dict[str, str]:
    """Recompute both roll-ups. With ``touched_days`` (a one-column frame of
    dates) only those days of ``daily_stats`` are rewritten, by dynamic
    partition overwrite; ``user_interactions`` spans all time per pair and
    is rewritten whole (per tenant and type partition)."""
    ds_path = f"{root.rstrip('/')}/daily_stats/current"
    ui_path = f"{root.rstrip('/')}/user_interactions/current"
    m = messages
    if touched_days is not None:
        days = touched_days.select(F.col(touched_days.columns[0]).alias("_d")).distinct()
        m = m.join(days, F.to_date("created_at") == F.col("_d"), "left_semi")
    ds = daily_stats(m).withColumn("day_part", F.to_date("day"))
    ds.hint("rebalance", "tenant_id", "day_part").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic") \
        .partitionBy("tenant_id", "day_part").parquet(ds_path)
    ui = user_interactions(messages, reactions, mentions)
    ui.hint("rebalance", "tenant_id", "interaction_type").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic") \
        .partitionBy("tenant_id", "interaction_type").parquet(ui_path)
    return {"daily_stats": ds_path, "user_interactions": ui_path}
