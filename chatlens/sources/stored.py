"""Chat tables stored as parquet (the deployment layout), read lazily."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from chatlens.plans.store import read_table, write_table

STORED = ["servers", "users", "server_members", "channels", "messages", "message_mentions",
          "emojis", "reactions", "extraction_jobs", "usage_logs", "app_users"]


def materialize(tables, root: str, names=STORED, buckets: int | None = None,
                rollups: bool = True) -> dict[str, str]:
    """Write each table once (one version folder per table). With
    ``buckets``, the message-keyed facts become bucketed catalog tables
    (value ``table:<name>``) so joins on message id are co-located."""
    from chatlens.plans.store import BUCKETING, save_bucketed
    out = {}
    for n in names:
        if buckets and n in BUCKETING:
            out[n] = "table:" + save_bucketed(tables[n], n, buckets,
                                              path=f"{root.rstrip('/')}/{n}/bucketed")
        else:
            out[n] = write_table(tables[n], root, n)
    if rollups:
        # the two maintained roll-ups, as refresh_rollups writes them
        from chatlens.plans.store import refresh_rollups
        out.update(refresh_rollups(tables["messages_resolved"], tables["reactions"],
                                   tables["message_mentions"], f"{root.rstrip('/')}/rollups"))
    return out


class StoredChatTables:
    def __init__(self, spark: SparkSession, paths: dict[str, str], raw_dir: str | None = None):
        self.spark = spark
        self.paths = paths
        self.raw_dir = raw_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.raw_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.__dict__.get("paths", {}):
            p = self.paths[name]
            if p.startswith("table:"):
                from chatlens.sources.schema import SCHEMAS
                t = self.spark.table(p[len("table:"):])
                df = t.select(*[f.name for f in SCHEMAS[name].fields])   # schema column order
            else:
                df = read_table(self.spark, p)
            self.__dict__[name] = df
            return df
        raise AttributeError(name)

    @cached_property
    def messages_resolved(self) -> DataFrame:
        from chatlens.operators.common import resolve_reply_author
        return resolve_reply_author(self.messages)

    @cached_property
    def sync_state(self) -> DataFrame:
        from chatlens.operators.ingest import sync_state_rollup
        return sync_state_rollup(self.messages)

    def _stored_rollup(self, name: str) -> DataFrame | None:
        if name not in self.paths:
            return None
        from chatlens.sources.schema import conform
        return conform(read_table(self.spark, self.paths[name]), name)

    @cached_property
    def user_interactions(self) -> DataFrame:
        stored = self._stored_rollup("user_interactions")
        if stored is not None:
            return stored
        from chatlens.operators.rollups import user_interactions
        return user_interactions(self.messages_resolved, self.reactions, self.message_mentions)

    @cached_property
    def daily_stats(self) -> DataFrame:
        stored = self._stored_rollup("daily_stats")
        if stored is not None:
            return stored
        from chatlens.operators.rollups import daily_stats
        return daily_stats(self.messages_resolved)
