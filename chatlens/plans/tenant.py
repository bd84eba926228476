"""Tenant scoping: every table and roll-up seen through a row filter.

The reference relies on database row-level security keyed by a session
setting. Here each tenant gets its own Spark session (``newSession`` shares
the cluster but not temp views) whose views filter ``tenant_id`` to one
literal; Catalyst pushes that filter into the parquet scan and, with tables
partitioned by ``tenant_id``, prunes the other tenants' files.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.functions.columns import valid_tenant_id

# User-visible tables and the roll-ups, which the SQL editor reaches only
# through their ``_secure`` names.
VISIBLE = ["servers", "users", "server_members", "channels", "messages", "message_mentions",
           "emojis", "reactions", "sync_state"]
# Functions that the SQL editor lists and Spark has not under that name.
SQL_FUNCTIONS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION age(later TIMESTAMP_NTZ, earlier TIMESTAMP_NTZ) "
    "RETURNS INTERVAL DAY TO SECOND RETURN later - earlier",
)
ROLLUPS = {"user_interactions": "user_interactions_secure", "daily_stats": "daily_stats_secure"}


def validate_tenant_id(df: DataFrame, col: str = "tenant_id", out: str = "is_valid") -> DataFrame:
    return df.withColumn(out, valid_tenant_id(col))


def scope(df: DataFrame, tenant: str | None) -> DataFrame:
    """Rows of one tenant; an unset or empty tenant sees nothing. The column
    stays, as operators join on (tenant, id); the SQL editor's views hide it."""
    if not tenant:
        return df.filter(F.lit(False))
    return df.filter(F.col("tenant_id") == F.lit(tenant))


def tenant_scope(tables: Mapping[str, DataFrame], tenant: str | None) -> dict[str, DataFrame]:
    """Scoped copies of the tables and roll-ups (roll-ups under the
    ``_secure`` names)."""
    out = {}
    for name in VISIBLE:
        if name in tables:
            out[name] = scope(tables[name], tenant)
    for name, secure in ROLLUPS.items():
        if name in tables:
            out[secure] = scope(tables[name], tenant)
    return out


def tenant_session(spark: SparkSession, tables: Mapping[str, DataFrame],
                   tenant: str | None) -> SparkSession:
    """A new session (same cluster) whose temp views are exactly the
    tenant's scoped tables. The scoped frames are handed over through
    global temp views with a private name; the child session re-exposes
    them under the plain table names the SQL editor uses."""
    child = spark.newSession()
    tag = f"t{abs(hash((tenant or '', id(child)))):x}"
    for name, df in tenant_scope(tables, tenant).items():
        hidden = f"{tag}_{name}"
        df.createOrReplaceGlobalTempView(hidden)
        child.table(f"global_temp.{hidden}").drop("tenant_id").createOrReplaceTempView(name)
        spark.catalog.dropGlobalTempView(hidden)    # the child's view holds the plan
    for text in SQL_FUNCTIONS:
        child.sql(text)
    return child
