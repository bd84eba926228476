"""Usage metering and extraction jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.columns import round_ratio
from chatlens.operators.common import as_of_col, since, top_k_per_group

DESC, ASC = F.desc_nulls_last, F.asc_nulls_first

# Plan limits (storage MB, queries per month, history days).
PLAN_LIMITS = {
    "free": (500, 1000, 30),
    "pro": (5000, 999999, 365),
    "team": (25000, 999999, 9999),
}
ACTIVE_STATES = ["pending", "running"]
MB = 1024 * 1024


def _limit(plan: Column, idx: int) -> Column:
    m = F.create_map(*[x for name, lim in PLAN_LIMITS.items() for x in (F.lit(name), F.lit(lim[idx]))])
    return F.coalesce(m[plan], F.lit(PLAN_LIMITS["free"][idx]))


def usage_this_month(usage_logs: DataFrame, extraction_jobs: DataFrame, app_users: DataFrame,
                     as_of=None) -> DataFrame:
    """Per user: queries and extractions since the month start, storage (all
    time, MB 2 dp), limits of the plan, storage share capped at 100 %."""
    month = F.date_trunc("month", as_of_col(as_of)).cast("timestamp_ntz")
    u = usage_logs.groupBy("user_id").agg(
        F.count(F.when((F.col("action") == "query") & (F.col("created_at") >= month), 1))
        .alias("queries_this_month"),
        F.coalesce(F.sum("storage_bytes"), F.lit(0)).cast("long").alias("_bytes"))
    j = extraction_jobs.filter(F.col("started_at") >= month).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("extractions_this_month"))
    a = app_users.select(F.col("id").alias("user_id"), "plan")
    out = a.join(u, "user_id", "left").join(j, "user_id", "left")
    b = F.coalesce("_bytes", F.lit(0))
    lim_mb = _limit(F.col("plan"), 0)
    return out.select(
        "user_id", "plan", F.coalesce("queries_this_month", F.lit(0)).alias("queries_this_month"),
        _limit(F.col("plan"), 1).alias("queries_limit"),
        F.coalesce("extractions_this_month", F.lit(0)).alias("extractions_this_month"),
        round_ratio(b, F.lit(MB), 2).alias("storage_used_mb"), lim_mb.alias("storage_limit_mb"),
        F.least(round_ratio(b, lim_mb.cast("long") * MB, 1, 100), F.lit(100.0)).alias("storage_pct"))


def over_quota(usage_logs: DataFrame, extraction_jobs: DataFrame, app_users: DataFrame,
               as_of=None) -> DataFrame:
    """Users at or over the monthly query limit (free plan) or with a job
    asking for more history days than the plan allows."""
    month = F.date_trunc("month", as_of_col(as_of)).cast("timestamp_ntz")
    q = usage_logs.filter((F.col("action") == "query") & (F.col("created_at") >= month)) \
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("queries_this_month"))
    d = extraction_jobs.groupBy("user_id").agg(F.max("sync_days").alias("max_sync_days_requested"))
    a = app_users.select(F.col("id").alias("user_id"), "plan")
    j = a.join(q, "user_id", "left").join(d, "user_id", "left").select(
        "user_id", "plan", F.coalesce("queries_this_month", F.lit(0)).alias("queries_this_month"),
        "max_sync_days_requested")
    flag_q = (F.col("plan") == "free") & (F.col("queries_this_month") >= _limit(F.col("plan"), 1))
    flag_d = F.coalesce(F.col("max_sync_days_requested") > _limit(F.col("plan"), 2), F.lit(False))
    return j.select("*", flag_q.alias("query_limit_reached"), flag_d.alias("sync_days_exceeded")) \
        .filter(F.col("query_limit_reached") | F.col("sync_days_exceeded"))


def job_history(extraction_jobs: DataFrame, k: int = 10) -> DataFrame:
    """Newest k jobs of each user; NULL message counts read 0."""
    j = extraction_jobs.withColumn("messages_extracted",
                                   F.coalesce("messages_extracted", F.lit(0)))
    return top_k_per_group(j, ["user_id"], [DESC("started_at"), DESC("id")], k,
                           salt_cols=["id"]).select(
        "user_id", "id", "status", F.col("guild_id").cast("string").alias("guild_id"), "sync_days",
        "messages_extracted", "started_at", "completed_at", "error_message")


def active_jobs(extraction_jobs: DataFrame) -> DataFrame:
    return extraction_jobs.filter(F.col("status").isin(*ACTIVE_STATES)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"))


def job_retention(extraction_jobs: DataFrame, as_of=None, days: int = 30) -> DataFrame:
    """Jobs kept by the cleanup: not finished, or finished after the cutoff."""
    c = F.col("completed_at")
    return extraction_jobs.filter(c.isNull() | (c >= since(as_of, days)))
