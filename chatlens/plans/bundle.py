"""The dashboard: all window results of one request over one scan window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.operators import channels as C
from chatlens.operators import content as X
from chatlens.operators import graph as G
from chatlens.operators import timeline as T
from chatlens.operators import users as U
from chatlens.operators.common import since


def analytics_bundle(t, as_of=None, days: int = 30, cache: bool = True,
                     names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The 11 dashboard results (days 1-365), or those of ``names``. The
    messages of both periods (2 × days) are read once and kept (memory and
    disk) for the lazy frames; the caller unpersists ``bundle['_window']`` when
    done."""
    if not 1 <= days <= 365:
        raise ValueError("days must be within 1..365")
    m = t["messages"].filter(F.col("created_at") >= since(as_of, 2 * days))
    if cache:
        m = m.persist(StorageLevel.MEMORY_AND_DISK)
    spark, c, u, mm = m.sparkSession, t["channels"], t["users"], t["message_mentions"]
    results = {
        "overview": lambda: T.overview(m, c, mm, as_of, days),
        "messages_over_time": lambda: T.timeline(m, as_of, days, "day"),
        "hourly_activity": lambda: T.hourly_activity_filled(m, spark, as_of, days),
        "day_of_week_activity": lambda: T.weekday_filled(m, spark, as_of, days),
        "top_channels": lambda: C.top_channels_detail(c, m, as_of, days),
        "top_users": lambda: U.top_users_detail(u, m, mm, as_of, days),
        "user_interactions": lambda: G.interaction_pairs(m, mm, u, as_of, days),
        "content_metrics": lambda: X.content_metrics(m, as_of, days),
        "engagement_metrics": lambda: T.engagement_metrics(m, u, as_of, days),
        "channel_growth": lambda: C.channel_growth_window(c, m, as_of, days),
        "bot_vs_human": lambda: U.bot_vs_human_pivot(m, u, as_of, days),
    }
    return {"_window": m} | {n: results[n]() for n in (results if names is None else names)}
