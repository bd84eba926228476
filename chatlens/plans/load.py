"""One load run: raw records of a dump → new versions of the chat tables.

The reference loads row by row (upsert author, insert message, mentions,
reactions, commit every 100). Here one batch job applies the same policies
set at a time:

1. keep records newer than ``as_of - sync_days``;
2. flatten messages, explode mentions and reactor pages;
3. get-or-create emojis, then resolve reaction emoji ids;
4. upsert users (and servers / channels / members when given), insert
   messages, mentions and reactions first-write-wins;
5. recompute the sync high-water marks;
6. write every table as a **new version** (never overwriting what was read)
   and refresh the roll-ups for the days the batch touched.

A rerun over the same dump yields the same tables. Each written version is a
lineage cut; a lost executor only recomputes the stage it was running.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.operators import ingest as G
from chatlens.operators.common import resolve_reply_author
from chatlens.plans.store import refresh_rollups, write_table

FACT_KEYS = {
    "messages": ["tenant_id", "id"],
    "message_mentions": ["tenant_id", "message_id", "mentioned_user_id"],
    "reactions": ["tenant_id", "message_id", "emoji_id", "user_id"],
}


def load_batch(current: dict[str, DataFrame], records: DataFrame, pages: DataFrame | None,
               tenant_id: str, root: str, sync_days: int = 30, as_of=None,
               fetch_reactions: bool = True, new_servers: DataFrame | None = None,
               new_channels: DataFrame | None = None, new_members: DataFrame | None = None,
               write: bool = True) -> dict[str, DataFrame | str]:
    """Apply one dump to the ``current`` tables. Returns the new tables as
    DataFrames (``write=False``) or the paths of their new versions."""
    # one clock for the whole load: tables are written one after the other
    as_of = as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    recs = G.history_cutoff(records, as_of, sync_days)
    kept_ids = recs.select(F.col("id").alias("message_id"))
    pg = None
    if pages is not None and fetch_reactions:
        pg = pages.join(kept_ids, "message_id", "left_semi")

    out: dict[str, DataFrame] = {}
    out["users"] = G.merge_latest_users(current["users"], G.users_from_records(recs, tenant_id, pg))
    out["emojis"] = G.conform_emojis(current["emojis"], recs, tenant_id)
    out["messages"] = G.insert_ignore(current["messages"], G.normalize_messages(recs, tenant_id),
                                      FACT_KEYS["messages"])
    out["message_mentions"] = G.insert_ignore(current["message_mentions"],
                                              G.explode_mentions(recs, tenant_id),
                                              FACT_KEYS["message_mentions"])
    new_reactions = (G.explode_reactions(pg, out["emojis"], tenant_id, loaded_at=as_of) if pg is not None
                     else current["reactions"].limit(0))
    out["reactions"] = G.insert_ignore(current["reactions"], new_reactions, FACT_KEYS["reactions"])
    for name, new, merge in (("servers", new_servers, G.merge_latest_servers),
                             ("channels", new_channels, G.merge_latest_channels),
                             ("server_members", new_members, G.merge_latest_members)):
        if name in current:
            out[name] = merge(current[name], new) if new is not None else current[name]
    out["sync_state"] = G.sync_state_rollup(out["messages"])
    if not write:
        return out
    paths: dict[str, DataFrame | str] = {n: write_table(df, root, n) for n, df in out.items()}
    spark = records.sparkSession
    from chatlens.plans.store import read_table
    msgs = read_table(spark, paths["messages"])
    touched = recs.select(F.to_date("created_at").alias("d")).distinct()
    paths.update(refresh_rollups(resolve_reply_author(msgs), read_table(spark, paths["reactions"]),
                                 read_table(spark, paths["message_mentions"]),
                                 f"{root.rstrip('/')}/rollups", touched_days=touched))
    return paths
