"""Loads that write only what a dump touches, and the roll-ups they keep.

A load appends the rows that are not stored yet to the parts of their own days,
rewrites the key buckets of users, channels and the like that it names, folds
its partial roll-ups, and publishes all of it with one manifest
(``plans.versions``). The result does not depend on how the history is cut into
dumps or on their order.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.operators import distincts as B
from chatlens.operators import ingest as G
from chatlens.operators import ledger as LG
from chatlens.operators import partials as P
from chatlens.plans.versions import PARTS, TableStore, bucket_part
from chatlens.sources.schema import SCHEMAS

KEYS = {"message_mentions": ["tenant_id", "message_id", "mentioned_user_id"],
        "reactions": ["tenant_id", "message_id", "emoji_id", "user_id"]}
FEW = 100_000           # keys that are broadcast


def _if_few(keys: DataFrame) -> DataFrame | None:
    """A list of keys as rows that the plan holds, if it is a short one."""
    rows = keys.limit(FEW + 1).toArrow()
    return keys.sparkSession.createDataFrame(rows) if rows.num_rows <= FEW else None


def _upsert(store: TableStore, name: str, new: DataFrame, merge) -> dict:
    """Merge ``new`` into the buckets that it falls into; the others stay."""
    part = PARTS.get(name, lambda: bucket_part("id"))()
    touched = new.select(part.alias("part")).distinct()
    old = store.read(name, SCHEMAS[name], parts=touched)
    return store.replace(name, merge(old, new), touched)


def _fold(store: TableStore, messages: DataFrame, reactions: DataFrame, mentions: DataFrame) -> dict[str, dict]:
    """Stage the partial roll-ups of fresh rows (``messages`` etc. are read
    again from what the load staged, so nothing is worked out twice)."""
    waiting = store.read("open_edges", P.OPEN_EDGES)
    edges = P.open_edges(messages, reactions, mentions).unionByName(waiting)
    stored = store.read("messages", SCHEMAS["messages"])
    cols = ["tenant_id", "id", "author_id", "server_id", "created_at"]
    resolved = P.resolve(edges, stored.select(*cols).unionByName(messages.select(*cols)))
    out = {"interaction_parts": store.append("interaction_parts", P.interaction_parts(resolved, messages)),
           "daily_parts": store.append("daily_parts", P.daily_parts(resolved, messages)),
           "open_edges": store.replace("open_edges", resolved.filter("found IS NULL").select(*P.OPEN_EDGES.names))}
    numbers = store.read("user_numbers", B.USER_NUMBERS)
    out["user_numbers"] = store.append("user_numbers", B.number_users(numbers, messages))
    known = numbers.unionByName(_staged(store, "user_numbers", B.USER_NUMBERS))
    out["author_maps"] = store.append("author_maps", B.author_maps(messages, known))
    return out


def _staged(store: TableStore, name: str, schema) -> DataFrame:
    """What this load has staged of a table."""
    if not store.staged[name][1]["rows"]:
        return store.spark.createDataFrame([], schema)
    rows = store._files(name, schema).filter(F.col("gen") == store.gen)
    return rows.select(*schema.names)


def load_facts(store: TableStore, messages: DataFrame, reactions: DataFrame, mentions: DataFrame,
               upserts: dict | None = None, started_at=None, completed_at=None) -> dict[str, dict]:
    """One load of flat rows: first write wins for facts, ``upserts`` (table →
    (rows, merge function)) for dimensions. Returns rows and foreign rows of
    each table, as counted while they were written, and commits."""
    counts = {}
    ledger = store.read("sync_ledger", LG.LEDGER)
    stored = store.read("messages", SCHEMAS["messages"])
    key = ["tenant_id", "id"]
    doubtful = _if_few(LG.doubtful_keys(messages, stored, ledger, key))
    fresh = messages if doubtful is not None and doubtful.isEmpty() else \
        LG.fresh_rows(messages, stored, ledger, key, doubtful)
    counts["messages"] = store.append("messages", fresh)
    for name, batch in (("reactions", reactions), ("message_mentions", mentions)):
        old = store.read(name, SCHEMAS[name])
        fresh = G.insert_ignore(old.limit(0), batch, KEYS[name]).join(
            old.select(*KEYS[name]).filter(F.col("message_id").between(
                batch.agg(F.min("message_id")).scalar(), batch.agg(F.max("message_id")).scalar())),
            KEYS[name], "left_anti")
        counts[name] = store.append(name, fresh)
    fresh = {n: _staged(store, n, SCHEMAS[n]) for n in ("messages", "reactions", "message_mentions")}
    runs = LG.run_intervals(fresh["messages"], started_at, completed_at)
    touched = runs.select(PARTS["sync_ledger"]().alias("part")).distinct()
    merged = LG.merge_intervals(store.read("sync_ledger", LG.LEDGER, parts=touched).unionByName(runs))
    counts["sync_ledger"] = store.replace("sync_ledger", merged, touched)
    counts |= _fold(store, fresh["messages"], fresh["reactions"], fresh["message_mentions"])
    for name, (rows, merge) in (upserts or {}).items():
        counts[name] = _upsert(store, name, rows, merge)
    store.commit()
    return counts


def load_dump(store: TableStore, records: DataFrame, pages: DataFrame | None = None, sync_days: int = 30,
              as_of=None, new_channels: DataFrame | None = None, new_servers: DataFrame | None = None,
              new_members: DataFrame | None = None) -> dict[str, dict]:
    """One dump of raw records (and reactor pages) into the store."""
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    as_of = as_of or started
    t = store.tenant
    recs = G.history_cutoff(records, as_of, sync_days)
    upserts: dict = {"users": (G.users_from_records(recs, t, pages), G.merge_latest_users)}
    for name, rows, merge in (("channels", new_channels, G.merge_latest_channels),
                              ("servers", new_servers, G.merge_latest_servers),
                              ("server_members", new_members, G.merge_latest_members)):
        if rows is not None:
            upserts[name] = rows, merge
    emojis = G.conform_emojis(store.read("emojis", SCHEMAS["emojis"]), recs, t)
    reactions = store.spark.createDataFrame([], SCHEMAS["reactions"])
    if pages is not None:
        kept = pages.join(recs.select(F.col("id").alias("message_id")), "message_id", "left_semi")
        reactions = G.explode_reactions(kept, emojis, t, loaded_at=as_of)
        upserts["emojis"] = emojis, lambda _old, new: new
    return load_facts(store, G.normalize_messages(recs, t), reactions, G.explode_mentions(recs, t), upserts,
                      started_at=started, completed_at=dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))


def _namesakes(stored: DataFrame, keys: dict) -> bool:
    """Whether a message that stays has the id of one that goes with its server
    or channel."""
    gone = G.messages_within(stored, keys.get("servers"), keys.get("channels"))
    if not gone:
        return False
    stay = G.cascade_delete({"messages": stored}, **keys, namesakes=False)["messages"].select("tenant_id", "id")
    return not reduce(DataFrame.unionByName, gone).join(stay, ["tenant_id", "id"], "left_semi").isEmpty()


def delete_cascading(store: TableStore, **keys) -> dict[str, dict]:
    """``ingest.cascade_delete`` on the store: the rows go, the roll-ups of the
    days that this touches are worked out again from what is left of these days,
    and no other day is written."""
    names = ["messages", "reactions", "message_mentions", "users", "channels", "server_members"]
    before = {n: store.read(n, SCHEMAS[n]) for n in names}
    keys = {n: ids for n, ids in keys.items() if ids is not None}
    short = {n: _if_few(ids) for n, ids in keys.items()}
    keys = {n: ids if short[n] is None else F.broadcast(short[n]) for n, ids in keys.items()}
    namesakes = _namesakes(before["messages"], keys)
    after = G.cascade_delete(before, **keys, namesakes=namesakes)
    in_place = not namesakes and None not in short.values()     # messages, with their texts, are only filtered
    days = P.touched_days(before, after).select("part").distinct()
    days = days.sparkSession.createDataFrame(days.toArrow())       # days of a tenant
    counts = {}
    day_of = {"messages": "created_at", "reactions": "reacted_at"}
    for name in names:
        if name in day_of:
            here = F.date_format(F.to_date(day_of[name]), "yyyy-MM-dd").alias("part")
            kept = after[name].withColumn("part", here).join(F.broadcast(days), "part", "left_semi").drop("part")
            counts[name] = store.replace(name, kept, days, in_place and name == "messages")
        else:
            counts[name] = store.replace(name, after[name])
    m = after["messages"].withColumn("part", PARTS["messages"]()).join(days, "part", "left_semi").drop("part")
    r = after["reactions"].withColumn("part", PARTS["reactions"]()).join(days, "part", "left_semi").drop("part")
    tags = after["message_mentions"].join(
        m.select("tenant_id", F.col("id").alias("message_id")), ["tenant_id", "message_id"], "left_semi")
    resolved = P.resolve(P.open_edges(m, r, tags), after["messages"])
    counts["interaction_parts"] = store.replace("interaction_parts", P.interaction_parts(resolved, m), days)
    counts["daily_parts"] = store.replace("daily_parts", P.daily_parts(resolved, m), days)
    still = (P.open_edges(after["messages"], after["reactions"], after["message_mentions"]))
    counts["open_edges"] = store.replace("open_edges", P.resolve(still, after["messages"])
                                         .filter("found IS NULL").select(*P.OPEN_EDGES.names))
    counts["author_maps"] = store.replace(
        "author_maps", B.author_maps(m, store.read("user_numbers", B.USER_NUMBERS)), days)
    store.commit()
    return counts


def user_interactions(store: TableStore) -> DataFrame:
    return P.combine_interactions(store.read("interaction_parts", P.INTERACTION_PARTS))


def daily_stats(store: TableStore, first: str | None = None, last: str | None = None) -> DataFrame:
    """Days from ``first`` to ``last`` (``yyyy-MM-dd``); no other is opened."""
    return P.combine_daily(store.read("daily_parts", P.DAILY_PARTS, first, last))


def sync_state(store: TableStore) -> DataFrame:
    return LG.sync_state(store.read("sync_ledger", LG.LEDGER))


def author_maps(store: TableStore, first: str | None = None, last: str | None = None) -> DataFrame:
    return store.read("author_maps", B.AUTHOR_MAPS, first, last)


def history_page(store: TableStore, channel_id: int, before: tuple[dt.datetime, int] | None = None,
                 limit: int = 100) -> DataFrame:
    """The ``limit`` messages of a channel before a key (time, id), newest
    first; the last row's key gives the next page. The roll-up tells on which
    days these lie, and the files of no other day are opened."""
    per_day = (store.read("daily_parts", P.DAILY_PARTS, last=None if before is None else f"{before[0]:%Y-%m-%d}")
               .filter(F.col("channel_id") == channel_id).groupBy("day").agg(F.sum("messages").alias("n"))
               .filter("n > 0").orderBy(F.desc("day")).limit(limit + 1).collect())
    need, days = limit, []
    for day, n in per_day:
        days.append(day)
        if before is None or day < before[0].date():      # the key's own day may hold none before it
            need -= n
        if need <= 0:
            break
    if not days:
        return store.spark.createDataFrame([], SCHEMAS["messages"])
    m = store.read("messages", SCHEMAS["messages"], f"{min(days):%Y-%m-%d}", f"{max(days):%Y-%m-%d}").filter(
        F.col("channel_id") == channel_id)
    if before is not None:
        at = F.lit(before[0]).cast("timestamp_ntz")
        m = m.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < before[1])))
    return m.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
