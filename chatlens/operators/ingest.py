"""Ingestion and table maintenance.

Batch, set-at-a-time forms of the reference's per-row upserts: flatten and
explode raw records, get-or-create emojis, upsert dimensions with their
column policies, first-write-wins inserts for facts. Every function returns
a lazy DataFrame; writers (``plans.store``) put results in a new folder and
never overwrite the data being read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.functions.columns import (MESSAGE_TYPE_DEFAULT, char_count, snowflake_to_timestamp,
                                        word_count)
from chatlens.operators.common import as_of_col, since, top_k
from chatlens.sources.records import USER as _USER
from chatlens.sources.schema import conform

USER_FIELDS = _USER.fields

DESC, ASC = F.desc_nulls_last, F.asc_nulls_first


# -- flatten -------------------------------------------------------------------
def normalize_messages(records: DataFrame, tenant_id: str) -> DataFrame:
    """One ``messages`` row per record: counts are array sizes, word and
    character counts are computed from the whole content."""
    r = records
    out = r.select(
        F.lit(tenant_id).alias("tenant_id"), "id", F.col("guild_id").alias("server_id"),
        "channel_id", F.col("author.id").alias("author_id"), "content", "created_at",
        "edited_at", F.coalesce("type", F.lit(MESSAGE_TYPE_DEFAULT)).alias("message_type"),
        F.coalesce("pinned", F.lit(False)).alias("is_pinned"),
        F.coalesce("tts", F.lit(False)).alias("is_tts"),
        F.col("reference.message_id").alias("reply_to_message_id"),
        F.lit(None).cast("long").alias("reply_to_author_id"),
        F.coalesce("mention_everyone", F.lit(False)).alias("mentions_everyone"),
        F.coalesce(F.size("mentions"), F.lit(0)).alias("mention_count"),
        F.coalesce(F.size("attachments"), F.lit(0)).alias("attachment_count"),
        F.coalesce(F.size("embeds"), F.lit(0)).alias("embed_count"),
        F.lit(False).alias("has_poll"),
        word_count("content").alias("word_count"), char_count("content").alias("char_count"))
    # size() of a NULL array is -1 under legacy settings; clamp to 0.
    for c in ("mention_count", "attachment_count", "embed_count"):
        out = out.withColumn(c, F.greatest(F.col(c), F.lit(0)))
    return conform(out, "messages")


def explode_mentions(records: DataFrame, tenant_id: str) -> DataFrame:
    m = records.select("id", F.explode("mentions").alias("u"))
    return conform(m.select(F.lit(tenant_id).alias("tenant_id"), F.col("id").alias("message_id"),
                            F.col("u.id").alias("mentioned_user_id"))
                   .dropDuplicates(["message_id", "mentioned_user_id"]), "message_mentions")


def _seen_emojis(records: DataFrame) -> DataFrame:
    """(name, server_id, discord_id, is_custom, is_animated) of every reaction
    emoji; unicode emojis (no id) have no server."""
    r = records.select("guild_id", F.explode("reactions").alias("r")).select(
        "guild_id", F.col("r.emoji").alias("e"))
    custom = F.col("e.id").isNotNull()
    return r.select(F.col("e.name").alias("name"),
                    F.when(custom, F.col("guild_id")).alias("server_id"),
                    F.col("e.id").alias("discord_id"), custom.alias("is_custom"),
                    F.coalesce(F.col("e.animated"), F.lit(False)).alias("is_animated"))


def conform_emojis(existing: DataFrame, records: DataFrame, tenant_id: str) -> DataFrame:
    """Get-or-create the emoji dimension keyed by (name, server_id), NULL-safe.

    Only the tenant's own emojis count as existing; other tenants' rows pass
    through. Existing ids never change; new keys get max(id) + their number in
    the order of (name, server_id). They are numbered within the first two
    characters of the name and shifted by the counts of the beginnings before,
    so no task sees them all."""
    seen = _seen_emojis(records).groupBy("name", "server_id").agg(
        F.max("discord_id").alias("discord_id"), F.max("is_custom").alias("is_custom"),
        F.max("is_animated").alias("is_animated"))
    ex = existing.filter(F.col("tenant_id") == F.lit(tenant_id)).select("name", "server_id")
    new = seen.join(ex, seen["name"].eqNullSafe(ex["name"])
                    & seen["server_id"].eqNullSafe(ex["server_id"]), "left_anti")
    base = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new = new.withColumn("_begin", F.coalesce(F.substring("name", 1, 2), F.lit("")))
    before = Window.orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1)   # of beginnings
    shift = new.groupBy("_begin").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    w = Window.partitionBy("_begin").orderBy(ASC("name"), ASC("server_id"))
    new = new.withColumn("_row", F.row_number().over(w)).join(shift, "_begin") \
             .withColumn("id", (base + F.col("_shift") + F.col("_row")).cast("int")) \
             .withColumn("tenant_id", F.lit(tenant_id))
    return conform(existing, "emojis").unionByName(conform(new, "emojis"))


def explode_reactions(pages: DataFrame, emojis: DataFrame, tenant_id: str,
                      fetch_reactions: bool = True, loaded_at=None) -> DataFrame:
    """One row per (message, emoji, reacting user) from reactor pages; the
    emoji id comes from the dimension by (name, server_id) NULL-safe.
    ``fetch_reactions=False`` loads none, as the reference's switch does."""
    if not fetch_reactions:
        return conform(pages.limit(0).select(F.lit(tenant_id).alias("tenant_id")), "reactions")
    r = pages.select("message_id", "guild_id", "emoji", F.explode("users").alias("u"))
    r = r.select("message_id", F.col("emoji.name").alias("name"),
                 F.when(F.col("emoji.id").isNotNull(), F.col("guild_id")).alias("server_id"),
                 F.col("u.id").alias("user_id"),
                 F.coalesce(F.col("u.reacted_at"), as_of_col(loaded_at)).alias("reacted_at"),
                 F.coalesce(F.col("u.burst"), F.lit(False)).alias("is_super_reaction"))
    em = emojis.filter(F.col("tenant_id") == F.lit(tenant_id)).select(
        F.col("id").alias("emoji_id"), F.col("name").alias("_n"), F.col("server_id").alias("_s"))
    j = r.join(em, r["name"].eqNullSafe(em["_n"]) & r["server_id"].eqNullSafe(em["_s"]), "left")
    j = j.withColumn("tenant_id", F.lit(tenant_id))
    return conform(j.dropDuplicates(["message_id", "emoji_id", "user_id"]), "reactions")


def users_from_records(records: DataFrame, tenant_id: str, pages: DataFrame | None = None
                       ) -> DataFrame:
    """Every user a batch names: authors, mentioned users and (from reactor
    pages) reactors. One row per id; the copy seen last wins, first_seen_at
    is the earliest sighting (message time, or reaction time for reactors).
    An aggregate per id, so a very active user is pre-combined per task."""
    fields = [f.name for f in USER_FIELDS]
    a = records.select(F.col("author").alias("u"), F.col("created_at").alias("t"))
    m = records.select(F.explode("mentions").alias("u"), F.col("created_at").alias("t"))
    u = a.unionByName(m)
    if pages is not None:
        r = pages.select(F.explode("users").alias("x")).select(
            F.struct(*[F.col("x")[f].alias(f) for f in fields]).alias("u"),
            F.col("x.reacted_at").alias("t"))
        u = u.unionByName(r)
    u = u.filter(F.col("u.id").isNotNull())
    latest = u.groupBy(F.col("u.id").alias("id")).agg(
        F.max(F.struct("t", "u"))["u"].alias("u"), F.min("t").alias("first_seen_at"))
    return conform(latest.select(
        F.lit(tenant_id).alias("tenant_id"), "id", F.col("u.name").alias("username"),
        F.col("u.discriminator").alias("discriminator"), F.col("u.global_name").alias("global_name"),
        F.col("u.avatar").alias("avatar_hash"), F.coalesce(F.col("u.bot"), F.lit(False)).alias("is_bot"),
        snowflake_to_timestamp("id").alias("created_at"), "first_seen_at"), "users")


def normalize_legacy(tables: dict[str, DataFrame], tenant_id: str) -> dict[str, DataFrame]:
    """Rename the older per-user schema to the current one. Of the columns it
    lacks, flags are false, the others NULL (``conform``); the time of the
    last sync is that of its completion."""
    ren = {
        "servers": {"server_id": "id"}, "users": {"user_id": "id"},
        "channels": {"channel_id": "id", "channel_type": "type"},
        "messages": {"message_id": "id"}, "emojis": {"emoji_id": "id"},
        "reactions": {"created_at": "reacted_at"}, "sync_state": {"last_sync_at": "completed_at"},
    }
    flags = {"channels": "is_archived", "messages": "has_poll", "reactions": "is_super_reaction"}
    out = {}
    for name, df in tables.items():
        d = df.withColumnsRenamed({k: v for k, v in ren.get(name, {}).items() if k in df.columns})
        if "tenant_id" not in d.columns:
            d = d.withColumn("tenant_id", F.lit(tenant_id))
        if name in flags and flags[name] not in d.columns:
            d = d.withColumn(flags[name], F.lit(False))
        out[name] = conform(d, name)
    return out


# -- merges --------------------------------------------------------------------
def _pick_per_key(new: DataFrame, key: list[str], order_col: str | None, last: bool) -> DataFrame:
    """In-batch dedupe: one row per key, the last (or first) by
    ``order_col``. An aggregate (``max_by``/``min_by``), so partial
    aggregation shrinks a key repeated many times before the shuffle; a
    window per key would put every copy of a hot key in one task."""
    rest = [c for c in new.columns if c not in key]
    if order_col is None:       # the least row, so a rerun picks the same one
        g = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")) if rest else new.distinct()
        return g.select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*new.columns)
    pick = F.max_by if last else F.min_by
    g = new.groupBy(*key).agg(pick(F.struct(*rest), F.col(order_col)).alias("_row"))
    return g.select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*new.columns)


def _latest_per_key(new: DataFrame, key: list[str], order_col: str | None) -> DataFrame:
    return _pick_per_key(new, key, order_col, last=True)


def merge_latest(old: DataFrame, new: DataFrame, key: list[str], overwrite: list[str],
                 keep_first: list[str], set_true: list[str] = (), order_col: str | None = None
                 ) -> DataFrame:
    """Upsert without MERGE: full outer join on the key, then per column the
    new value wins (``overwrite``; a new NULL overwrites too) or the old one
    stays (``keep_first``)."""
    new = _latest_per_key(new, key, order_col)
    o = old.select(*[F.col(c).alias("o_" + c) for c in old.columns])
    n = new.select(*[F.col(c).alias("n_" + c) for c in new.columns])
    cond = None
    for k in key:
        c = F.col("o_" + k) == F.col("n_" + k)
        cond = c if cond is None else cond & c
    j = o.join(n, cond, "full_outer")
    has_new = F.col("n_" + key[0]).isNotNull()
    has_old = F.col("o_" + key[0]).isNotNull()
    cols = []
    for c in old.columns:
        if c in key:
            v = F.coalesce(F.col("n_" + c), F.col("o_" + c))
        elif c in set_true:
            v = F.when(has_new, F.lit(True)).otherwise(F.col("o_" + c))
        elif c in overwrite and ("n_" + c) in n.columns:
            v = F.when(has_new, F.col("n_" + c)).otherwise(F.col("o_" + c))
        elif c in keep_first and ("n_" + c) in n.columns:
            v = F.when(has_old, F.col("o_" + c)).otherwise(F.col("n_" + c))
        else:
            v = F.col("o_" + c) if ("n_" + c) not in n.columns else \
                F.when(has_old, F.col("o_" + c)).otherwise(F.col("n_" + c))
        cols.append(v.alias(c))
    return j.select(*cols)


def merge_latest_servers(old: DataFrame, new: DataFrame, saas: bool = False,
                         order_col: str | None = None) -> DataFrame:
    over = ["name", "icon_hash", "member_count", "last_synced_at"] + ([] if saas else ["owner_id"])
    return merge_latest(old, new, ["tenant_id", "id"], over,
                        ["created_at", "first_synced_at"] + (["owner_id"] if saas else []),
                        order_col=order_col)


def merge_latest_users(old: DataFrame, new: DataFrame, saas: bool = False,
                       order_col: str | None = None) -> DataFrame:
    over = ["username", "global_name", "avatar_hash"] + ([] if saas else ["discriminator"])
    return merge_latest(old, new, ["tenant_id", "id"], over,
                        ["is_bot", "created_at", "first_seen_at"] + (["discriminator"] if saas else []),
                        order_col=order_col)


def merge_latest_members(old: DataFrame, new: DataFrame, order_col: str | None = None) -> DataFrame:
    return merge_latest(old, new, ["tenant_id", "server_id", "user_id"], ["nickname"],
                        ["joined_at"], set_true=["is_active"], order_col=order_col)


def merge_latest_channels(old: DataFrame, new: DataFrame, saas: bool = False,
                          order_col: str | None = None) -> DataFrame:
    over = ["name", "topic", "position"] + (["is_nsfw"] if saas else ["last_synced_at"])
    first = ["type", "parent_id", "created_at", "server_id"] + (["last_synced_at"] if saas else [])
    return merge_latest(old, new, ["tenant_id", "id"], over, first, order_col=order_col)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order_col: str | None = None,
                  prune_col: str | None = None, texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """First write wins: rows whose key exists are dropped, and within the
    batch the first row per key (by ``order_col``) is kept.

    Only stored keys inside the batch's range of ``prune_col`` (default: the
    first key column after ``tenant_id``) can collide, so the anti-join
    reads just that range of the stored keys (two scalar subqueries give the
    bounds). With storage sorted by id, parquet statistics then skip the
    rest of the history instead of shuffling every stored key each load.

    The rows of a batch, which may hold long texts, are shuffled once by the
    key, before the first row is picked: a partial pick would sort all texts on
    the way in, too, and spill them. A batch may also come without its texts:
    ``texts`` then puts them on the rows that are left (``_pick_before_texts``)."""
    prune_col = prune_col or next((k for k in key if k != "tenant_id"), key[0])
    lo = new.agg(F.min(prune_col)).scalar()
    hi = new.agg(F.max(prune_col)).scalar()
    stored = old.select(*key).filter(F.col(prune_col).between(lo, hi))
    if texts is not None:
        if order_col is not None:
            raise ValueError("a batch without texts is picked by its least rows")
        return old.unionByName(_pick_before_texts(new, stored, key, old.columns, texts).select(*old.columns))
    new = _pick_per_key(new.repartition(*key), key, order_col, last=False)
    fresh = new.join(stored, key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def _pick_before_texts(new: DataFrame, stored: DataFrame, key: list[str], columns: list[str],
                       texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The least row of each key that is not stored, of a batch that lacks some
    of ``columns``; ``texts`` adds these (and may make several rows of one, but
    never none). Rows are told apart by the columns before the first missing
    one; only keys that still have several rows are picked with their texts."""
    rest = [c for c in columns if c not in key]
    lead = rest[:next(n for n, c in enumerate(rest) if c not in new.columns)]
    one = new.repartition(*key).distinct()
    if lead:
        least = Window.partitionBy(*key).orderBy(*[ASC(c) for c in lead])
        one = one.withColumn("_at", F.rank().over(least)).filter("_at = 1").drop("_at")
    left = one.join(stored, key, "left_anti")
    several = texts(left).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        *[F.col(c).alias(f"_{c}") for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    sure = texts(left.join(several, same, "left_anti")).select(*columns)
    open_ = texts(left.join(several, same, "left_semi")).select(*columns)
    return sure.unionByName(_pick_per_key(open_.repartition(*key), key, None, last=False))


# -- slices and counters --------------------------------------------------------
def history_cutoff(records: DataFrame, as_of=None, sync_days: int = 30) -> DataFrame:
    return records.filter(F.col("created_at") > since(as_of, sync_days))


def history_page(messages: DataFrame, channel_id: int, before=None, after=None,
                 oldest_first: bool = False, limit: int | None = 100) -> DataFrame:
    m = messages.filter(F.col("channel_id") == channel_id)
    if before is not None:
        m = m.filter(F.col("created_at") < as_of_col(before))
    if after is not None:
        m = m.filter(F.col("created_at") > as_of_col(after))
    order = ([ASC("created_at"), ASC("id")] if oldest_first
             else [DESC("created_at"), DESC("id")])
    return top_k(m, order, limit)


def extraction_stats(records: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Run counters (events seen, duplicates included), one pass over the
    records (plus one over the reactor pages when given; otherwise the
    reaction counts of the record summaries)."""
    r = records.agg(
        F.countDistinct("guild_id").alias("servers"),
        F.countDistinct("author.id").alias("users"),
        F.countDistinct("channel_id").alias("channels"),
        F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.sum(F.aggregate(F.coalesce("reactions", F.array()), F.lit(0),
                                     lambda acc, x: acc + F.coalesce(x["count"], F.lit(0)))),
                   F.lit(0)).cast("long").alias("reactions"),
        F.coalesce(F.sum(F.size("mentions")), F.lit(0)).cast("long").alias("mentions"))
    if pages is not None:
        n = pages.agg(F.coalesce(F.sum(F.size("users")), F.lit(0)).cast("long")).scalar()
        r = r.withColumn("reactions", n)
    return r.select("servers", "users", "channels", "messages", "reactions", "mentions")


def messages_per_channel_run(records: DataFrame) -> DataFrame:
    return records.groupBy("channel_id").agg(F.count(F.lit(1)).alias("count")) \
        .orderBy(DESC("count"), ASC("channel_id"))


def sync_state_rollup(messages: DataFrame, sync_type: str = "messages",
                      as_of=None) -> DataFrame:
    """High-water marks per (tenant, server, channel)."""
    g = messages.groupBy("tenant_id", "server_id", "channel_id").agg(
        F.max("id").alias("last_message_id"), F.min("id").alias("oldest_message_id"),
        F.count(F.lit(1)).cast("int").alias("message_count"),
        F.min("created_at").alias("started_at"), F.max("created_at").alias("completed_at"))
    w = Window.partitionBy("tenant_id").orderBy("server_id", "channel_id")
    return conform(g.select("*", F.lit(sync_type).alias("sync_type"),
                            F.lit("completed").alias("status"),
                            F.row_number().over(w).alias("id")), "sync_state")


def incremental_batch(messages_new: DataFrame, sync_state: DataFrame) -> DataFrame:
    """Keep only messages above the channel's high-water mark."""
    marks = sync_state.select("tenant_id", "server_id", "channel_id", "last_message_id")
    j = messages_new.join(marks, ["tenant_id", "server_id", "channel_id"], "left")
    return j.filter(F.col("last_message_id").isNull() | (F.col("id") > F.col("last_message_id"))) \
        .drop("last_message_id")


def _named(ids: DataFrame, col: str) -> tuple[DataFrame, list[str]]:
    """Deleted keys under the name of a column, and what to join them on."""
    own = [c for c in ids.columns if c != "tenant_id"][0]
    scope = ["tenant_id"] if "tenant_id" in ids.columns else []
    return ids.select(*scope, F.col(own).alias(col)), scope + [col]


def messages_within(messages: DataFrame, servers=None, channels=None) -> list[DataFrame]:
    """(tenant_id, id) of the messages of deleted servers, and of channels."""
    named = [_named(ids, col) for ids, col in ((servers, "server_id"), (channels, "channel_id")) if ids is not None]
    return [messages.join(gone, on, "left_semi").select("tenant_id", "id") for gone, on in named]


def cascade_delete(tables: dict[str, DataFrame], servers=None, channels=None,
                   messages=None, users=None, namesakes: bool = True) -> dict[str, DataFrame]:
    """Apply the foreign-key actions for deleted keys: dependants go,
    ``messages.author_id`` of a deleted user becomes NULL; emojis stay. Keys
    come as a DataFrame of ids, or of (tenant_id, id), which deletes in that
    tenant only. Rows that were orphans before are left alone.

    A message that stays goes after all where it has the id of one that goes
    with its server or channel. ``namesakes=False`` says that there is none, so
    messages, with their texts, are not joined on these ids."""
    t = dict(tables)

    def drop(name, col, ids):
        if ids is not None and name in t:
            gone, on = _named(ids, col)
            t[name] = t[name].join(gone, on, "left_anti")

    if servers is not None:
        drop("servers", "id", servers)
        for n in ("channels", "messages", "server_members", "sync_state"):
            drop(n, "server_id", servers)
    if channels is not None:
        drop("channels", "id", channels)
        drop("messages", "channel_id", channels)
        drop("sync_state", "channel_id", channels)
    if users is not None:
        drop("users", "id", users)
        drop("server_members", "user_id", users)
        drop("message_mentions", "mentioned_user_id", users)
        drop("reactions", "user_id", users)
        gone, on = _named(users, "author_id")
        m = t["messages"]
        left = m.join(gone, on, "left_semi").withColumn("author_id", F.lit(None).cast("long"))
        t["messages"] = m.join(gone, on, "left_anti").unionByName(left.select(*m.columns))
    # Messages removed above (by server or channel) or given directly.
    for removed in messages_within(tables["messages"], servers, channels) + (
            [messages] if messages is not None else []):
        if namesakes or removed is messages:
            drop("messages", "id", removed)
        drop("message_mentions", "message_id", removed)
        drop("reactions", "message_id", removed)
    return t
