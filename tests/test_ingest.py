"""Load semantics: flatten, explode, upserts, first write wins."""

import datetime as dt

from pyspark.sql import functions as F

from chatlens.operators import ingest as G
from chatlens.sources.records import (REACTOR_PAGE_SCHEMA, RECORD_SCHEMA, nest_messages,
                                      nest_reactor_pages)
from chatlens.sources.schema import conform
from tests.conftest import rows

T = "user_testtenant01"


def _user(i, name, bot=False, glob=None):
    return {"id": i, "name": name, "discriminator": "0", "global_name": glob, "avatar": None, "bot": bot}


def _reactor(i, name):
    return dict(_user(i, name), reacted_at=dt.datetime(2024, 1, 2), burst=False)


def _rec(i, author, content="hi", reply=None, mentions=(), reactions=(), ts=None, guild=1, ch=10):
    return {"id": i, "guild_id": guild, "channel_id": ch, "author": author, "content": content,
            "created_at": ts or dt.datetime(2024, 1, 1, 12, 0, i % 60), "edited_at": None,
            "tts": False, "pinned": False, "mention_everyone": False, "type": 19 if reply else 0,
            "reference": {"message_id": reply, "channel_id": ch} if reply else None,
            "mentions": list(mentions), "reactions": list(reactions), "attachments": [], "embeds": []}


def records(spark, recs):
    return spark.createDataFrame(recs, RECORD_SCHEMA)


def test_edge_cases_flatten(spark):
    alice, bob, bot = _user(1, "alice"), _user(2, "bob"), _user(3, "robo", bot=True)
    recs = [
        _rec(100, alice, "Hello world!"),
        _rec(101, bob, "", reply=999),                      # reply to an unknown message
        _rec(102, alice, "self", reply=100),                # self reply
        _rec(103, bob, "héllo wörld ✓"),                    # unicode
        _rec(104, alice, "x" * 2000),
        _rec(105, bot, "beep"),                             # bot author kept
        _rec(106, alice, "hey @bob @bob", mentions=[bob, bob, alice]),
    ]
    df = records(spark, recs)
    m = {r.id: r for r in G.normalize_messages(df, T).collect()}
    assert (m[100].word_count, m[100].char_count) == (2, 12)
    assert (m[101].content, m[101].word_count, m[101].reply_to_message_id) == ("", 0, 999)
    assert m[101].reply_to_author_id is None and m[101].message_type == 19
    assert m[103].char_count == len("héllo wörld ✓") and m[104].char_count == 2000
    assert m[105].author_id == 3 and m[106].mention_count == 3
    mm = rows(G.explode_mentions(df, T).select("message_id", "mentioned_user_id"))
    assert mm == [(106, 1), (106, 2)]                      # duplicate mention collapses, self kept


def test_reactions_and_emoji_get_or_create(spark):
    alice = _user(1, "alice")
    reactors = [_reactor(i, f"u{i}") for i in range(10, 30)]
    custom = {"id": 555, "name": "party", "animated": True}
    uni = {"id": None, "name": "😀", "animated": False}
    recs = [_rec(1, alice, reactions=[{"emoji": uni, "count": 20}, {"emoji": custom, "count": 1}]),
            _rec(2, alice, reactions=[{"emoji": uni, "count": 1}])]
    pages = [{"message_id": 1, "guild_id": 1, "emoji": uni, "page": 0, "users": reactors[:12]},
             {"message_id": 1, "guild_id": 1, "emoji": uni, "page": 1, "users": reactors[12:]},
             {"message_id": 1, "guild_id": 1, "emoji": custom, "page": 0,
              "users": [_reactor(1, "alice")]},
             {"message_id": 2, "guild_id": 1, "emoji": uni, "page": 0, "users": [_reactor(10, "u10")]}]
    df = records(spark, recs)
    pg = spark.createDataFrame(pages, REACTOR_PAGE_SCHEMA)
    existing = conform(spark.createDataFrame([(T, 7, None, "😀", False, None, False)],
                                             "tenant_id string, id int, discord_id long, name string, "
                                             "is_custom boolean, server_id long, is_animated boolean"),
                       "emojis")
    em = G.conform_emojis(existing, df, T)
    got = {(r.name, r.server_id): r.id for r in em.collect()}
    assert got[("😀", None)] == 7                          # existing id never changes
    assert got[("party", 1)] == 8                          # new key numbered after max
    again = G.conform_emojis(em, df, T)
    assert rows(again) == rows(em)                          # re-run creates nothing
    rx = G.explode_reactions(pg, em, T)
    assert rx.filter("message_id = 1 AND emoji_id = 7").count() == 20   # 20 reactors, two pages
    assert rx.filter("message_id = 1 AND user_id = 1").count() == 1     # self reaction kept
    assert G.explode_reactions(pg, em, T, fetch_reactions=False).count() == 0
    st = G.extraction_stats(df, pg).first()
    assert (st.messages, st.reactions) == (2, 22)
    assert G.users_from_records(df, T, pg).count() == 21


def test_reactor_pages_are_bounded(spark, small):
    pages = nest_reactor_pages(small.messages, small.users, small.reactions, small.emojis,
                               page_size=2)
    sizes = [r.n for r in pages.select(F.size("users").alias("n")).collect()]
    assert sum(sizes) == small.reactions.count()
    back = G.explode_reactions(pages, small.emojis, "user_demotenant01")
    assert rows(back) == rows(small.reactions)


def test_insert_ignore_first_write_wins_and_rerun(spark, small):
    m = small.messages
    old = m.filter(F.col("id") < 500)
    new = m.filter(F.col("id") >= 400).withColumn("content", F.lit("changed"))
    once = G.insert_ignore(old, new, ["tenant_id", "id"])
    twice = G.insert_ignore(once, new.orderBy(F.rand(7)), ["tenant_id", "id"])
    assert once.count() == m.count() == twice.count()
    assert once.filter("id = 450").first().content != "changed"
    assert rows(once.select("id", "content")) == rows(twice.select("id", "content"))


def test_merge_policies(spark, small):
    u = small.users
    new = u.filter("id < 3").withColumn("username", F.lit("renamed")) \
        .withColumn("global_name", F.lit(None).cast("string")) \
        .withColumn("created_at", F.lit("2030-01-01").cast("timestamp_ntz"))
    merged = {r.id: r for r in G.merge_latest_users(u, new).collect()}
    before = {r.id: r for r in u.collect()}
    assert merged[1].username == "renamed" and merged[1].global_name is None   # NULL overwrites
    assert merged[1].created_at == before[1].created_at                         # keep first
    assert merged[5].username == before[5].username
    members = small.server_members.withColumn("is_active", F.lit(False))
    upd = small.server_members.filter("user_id = 4").withColumn("nickname", F.lit("nn"))
    mm = {r.user_id: r for r in G.merge_latest_members(members, upd).collect()}
    assert mm[4].nickname == "nn" and mm[4].is_active and not mm[5].is_active


def test_round_trip_and_cutoff(small):
    recs = nest_messages(small.messages, small.users, small.message_mentions, small.reactions,
                         small.emojis)
    assert rows(G.normalize_messages(recs, "user_demotenant01")) == rows(small.messages)
    assert G.history_cutoff(recs, "2024-01-31 00:00:00", 0).count() == 0
    page = G.history_page(small.messages, 0, limit=5)
    ts = [r.created_at for r in page.collect()]
    assert ts == sorted(ts, reverse=True) and len(ts) == 5


def test_cascade_delete(spark, small):
    t = {n: small[n] for n in ["messages", "message_mentions", "reactions", "users", "channels",
                               "server_members"]}
    out = G.cascade_delete(t, users=spark.range(3, 4).toDF("id"))
    assert out["messages"].count() == small.messages.count()
    assert out["messages"].filter("author_id = 3").count() == 0
    assert out["reactions"].filter("user_id = 3").count() == 0


def test_load_batch_rebuilds_tables_and_is_idempotent(spark, small, tmp_path):
    from chatlens.plans.load import load_batch
    from chatlens.plans.store import read_table
    from chatlens.sources.schema import SCHEMAS
    recs = nest_messages(small.messages, small.users, small.message_mentions, small.reactions,
                         small.emojis)
    pages = nest_reactor_pages(small.messages, small.users, small.reactions, small.emojis)

    def empty(name):
        return spark.createDataFrame([], SCHEMAS[name])

    start = {n: empty(n) for n in ["users", "emojis", "messages", "message_mentions", "reactions"]}
    paths = load_batch(start, recs, pages, "user_demotenant01", str(tmp_path / "v1"),
                       sync_days=365, as_of="2024-01-31 00:00:00")
    got = {n: read_table(spark, paths[n]).select(*[f.name for f in SCHEMAS[n].fields])
           for n in ["messages", "message_mentions", "reactions"]}
    assert rows(got["messages"]) == rows(small.messages)
    assert rows(got["message_mentions"]) == rows(small.message_mentions)
    assert rows(got["reactions"].drop("emoji_id")) == rows(small.reactions.drop("emoji_id"))
    # a second run over the same dump changes nothing
    cur = {n: read_table(spark, paths[n]) for n in start}
    again = load_batch(cur, recs, pages, "user_demotenant01", str(tmp_path / "v2"),
                       sync_days=365, as_of="2024-01-31 00:00:00", write=False)
    for n in ["messages", "message_mentions", "reactions", "users", "emojis"]:
        assert again[n].count() == cur[n].count()
    # sync_days 0 loads nothing new
    none = load_batch(start, recs, pages, "user_demotenant01", "", sync_days=0,
                      as_of="2024-01-31 00:00:00", write=False)
    assert none["messages"].count() == 0


def test_legacy_flags_and_sync_time(spark):
    old = {
        "channels": spark.sql("SELECT 5L AS channel_id, 1L AS server_id, 'a' AS name, 0 AS channel_type"),
        "messages": spark.sql("SELECT 9L AS message_id, 7L AS author_id, 5L AS channel_id, 'x' AS content"),
        "reactions": spark.sql("SELECT 9L AS message_id, 3 AS emoji_id, 7L AS user_id, "
                               "TIMESTAMP_NTZ '2024-01-02 03:04:05' AS created_at"),
        "sync_state": spark.sql("SELECT 1 AS id, 1L AS server_id, 5L AS channel_id, 9L AS last_message_id, "
                                "TIMESTAMP_NTZ '2024-01-03 00:00:00' AS last_sync_at"),
    }
    new = {k: v.first() for k, v in G.normalize_legacy(old, "t").items()}
    assert (new["channels"].id, new["channels"].is_archived) == (5, False)
    assert (new["messages"].id, new["messages"].has_poll, new["messages"].thread_id) == (9, False, None)
    assert new["reactions"].is_super_reaction is False and str(new["reactions"].reacted_at) == "2024-01-02 03:04:05"
    assert str(new["sync_state"].completed_at) == "2024-01-03 00:00:00"
