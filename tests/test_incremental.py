"""The versioned store, loads in any order, partial roll-ups, ledger, bitmaps."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from chatlens.operators import distincts as B
from chatlens.operators import ingest as G
from chatlens.operators import ledger as LG
from chatlens.operators import partials as P
from chatlens.operators import rollups
from chatlens.operators.common import resolve_reply_author
from chatlens.plans import incremental as I
from chatlens.plans.versions import RefusedWrite, TableStore
from chatlens.sources.schema import SCHEMAS, conform

A, OTHER = "user_demotenant01", "user_secondtenant2"
T0 = dt.datetime(2024, 1, 1, 6)


def tables(spark, n=40, days=3, tenant=A):
    """Messages with replies to earlier and to missing ones, authorless rows,
    reactions and mentions, also of unknown messages."""
    random.seed(5)
    m = [(tenant, k, 1, k % 3, None if k % 11 == 0 else k % 5, f"text {k}", T0 + dt.timedelta(hours=k * 24 * days // n),
          k - 1 - k % 4 if k % 3 == 0 else 1000 + k if k % 13 == 0 else None, k % 7, k % 20) for k in range(1, n)]
    r = [(tenant, random.randint(1, n + 3), random.randint(0, 2), random.randint(0, 5),
          T0 + dt.timedelta(hours=random.randint(0, 24 * days))) for _ in range(60)]
    r = list({x[:4]: x for x in r}.values())
    t = list({(tenant, random.randint(1, n + 3), random.randint(0, 5)) for _ in range(30)})
    return {
        "messages": conform(spark.createDataFrame(
            m, "tenant_id string, id long, server_id long, channel_id long, author_id long, content string, "
               "created_at timestamp_ntz, reply_to_message_id long, word_count int, char_count int"), "messages"),
        "reactions": conform(spark.createDataFrame(
            r, "tenant_id string, message_id long, emoji_id int, user_id long, reacted_at timestamp_ntz"), "reactions"),
        "message_mentions": conform(spark.createDataFrame(
            t, "tenant_id string, message_id long, mentioned_user_id long"), "message_mentions"),
    }


@pytest.fixture(scope="module")
def chat(spark):
    return tables(spark)


def rows(df, cols=None):
    return sorted(map(str, df.select(*(cols or df.columns)).collect()))


def opened(df):
    """First and last day folder that the scans are limited to."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return set(zip(re.findall(r"part#\d+ >= ([\d-]+)", plan), re.findall(r"part#\d+ <= ([\d-]+)", plan)))


def load(store, t, keep):
    return I.load_facts(store, t["messages"].filter(keep("id")), t["reactions"].filter(keep("message_id")),
                        t["message_mentions"].filter(keep("message_id")))


@pytest.fixture(scope="module")
def loaded(spark, chat, tmp_path_factory):
    """Three dumps, the newest ids first, with rows that come twice."""
    root = str(tmp_path_factory.mktemp("store"))
    counts = []
    for lo, hi in ((25, 99), (1, 9), (7, 26)):
        counts.append(load(TableStore(spark, root, A), chat, lambda c: F.col(c).between(lo, hi)))   # noqa: B023
    return root, counts


def test_loads_in_any_order_equal_a_rebuild(spark, chat, loaded):
    root, counts = loaded
    store = TableStore(spark, root, A)
    assert store.at == 3 and rows(store.read("messages", SCHEMAS["messages"])) == rows(chat["messages"])
    whole = resolve_reply_author(chat["messages"])
    want = rollups.user_interactions(whole, chat["reactions"], chat["message_mentions"])
    assert rows(I.user_interactions(store), want.columns) == rows(want) != []
    assert rows(I.daily_stats(store)) == rows(rollups.daily_stats(whole))
    # rows seen and kept come from the pass that wrote them; repeated ids were dropped
    assert [c["messages"]["rows"] for c in counts] == [15, 9, 15]
    waiting = store.read("open_edges", P.OPEN_EDGES).select("message_id").distinct()
    assert {r[0] for r in waiting.collect()} >= {1013, 1026} and waiting.join(
        chat["messages"], F.col("message_id") == F.col("id"), "left_semi").count() == 0


def test_a_load_writes_its_own_days_only(spark, chat, loaded, tmp_path):
    import os
    import shutil
    root = shutil.copytree(loaded[0], tmp_path / "copy")
    store = TableStore(spark, str(root), A)
    gen = store.gen
    new = chat["messages"].filter("id = 39").withColumn("id", F.lit(500).cast("long"))
    none = {n: chat[n].limit(0) for n in ("reactions", "message_mentions")}
    I.load_facts(store, new, none["reactions"], none["message_mentions"])
    for table in ("messages", "daily_parts", "author_maps"):
        days = [d for _, ds, _ in os.walk(f"{root}/{table}/gen={gen}") for d in ds if d.startswith("part=")]
        assert days == ["part=2024-01-04"], table
    assert TableStore(spark, str(root), A).read("messages", SCHEMAS["messages"]).count() == 40


def test_what_is_not_committed_stays_unseen(spark, chat, loaded):
    store = TableStore(spark, loaded[0], A)
    before = rows(store.read("messages", SCHEMAS["messages"]))
    store.append("messages", chat["messages"].withColumn("id", F.col("id") + 9000))
    assert rows(TableStore(spark, loaded[0], A).read("messages", SCHEMAS["messages"])) == before


def test_two_loads_of_one_version_do_not_undo_each_other(spark, chat, tmp_path):
    one, two = TableStore(spark, str(tmp_path), A), TableStore(spark, str(tmp_path), A)
    for s in (one, two):
        s.append("message_mentions", chat["message_mentions"])
    one.commit()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        two.commit()
    assert TableStore(spark, str(tmp_path), A).read("message_mentions", SCHEMAS["message_mentions"]).count() \
        == chat["message_mentions"].count()


def test_rows_of_another_tenant_are_refused(spark, chat, tmp_path):
    store = TableStore(spark, str(tmp_path), A)
    mixed = chat["reactions"].withColumn("tenant_id", F.when(F.col("user_id") == 3, OTHER).otherwise(F.col("tenant_id")))
    counts = store.append("reactions", mixed)
    assert counts["foreign"] == chat["reactions"].filter("user_id = 3").count() > 0
    with pytest.raises(RefusedWrite):
        store.commit()
    assert store.version() == 0


def test_tenants_share_a_store_and_see_their_own_rows(spark, chat, tmp_path):
    for tenant in (A, OTHER):
        s = TableStore(spark, str(tmp_path), tenant)
        s.append("reactions", chat["reactions"].withColumn("tenant_id", F.lit(tenant)))
        s.commit()
    for tenant in (A, OTHER):
        df = TableStore(spark, str(tmp_path), tenant).read("reactions", SCHEMAS["reactions"])
        assert {r.tenant_id for r in df.collect()} == {tenant} and df.count() == chat["reactions"].count()


def test_windows_open_the_folders_of_their_days(spark, loaded):
    store = TableStore(spark, loaded[0], A)
    df = store.read("messages", SCHEMAS["messages"], first="2024-01-02", last="2024-01-02")
    assert opened(df) == {("2024-01-02", "2024-01-02")} and df.count() > 0
    assert {str(r.created_at)[:10] for r in df.collect()} == {"2024-01-02"}


def test_history_pages(spark, chat, loaded):
    store = TableStore(spark, loaded[0], A)
    want = [r.id for r in chat["messages"].filter("channel_id = 1").orderBy(F.desc("created_at"), F.desc("id")).collect()]
    got, key = [], None
    while True:
        page = I.history_page(store, 1, key, limit=4).collect()
        if not page:
            break
        got += [r.id for r in page]
        key = (page[-1].created_at, page[-1].id)
    assert got == want
    first = I.history_page(store, 1, None, limit=2)
    assert opened(first) == {("2024-01-03", "2024-01-04")}
    assert I.history_page(store, 77).count() == 0


def test_deletions_take_back_what_they_added(spark, chat, loaded, tmp_path):
    import shutil
    root = str(shutil.copytree(loaded[0], tmp_path / "copy"))
    before = {n: chat[n] for n in ("messages", "reactions", "message_mentions")}
    gone = {"users": spark.range(2, 3).toDF("id"), "messages": spark.createDataFrame([(6,), (20,)], "id long")}
    store = TableStore(spark, root, A)
    I.delete_cascading(store, **gone)
    left = G.cascade_delete(before, **gone)
    whole = resolve_reply_author(left["messages"])
    want = rollups.user_interactions(whole, left["reactions"], left["message_mentions"])
    store = TableStore(spark, root, A)
    assert rows(I.user_interactions(store), want.columns) == rows(want)
    assert rows(I.daily_stats(store)) == rows(rollups.daily_stats(whole))
    assert rows(store.read("messages", SCHEMAS["messages"])) == rows(left["messages"], SCHEMAS["messages"].names)
    assert rows(store.read("reactions", SCHEMAS["reactions"])) == rows(left["reactions"], SCHEMAS["reactions"].names)


def test_bitmaps_count_like_count_distinct(spark, chat, loaded):
    maps = I.author_maps(TableStore(spark, loaded[0], A))
    got = {(str(r.day), r.channel_id): (r.messages, r.active_users)
           for r in B.distinct_authors(maps, "day", "channel_id").collect()}
    want = {(str(r.d), r.channel_id): (r.n, r.u) for r in chat["messages"].groupBy(
        F.to_date("created_at").alias("d"), "channel_id").agg(
        F.count("*").alias("n"), F.countDistinct("author_id").alias("u")).collect()}
    assert got == want
    (total,) = B.distinct_authors(maps).collect()
    assert (total.messages, total.active_users) == (39, 5)


def test_user_numbers_are_dense_and_stay(spark):
    def of(*users):
        return spark.createDataFrame([(A, u) for u in users], "tenant_id string, author_id long")
    none = spark.createDataFrame([], B.USER_NUMBERS)
    first = B.number_users(none, of(*range(100, 40_000, 7), None, 107))
    second = B.number_users(first, of(100, 5, 6, None))
    numbers = [r.number for r in first.unionByName(second).collect()]
    assert sorted(numbers) == list(range(len(numbers))) and {r.user_id for r in second.collect()} == {5, 6}
    # numbers beyond one bitmap of 32,768 bits
    far = spark.createDataFrame([(A, u, 32_700 + u) for u in range(200)], B.USER_NUMBERS)
    m = of(*range(200), *range(150)).withColumn("created_at", F.lit(T0).cast("timestamp_ntz")) \
        .withColumns({"server_id": F.lit(1), "channel_id": F.col("author_id") % 2, "char_count": F.lit(3)})
    maps = B.author_maps(m, far)
    assert maps.select("bucket").distinct().count() == 2
    assert B.distinct_authors(maps).first().active_users == 200


def test_bitmaps_grow_with_the_authors_not_with_the_channels(spark):
    """Many channels with an author each: a short row for each, whatever the
    number; aggregates hold longs, so no task sorts or keeps wide bitmaps."""
    users = spark.range(0, 200_000, 1_000)
    far = users.select(F.lit(A).alias("tenant_id"), F.col("id").alias("user_id"), F.col("id").alias("number"))
    m = far.select("tenant_id", F.col("user_id").alias("author_id"), F.col("user_id").alias("channel_id"),
                   F.lit(T0).cast("timestamp_ntz").alias("created_at"), F.lit(1).alias("server_id"),
                   F.lit(3).alias("char_count"))
    none = m.limit(1).withColumn("author_id", F.lit(None).cast("long"))
    maps = B.author_maps(m.unionByName(none), far)
    assert maps.count() == 201 and dict(maps.dtypes)["authors"] == "bigint"
    got = B.distinct_authors(maps)
    assert [tuple(r)[:2] for r in got.collect()] == [(201, 200)]
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_ledger_intervals(spark):
    def runs(*iv):
        return spark.createDataFrame([(A, 1, c, lo, hi, n, T0, T0 + dt.timedelta(hours=n)) for c, lo, hi, n in iv],
                                     LG.LEDGER)
    merged = LG.merge_intervals(runs((5, 10, 20, 3), (5, 15, 30, 4), (5, 40, 50, 1), (5, 12, 13, 2), (6, 10, 20, 9)))
    got = sorted((r.channel_id, r.lo, r.hi, r.message_count) for r in merged.collect())
    assert got == [(5, 10, 30, 9), (5, 40, 50, 1), (6, 10, 20, 9)]
    state = {r.channel_id: r for r in LG.sync_state(merged).collect()}
    assert (state[5].oldest_message_id, state[5].last_message_id, state[5].message_count) == (10, 50, 10)
    assert state[5].status == "completed" and state[5].completed_at == T0 + dt.timedelta(hours=4)


def test_ids_below_the_mark_and_in_holes_are_loaded(spark):
    ids = "tenant_id string, server_id long, channel_id long, id long"
    stored = spark.createDataFrame([(A, 1, 5, k) for k in (10, 12, 20)], ids)
    ledger = LG.run_intervals(stored.withColumn("created_at", F.lit(T0).cast("timestamp_ntz")))
    batch = spark.createDataFrame([(A, 1, 5, k) for k in (3, 10, 11, 12, 12, 20, 25, 25)] + [(A, 1, 6, 15)], ids)
    sure, perhaps = LG.split_batch(batch, ledger)
    assert sorted({r.id for r in sure.collect()}) == [3, 15, 25] and {r.id for r in perhaps.collect()} == {10, 11, 12, 20}
    new = LG.fresh_rows(batch, stored, ledger, ["tenant_id", "id"])
    assert sorted(r.id for r in new.collect()) == [3, 11, 15, 25]
    empty = spark.createDataFrame([], LG.LEDGER)
    assert LG.fresh_rows(batch, stored.limit(0), empty, ["tenant_id", "id"]).count() == 7


@pytest.mark.parametrize("ids", [(1, 2, 3, 4), (1, 2, 2, None)])
def test_deleted_channels_take_messages_of_the_same_id_along(spark, tmp_path, ids):
    blank = dict.fromkeys(SCHEMAS["messages"].names)
    m = spark.createDataFrame([blank | {
        "tenant_id": A, "id": k, "server_id": 1, "channel_id": n % 2, "author_id": n, "content": f"text {n}",
        "created_at": T0 + dt.timedelta(days=n)} for n, k in enumerate(ids)], SCHEMAS["messages"])
    store = TableStore(spark, str(tmp_path), A)
    store.append("messages", m)
    store.commit()
    gone = {"channels": spark.createDataFrame([(A, 1)], "tenant_id string, number long"),
            "users": spark.range(2, 3).toDF("id")}
    I.delete_cascading(store, **gone)
    left = TableStore(spark, str(tmp_path), A).read("messages", SCHEMAS["messages"])
    want = G.cascade_delete({"messages": m}, **gone)["messages"]
    assert rows(left) == rows(want, SCHEMAS["messages"].names)
    assert left.count() == (2 if ids[2] == 3 else 1)
