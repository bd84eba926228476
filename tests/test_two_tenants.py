"""A second tenant that holds the same ids changes no total of the first."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatlens.operators import ingest as G
from chatlens.operators import quality, rollups
from chatlens.operators.common import reply_edges, resolve_reply_author

A, B = "user_demotenant01", "user_secondtenant2"


@pytest.fixture(scope="module")
def both(small):
    def double(df):
        return df.unionByName(df.withColumn("tenant_id", F.lit(B)))
    names = ["messages", "reactions", "message_mentions", "users", "channels", "emojis", "server_members"]
    return {n: double(small[n]) for n in names}


def same(one, two, tenant=A):
    cols = one.columns
    two = two.filter(F.col("tenant_id") == tenant) if "tenant_id" in cols else two
    a, b = (sorted(map(str, x.select(*cols).collect())) for x in (one, two))
    assert a == b


def test_replies_and_roll_ups(small, both):
    same(resolve_reply_author(small.messages).select("tenant_id", "id", "reply_to_author_id"),
         resolve_reply_author(both["messages"]).select("tenant_id", "id", "reply_to_author_id"))
    same(reply_edges(small.messages), reply_edges(both["messages"]))
    one = rollups.user_interactions(resolve_reply_author(small.messages), small.reactions, small.message_mentions)
    two = rollups.user_interactions(resolve_reply_author(both["messages"]), both["reactions"],
                                    both["message_mentions"])
    same(one, two)


def test_orphans_see_their_own_tenant(small, both):
    lost = both["messages"].filter((F.col("tenant_id") == A) | (F.col("id") >= 50))
    gone = both["reactions"].filter((F.col("tenant_id") == B) & (F.col("message_id") < 50)).count()
    base = quality.orphan_reactions(small.reactions, small.messages).first()[0]
    assert quality.orphan_reactions(both["reactions"], lost).first()[0] == 2 * base + gone > 0


def test_emojis_are_numbered_per_tenant(spark, small, both):
    records = spark.createDataFrame(
        [(1, 5, [((77, f"{c}{k}", False), 1) for c in "ba" for k in range(3)], dt.datetime(2024, 1, 1))],
        "id long, guild_id long, reactions array<struct<emoji: struct<id: long, name: string, animated: boolean>, "
        "count: int>>, created_at timestamp_ntz")
    first = G.conform_emojis(small.emojis.limit(0), records, A)
    assert [(r.id, r.name) for r in first.orderBy("id").collect()] == [
        (k + 1, n) for k, n in enumerate(["a0", "a1", "a2", "b0", "b1", "b2"])]
    second = G.conform_emojis(first, records, B)
    assert {r.tenant_id: r.n for r in second.groupBy("tenant_id").agg(F.count("*").alias("n")).collect()} == {A: 6, B: 6}
    assert second.select("id").distinct().count() == 12
    assert G.conform_emojis(second, records, B).count() == 12


def test_cascade_in_one_tenant(spark, both):
    gone = spark.createDataFrame([(A, 2)], "tenant_id string, id long")
    out = G.cascade_delete(both, channels=gone, servers=spark.createDataFrame([(B, 1)], "tenant_id string, id long"))
    left = out["messages"]
    assert left.filter((F.col("tenant_id") == A) & (F.col("channel_id") == 2)).count() == 0
    assert left.filter(F.col("tenant_id") == A).count() == both["messages"].filter(
        (F.col("tenant_id") == A) & (F.col("channel_id") != 2)).count()
    assert left.filter((F.col("tenant_id") == B) & (F.col("server_id") == 1)).count() == 0
    assert out["emojis"].count() == both["emojis"].count()


# Operators that follow replies, by their registered query: they join on
# (tenant, id) and must work on what a tenant sees.
ON_A_VIEW = ["top_reply_pairs", "server_reply_pairs", "self_replies", "replies_received", "low_reply_rate",
             "response_speed", "slow_responders", "left_on_read", "best_friends", "best_friends_balance", "reciprocity",
             "fan_relationships", "social_butterfly", "selective_socializers", "engagement_magnetism",
             "low_engagement", "late_night_crew", "personal_wrapped", "resolve_reply_author", "orphan_messages",
             "orphan_reactions", "orphan_mentions", "orphan_channel_refs", "top_users", "channel_activity",
             "interaction_summary", "user_rank"]


class View:
    """A tenant's view of tables that two tenants share, for the queries."""

    def __init__(self, tables, spark):
        from chatlens.plans.tenant import tenant_scope
        self.spark = spark
        self.__dict__.update(tenant_scope(tables, A))
        self.messages_resolved = resolve_reply_author(self.messages)
        self.user_interactions = rollups.user_interactions(self.messages_resolved, self.reactions,
                                                           self.message_mentions)

    def __getitem__(self, name):
        return getattr(self, name)


@pytest.fixture(scope="module")
def view(spark, small):
    names = ["servers", "messages", "reactions", "message_mentions", "users", "channels", "emojis", "server_members"]
    return View({n: small[n].unionByName(small[n].withColumn("tenant_id", F.lit(B))) for n in names}, spark)


@pytest.mark.parametrize("name", ON_A_VIEW)
def test_analytics_on_a_tenants_view(small, view, name):
    from chatlens.catalog import load_all
    run = load_all()[name].run
    assert sorted(map(str, run(view).collect())) == sorted(map(str, run(small).collect()))
