"""The skew-safe window replacements agree with the plain windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlens.operators.common import adjacent, rank_desc, top_k_per_group
from chatlens.operators.timeline import latest_per_author
from tests.conftest import rows


def test_adjacent_prev_and_next_match_lag_lead(mid):
    m = mid.messages.select("id", "channel_id", "created_at")
    w = Window.partitionBy("channel_id").orderBy("created_at", "id")
    want = m.select("id", F.lag("id").over(w).alias("p"), F.lead("id").over(w).alias("n"))
    prev = adjacent(m, ["channel_id"], "created_at", "id", ["id"], which="prev", bucket="day")
    nxt = adjacent(m, ["channel_id"], "created_at", "id", ["id"], which="next", bucket="hour")
    got = prev.select("id", F.col("prev_id").alias("p")).join(
        nxt.select("id", F.col("next_id").alias("n")), "id")
    assert rows(got) == rows(want)


def test_latest_per_author_matches_row_number(mid):
    m = mid.messages
    w = Window.partitionBy("author_id").orderBy(F.desc("created_at"), F.desc("id"))
    want = m.select("author_id", "created_at", F.row_number().over(w).alias("rn"))
    assert rows(latest_per_author(m, bucket="day")) == rows(want)


def test_top_k_per_group_matches_window(mid):
    j = mid.extraction_jobs
    w = Window.partitionBy("user_id").orderBy(F.desc("started_at"), F.desc("id"))
    want = j.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("user_id", "id")
    got = top_k_per_group(j, ["user_id"], [F.desc("started_at"), F.desc("id")], 2, salts=4)
    assert rows(got.select("user_id", "id")) == rows(want)


def test_rank_desc_matches_rank(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 3, 5, 1, 3, 9])], "k int, v int")
    want = df.select("k", F.rank().over(Window.orderBy(F.desc("v"))).alias("r"))
    got = rank_desc(df, "v").select("k", F.col("rank").alias("r"))
    assert rows(got) == rows(want)


def test_catalysts_match_brute_force(mid):
    """Range join by buckets against a plain per-channel scan in pandas."""
    from chatlens.operators.replies import conversation_catalysts
    got = conversation_catalysts(mid.messages, mid.users, min_followups=2, min_sparks=1, k=None)
    m = mid.messages.join(mid.users.filter(~F.col("is_bot")).select(
        F.col("id").alias("author_id")), "author_id").select(
        "id", "author_id", "channel_id", "created_at").toPandas()
    m = m.sort_values(["channel_id", "created_at", "id"])
    attempts, success = {}, {}
    us = 30 * 60 * 10**6
    for _, g in m.groupby("channel_id"):
        ts = g["created_at"].astype("int64").tolist()   # nanoseconds
        ts = [t // 1000 for t in ts]
        ids, authors = g["id"].tolist(), g["author_id"].tolist()
        for i in range(len(ts)):
            if i > 0 and ts[i] - ts[i - 1] <= us:
                continue
            j = i + 1
            fu, who = 0, set()
            while j < len(ts) and ts[j] - ts[i] <= us:
                if ts[j] > ts[i]:
                    fu += 1
                    who.add(authors[j])
                j += 1
            if fu == 0:
                continue
            a = authors[i]
            attempts[a] = attempts.get(a, 0) + 1
            success[a] = success.get(a, 0) + (1 if fu >= 2 and len(who) >= 2 else 0)
    names = {r.id: r.username for r in mid.users.select("id", "username").collect()}
    want = sorted((names[a], n, success[a]) for a, n in attempts.items())
    assert sorted((r.username, r.spark_attempts, r.successful_ignitions)
                  for r in got.collect()) == want


def test_adjacent_with_one_hot_channel(mid):
    """Every message in one channel: the plain window would be one task;
    the bucketed form must still give the same neighbours."""
    m = mid.messages.select("id", F.lit(0).cast("long").alias("channel_id"), "created_at")
    w = Window.partitionBy("channel_id").orderBy("created_at", "id")
    want = m.select("id", F.lag("id").over(w).alias("p"))
    got = adjacent(m, ["channel_id"], "created_at", "id", ["id"], which="prev")
    assert rows(got.select("id", F.col("prev_id").alias("p"))) == rows(want)
