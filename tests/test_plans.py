"""Physical-plan properties that matter at scale."""

"""Physical-plan properties that matter at scale (every registered query is
also checked for Cartesian products and Python evaluation in test_oracle)."""


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns_and_pushes_filters(spark, small):
    from chatlens.operators.users import weekly_active_users
    df = weekly_active_users(small.users, small.messages, as_of="2024-01-31 00:00:00")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(ts)" in p or "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in p


def test_adjacent_windows_by_bucket(spark, small):
    from chatlens.operators.replies import conversation_killers
    p = _plan(conversation_killers(small.messages, small.users))
    assert "_bucket" in p


def test_bucketed_layout_colocates_message_joins(spark, small, tmp_path):
    """With the facts bucketed by tenant and message id, reactions ⋈ messages on the
    message id runs without shuffling either side (broadcast disabled to see
    the join). A second equality key (e.g. reactor = author) would need all
    keys for co-partitioning, so such joins still shuffle."""
    from pyspark.sql import functions as F
    from chatlens.plans.store import save_bucketed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        m = spark.table(save_bucketed(small.messages, "messages", 8, database=None))
        r = spark.table(save_bucketed(small.reactions, "reactions", 8, database=None))
        j = r.join(m.select(F.col("id").alias("message_id"), "author_id", "channel_id", "tenant_id"), ["tenant_id", "message_id"])
        p = _plan(j.groupBy("tenant_id", "message_id").agg(F.count(F.lit(1)).alias("n")))
        assert "SortMergeJoin" in p and "Exchange" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_no_text_is_shuffled_before_a_top_k(spark, small):
    """Joins with users that are too large to broadcast move narrow rows only."""
    from chatlens.operators import content as C
    from chatlens.operators import reactions as RE
    from chatlens.operators import replies as RP
    t = small
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024")
        for df in (C.recent_messages(t.messages, t.users), C.longest_messages(t.messages, t.users, t.channels),
                   C.search_messages(t.messages, t.users, t.channels, "haha"), RP.reply_chains(t.messages, t.users),
                   RP.viral_messages(t.messages, t.users, t.channels),
                   RE.most_reacted_messages(t.messages, t.users, t.channels, t.reactions)):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            below = plan[plan.index("GlobalLimit"):]
            top = below.split("\n")[0]
            depth = len(top) - len(top.lstrip(" :+-"))
            inside = [x for x in below.split("\n")[1:]]
            kept = []
            for line in inside:             # the subtree of the limit
                if len(line) - len(line.lstrip(" :+-")) <= depth:
                    break
                kept.append(line)
            projected = [x for x in kept if x.lstrip(" :+-").startswith("Project")]
            assert projected and not any(", content#" in x or "[content#" in x for x in projected[:2]), plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_days_of_a_window_prune_partitions(spark, small, tmp_path):
    """A window of days reads the files of these days only, and an operator's
    window over them gives what it gives over the whole table."""
    from chatlens.operators.users import weekly_active_users
    from chatlens.plans.store import read_table, write_table
    path = write_table(small.messages, str(tmp_path), "messages", "one")
    week = read_table(spark, path, since="2024-01-24")
    plan = _plan(week.select("id"))
    assert "created_day" in plan[plan.index("PartitionFilters"):].split("]")[0]
    assert len(week.inputFiles()) <= len(read_table(spark, path).inputFiles())
    as_of = "2024-01-31 00:00:00"
    assert sorted(map(str, weekly_active_users(small.users, week, as_of=as_of).collect())) == sorted(
        map(str, weekly_active_users(small.users, small.messages, as_of=as_of).collect()))
    assert read_table(spark, path, since="2024-01-05", until="2024-01-04").isEmpty()


def test_bots_leave_after_pairs_are_counted(spark, small):
    """The replies are counted per pair below every join with users, and the
    cards expand no text."""
    from chatlens.operators import graph as G
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = G.reciprocity(small.messages, small.users)._jdf.queryExecution().optimizedPlan().toString()
        lines = plan.split("\n")
        depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
        counted = [k for k, x in enumerate(lines) if x.lstrip(" :+-").startswith("Aggregate [replier_id")]
        assert counted, plan
        for k in counted:       # no user in what the pairs are counted from
            below = next((i for i in range(k + 1, len(lines)) if depth[i] <= depth[k]), len(lines))
            assert not any("c_custkey" in x for x in lines[k:below]), plan
        cards = G.personal_wrapped(small.messages, small.users, small.channels, small.message_mentions)
        plan = cards._jdf.queryExecution().optimizedPlan().toString()
        assert all("content" not in x for x in plan.split("\n") if x.lstrip(" :+-").startswith("Expand"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
