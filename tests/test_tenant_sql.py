"""Tenant isolation and the read-only SQL gate."""

import pytest
from pyspark.sql import functions as F

from chatlens.plans import sql_gate, tenant
from chatlens.sources.fixtures import TENANT


@pytest.fixture(scope="module")
def two_tenants(spark, small):
    other = "user_secondtenant2"
    msgs = small.messages.unionByName(small.messages.filter("id < 100")
                                      .withColumn("tenant_id", F.lit(other))
                                      .withColumn("content", F.lit("secret")))
    users = small.users.unionByName(small.users.withColumn("tenant_id", F.lit(other)))
    return {"messages": msgs, "users": users, "channels": small.channels}, other


def test_no_row_crosses_tenants(spark, two_tenants):
    tables, other = two_tenants
    s = tenant.tenant_session(spark, tables, TENANT)
    assert s.sql("SELECT COUNT(*) FROM messages WHERE content = 'secret'").first()[0] == 0
    s2 = tenant.tenant_session(spark, tables, other)
    assert s2.sql("SELECT COUNT(*) FROM messages").first()[0] == 100
    # the same user id exists in both tenants; each session sees one row
    assert s2.sql("SELECT COUNT(*) FROM users WHERE id = 1").first()[0] == 1
    empty = tenant.tenant_session(spark, tables, "")
    assert empty.sql("SELECT COUNT(*) FROM messages").first()[0] == 0


@pytest.mark.parametrize("sql", [
    "DROP TABLE messages",
    "DELETE FROM messages",
    "INSERT INTO messages SELECT * FROM messages",
    "CREATE TABLE x AS SELECT 1",
    "SET spark.sql.ansi.enabled=false",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/events.parquet`",
    "SELECT * FROM secrets",
    "SELECT * FROM global_temp.anything",
    "SELECT * FROM range(10)",
    "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
    "SELECT 1; SELECT 2",
    "SELECT * FROM messages WHERE id IN (SELECT id FROM hidden_table)",
    "CACHE TABLE messages",
    "SELECT o.* FROM (WITH hidden AS (SELECT 1 AS x) SELECT x FROM hidden) q CROSS JOIN hidden o",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a",
    "SELECT (WITH hidden AS (SELECT 1 AS x) SELECT max(x) FROM hidden) FROM hidden",
    "x" * 10_001,
])
def test_refused(spark, two_tenants, sql):
    s = tenant.tenant_session(spark, two_tenants[0], TENANT)
    with pytest.raises(sql_gate.RefusedQuery):
        sql_gate.safe_sql(s, sql)


@pytest.mark.parametrize("sql", [
    "SELECT replace(content, 'a', 'b') AS c FROM messages",
    "SELECT id FROM messages UNION ALL SELECT id FROM users",
    "WITH c AS (SELECT channel_id, COUNT(*) n FROM messages GROUP BY 1) SELECT * FROM c",
    "SELECT resp_time FROM (SELECT 1 AS resp_time)",
    "SELECT 'DROP TABLE x; --' AS s",
    "WITH a AS (WITH b AS (SELECT id FROM users) SELECT id FROM b), c AS (SELECT id FROM a) SELECT * FROM c JOIN a USING (id)",
    "SELECT id, (SELECT max(id) FROM users) AS top FROM messages WHERE id IN (SELECT id FROM users)",
    "SELECT * FROM VALUES (1), (2) AS v(x)",
    "SELECT id FROM messages INTERSECT SELECT id FROM messages",
])
def test_accepted_and_capped(spark, two_tenants, sql):
    s = tenant.tenant_session(spark, two_tenants[0], TENANT)
    df, truncated = sql_gate.safe_sql(s, sql, limit=5)
    assert df.count() <= 5
    assert truncated.first()[0] in (True, False)


def test_only_views_of_the_session_are_read(spark, two_tenants):
    """A catalog table behind the gate stays shut even if the name is allowed,
    and sessions leave no global views behind."""
    spark.range(3).write.mode("overwrite").saveAsTable("secret_t")
    s = tenant.tenant_session(spark, two_tenants[0], TENANT)
    for sql in ("SELECT * FROM secret_t", "SELECT o.* FROM (WITH secret_t AS (SELECT 1 AS x) "
                "SELECT x FROM secret_t) q CROSS JOIN secret_t o"):
        with pytest.raises(sql_gate.RefusedQuery):
            sql_gate.safe_sql(s, sql)
    with pytest.raises(sql_gate.RefusedQuery):
        sql_gate.safe_sql(s, "SELECT * FROM secret_t", allowed={"secret_t"})
    assert [t for t in spark.catalog.listTables("global_temp") if t.namespace == ["global_temp"]] == []
    spark.sql("DROP TABLE secret_t")


@pytest.mark.parametrize("sql", [
    "SELECT COUNT(*) FROM messages a CROSS JOIN messages b",
    "SELECT a.id FROM messages a JOIN messages b ON a.id < b.id",
    "SELECT a.id FROM messages a, users b",
    "SELECT id FROM messages WHERE EXISTS (SELECT 1 FROM users u WHERE u.id < author_id)",
])
def test_joins_without_keys_are_refused(spark, two_tenants, sql):
    s = tenant.tenant_session(spark, two_tenants[0], TENANT)
    with pytest.raises(sql_gate.RefusedQuery, match="without equal keys"):
        sql_gate.safe_sql(s, sql)


@pytest.mark.parametrize("sql", [
    "SELECT a.id, t.top FROM messages a CROSS JOIN (SELECT max(id) AS top FROM messages) t",
    "SELECT a.id FROM messages a JOIN messages b ON a.reply_to_message_id = b.id AND a.created_at > b.created_at",
    "SELECT a.id, v.x FROM users a CROSS JOIN (VALUES (1), (2)) v(x)",
    "SELECT id, age(created_at, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS since FROM messages",
])
def test_joins_with_keys_or_a_small_side_run(spark, two_tenants, sql):
    s = tenant.tenant_session(spark, two_tenants[0], TENANT)
    rows, cut = sql_gate.run_sql(s, sql, limit=5)
    assert len(rows) == 5 and cut is True


def test_statements_are_stopped_when_their_time_is_up(spark, two_tenants):
    import time
    s = tenant.tenant_session(spark, two_tenants[0], TENANT)
    slow = "SELECT sum(length(regexp_replace(repeat(content, 3000), '(a|e|i)+', 'x'))) AS n FROM messages"
    start = time.time()
    with pytest.raises(sql_gate.TimedOut):
        sql_gate.run_sql(s, slow, seconds=2)
    assert time.time() - start < 25
    rows, cut = sql_gate.run_sql(s, "SELECT COUNT(*) AS n FROM users", seconds=60)
    assert rows[0].n > 0 and cut is False


def test_recursion_ends_with_an_error(spark, two_tenants):
    s = tenant.tenant_session(spark, two_tenants[0], TENANT)
    df, _ = sql_gate.safe_sql(s, "WITH RECURSIVE r(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM r) SELECT max(x) AS m FROM r")
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        df.collect()


def test_row_cap_always_applies(spark, small):
    df, truncated = sql_gate.row_cap(small.messages.select("id"), 10)
    assert df.count() == 10 and truncated.first()[0] is True
    df2, truncated2 = sql_gate.row_cap(small.messages.select("id").limit(3), 10)
    assert df2.count() == 3 and truncated2.first()[0] is False
    assert sql_gate.row_cap(small.messages.select("id"), 0)[0].count() == 0
    df3, _ = sql_gate.row_cap(small.messages.select("id"), 50_000)
    assert df3.count() == min(10_000, small.messages.count())


def _thread(spark, links):
    from chatlens.operators.replies import thread_depths

    df = spark.createDataFrame(links, "id long, reply_to_message_id long")
    return sorted((r.id, r.depth, r.n) for r in thread_depths(df).collect())


def test_threads_of_any_depth(spark):
    """300 replies in a row (more than a user's own recursive query may take),
    replies to nothing, a repeated message, and a circle that no start leads to."""
    chain = [(0, None)] + [(k, k - 1) for k in range(1, 301)]
    got = _thread(spark, chain + [(900, 899), (1000, 1001), (1001, 1000), (500, None), (500, None), (501, 500)])
    assert got == [(k, k, 1) for k in range(301)] + [(500, 0, 2), (501, 1, 2)]
    with pytest.raises(ValueError, match="circle"):
        _thread(spark, [(1, None), (1, 2), (2, 1)])


def test_thread_depths_come_whole(spark):
    """The registered query on threads deeper than any cap of the gate."""
    from types import SimpleNamespace

    from chatlens.catalog import load_all
    from chatlens.sources.schema import SCHEMAS

    queries = load_all()
    n = sql_gate.MAX_LIMIT + 5
    m = spark.range(n).select(F.lit(TENANT).alias("tenant_id"), "id", F.when(F.col("id") > 0, F.col("id") - 1)
                              .alias("reply_to_message_id"))
    tables = {x: spark.createDataFrame([], SCHEMAS[x]) for x in tenant.VISIBLE} | {"messages": m}

    class Tables(SimpleNamespace):
        def __getitem__(self, name):
            return tables[name]

    got = queries["sql_thread_depth"].run(Tables(spark=spark))
    assert got.dtypes == [("depth", "int"), ("messages", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == [(k, 1) for k in range(n)]


def test_set_operations_come_whole(spark):
    """The registered query on more authors than the gate's cap of rows."""
    from types import SimpleNamespace

    from chatlens.catalog import load_all
    from chatlens.sources.schema import SCHEMAS, conform

    n = sql_gate.MAX_LIMIT + 5
    ids = spark.range(n + 1).select(F.lit(TENANT).alias("tenant_id"), "id", F.col("id").alias("author_id"),
                                    F.col("id").alias("message_id"), F.col("id").alias("mentioned_user_id"))
    tables = {x: spark.createDataFrame([], SCHEMAS[x]) for x in tenant.VISIBLE} | {
        x: conform(ids, x) for x in ("messages", "message_mentions")}
    tables["reactions"] = conform(ids.filter(F.col("id") == n).withColumns(
        {"user_id": F.col("id"), "emoji_id": F.lit(3)}), "reactions")

    class Tables(SimpleNamespace):
        def __getitem__(self, name):
            return tables[name]

    got = load_all()["sql_set_operations"].run(Tables(spark=spark))
    assert sorted(r.author_id for r in got.collect()) == list(range(n))
