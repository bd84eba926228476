"""Chat tables derived from the driver's TPC-H-like tables.

The driver ships no chat data, so tests, the bench and the DuckDB oracle
derive the chat tables from ``/root/testdata/sf*/`` by one set of rules,
written twice: as Spark DataFrames (``chat_tables``) and as SQL
(``ORACLE_PREFIX``, a WITH clause for DuckDB). Every rule reads whole tables:
all customers are users, all events are messages with the whole text of a
document, all nations are channels and emojis. The rules are listed in
FIXTURES.md.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.functions.columns import char_count, idiv, word_count
from chatlens.sources.schema import conform

TENANT = "user_demotenant01"
EPOCH0 = "2023-01-01 00:00:00"


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


class DriverChatTables:
    """Lazy mapping name → DataFrame of chat tables over one driver folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def get(self, name: str, default=None):
        return getattr(self, name, default)

    # -- dimensions -------------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        return conform(c.select(
            F.lit(TENANT).alias("tenant_id"), k.alias("id"), F.col("c_name").alias("username"),
            F.lit("0").alias("discriminator"),
            F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("global_name"),
            (k % 12 == 11).alias("is_bot"), _ts(EPOCH0).alias("created_at")), "users")

    @cached_property
    def servers(self) -> DataFrame:
        c = self.raw("customer")
        return conform(c.agg(F.count(F.lit(1)).alias("member_count")).select(
            F.lit(TENANT).alias("tenant_id"), F.lit(1).cast("long").alias("id"),
            F.lit("community").alias("name"), F.lit(0).cast("long").alias("owner_id"),
            "member_count", _ts(EPOCH0).alias("created_at"),
            _ts("2024-01-31 00:00:00").alias("first_synced_at"),
            _ts("2024-01-31 00:00:00").alias("last_synced_at")), "servers")

    @cached_property
    def channels(self) -> DataFrame:
        sup = self.raw("supplier")
        k = F.col("s_suppkey")
        ctype = (F.when(k == 5, 4).when(k == 6, 2).when(k == 7, 5).when(k == 8, 15)
                 .when(k == 9, 13).otherwise(0))
        name = F.lower(F.replace(F.col("s_name"), F.lit("Supplier#"), F.lit("channel-")))
        return conform(sup.select(
            F.lit(TENANT).alias("tenant_id"), k.alias("id"), F.lit(1).alias("server_id"),
            name.alias("name"), ctype.alias("type"),
            F.when(k % 2 == 0, F.concat(F.lit("about "), name)).alias("topic"),
            k.alias("position"), (k == 3).alias("is_nsfw"), _ts(EPOCH0).alias("created_at"),
            F.lit(False).alias("is_archived")), "channels")

    @cached_property
    def emojis(self) -> DataFrame:
        n = self.raw("nation")
        k = F.col("n_nationkey")
        custom = k % 5 == 0
        return conform(n.select(
            F.lit(TENANT).alias("tenant_id"), k.alias("id"),
            F.when(custom, k + 900000).alias("discord_id"), F.col("n_name").alias("name"),
            custom.alias("is_custom"), F.when(custom, F.lit(1)).alias("server_id"),
            (k == 10).alias("is_animated")), "emojis")

    @cached_property
    def server_members(self) -> DataFrame:
        first = self.raw("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
            F.min("o_orderdate").alias("joined_at"))
        u = self.raw("customer").select(F.col("c_custkey").alias("user_id"))
        k = F.col("user_id")
        return conform(u.join(first, "user_id", "left").select(
            F.lit(TENANT).alias("tenant_id"), F.lit(1).alias("server_id"), k,
            F.when(k % 4 == 0, F.concat(F.lit("nick"), k.cast("string"))).alias("nickname"),
            F.col("joined_at").cast("timestamp_ntz").alias("joined_at"),
            F.lit(True).alias("is_active")), "server_members")

    # -- facts ------------------------------------------------------------
    @cached_property
    def _n_authors(self):
        return self.raw("events").agg(F.max("user_id") + 1).scalar()

    @cached_property
    def _texts(self) -> DataFrame:
        return self.raw("documents").select("doc_id", "text")

    @cached_property
    def slim_messages(self) -> DataFrame:
        """Messages without their text and its counts; ``doc_id`` is that of the
        text, which ``with_texts`` puts on the rows that are left of them."""
        ev = self.raw("events")
        n_docs = self._texts.agg(F.count(F.lit(1))).scalar()
        e = F.col("event_id")
        m = ev.withColumn("doc_id", e % n_docs)
        is_reply = (e % 20 < 7) & (e >= 25)
        reply_to = F.when(is_reply, e - 1 - (e * 13) % 20)
        # views and clicks (about 40 % of all messages) go to channel 0, a hot
        # key; the rest spread over the first half of the other channels, so
        # the second half stays empty
        n_channels = self.raw("supplier").agg(F.count(F.lit(1))).scalar()
        spread = F.greatest(idiv(n_channels - 1, 2), F.lit(1))
        channel = F.when(F.col("event_type").isin("view", "click"), F.lit(0).cast("long")) \
            .otherwise(1 + e % spread)
        mention_count = F.when(e % 20 == 7, 1).when(e % 20 == 8, 1).when(e % 20 == 9, 2).otherwise(0)
        out = m.select(
            F.lit(TENANT).alias("tenant_id"), e.alias("id"), F.lit(1).alias("server_id"),
            channel.alias("channel_id"),
            F.when(e % 500 == 499, F.lit(None)).otherwise(F.col("user_id")).alias("author_id"),
            F.col("ts").alias("created_at"),
            F.when(is_reply, 19).otherwise(0).alias("message_type"),
            (e % 40 == 0).alias("is_pinned"), F.lit(False).alias("is_tts"),
            reply_to.alias("reply_to_message_id"), (e % 97 == 0).alias("mentions_everyone"),
            mention_count.alias("mention_count"),
            F.when(F.col("event_type") == "purchase", e % 3).otherwise(0).alias("attachment_count"),
            F.when(e % 11 == 2, 1).otherwise(0).alias("embed_count"),
            F.lit(False).alias("has_poll"), "doc_id")
        return conform(out, "messages", also=["doc_id"]).drop("content", "word_count", "char_count")

    def with_texts(self, slim: DataFrame) -> DataFrame:
        """Rows of ``slim_messages``, which may have more columns, with texts."""
        e = F.col("id")
        suffix = (F.when(e % 11 == 0, F.lit("?")).when(e % 11 == 1, F.lit(" lol haha!!"))
                  .when(e % 11 == 2, F.lit(" https://example.org/a")).otherwise(F.lit("")))
        content = (F.when(e % 100 == 49, F.lit("")).when(e % 100 == 99, F.lit(None))
                   .otherwise(F.concat(F.col("text"), suffix)))
        out = slim.join(self._texts, "doc_id", "left").withColumn("content", content)
        return out.withColumn("word_count", word_count("content").cast("int")) \
                  .withColumn("char_count", char_count("content").cast("int")).drop("doc_id", "text")

    @cached_property
    def messages(self) -> DataFrame:
        return conform(self.with_texts(self.slim_messages), "messages")

    @cached_property
    def message_mentions(self) -> DataFrame:
        ev = self.raw("events")
        u = F.lit(self._n_authors)
        e = F.col("event_id")
        base = (F.col("user_id") * 3 + e)
        one = ev.filter((e % 20).isin(7, 8, 9)).select(e.alias("message_id"),
                                                       (base % u).alias("mentioned_user_id"))
        two = ev.filter(e % 20 == 9).select(e.alias("message_id"),
                                            ((base + 1) % u).alias("mentioned_user_id"))
        return conform(one.unionByName(two).dropDuplicates().withColumn("tenant_id", F.lit(TENANT)),
                       "message_mentions")

    @cached_property
    def reactions(self) -> DataFrame:
        ev = self.raw("events")
        u = F.lit(self._n_authors)
        e = F.col("event_id")
        r = ev.filter(e % 5 == 0).withColumn(
            "k", F.explode(F.sequence(F.lit(0), (idiv(e, 5) % 3).cast("int"))))
        k = F.col("k")
        return conform(r.select(
            F.lit(TENANT).alias("tenant_id"), e.alias("message_id"),
            ((e * 3 + k) % 24).alias("emoji_id"), ((F.col("user_id") + e + k) % u).alias("user_id"),
            (F.col("ts") + F.make_dt_interval(mins=k + 60)).alias("reacted_at"),
            (k == 2).alias("is_super_reaction")), "reactions")

    # -- service tables ---------------------------------------------------
    @cached_property
    def extraction_jobs(self) -> DataFrame:
        o = self.raw("orders")
        k, st = F.col("o_orderkey"), F.col("o_orderstatus")
        status = (F.when(st == "F", "completed")
                  .when(st == "O", F.when(k % 2 == 0, "running").otherwise("pending"))
                  .otherwise("failed"))
        return conform(o.select(
            k.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("user_id"),
            F.lit(1).alias("guild_id"), status.alias("status"), ((k % 40) * 10).alias("sync_days"),
            F.when(k % 7 == 0, F.lit(None)).otherwise(k % 1000).alias("messages_extracted"),
            F.col("o_orderdate").alias("started_at"),
            F.when(st == "F", F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(1)))
            .alias("completed_at"),
            F.when(st == "P", F.lit("rate limited")).alias("error_message")), "extraction_jobs")

    @cached_property
    def usage_logs(self) -> DataFrame:
        li = self.raw("lineitem")
        o = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        j = li.join(o, "l_orderkey")
        return conform(j.select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"),
                        F.col("l_linenumber").cast("string")).alias("id"),
            F.col("o_custkey").cast("string").alias("user_id"),
            F.when(F.col("l_returnflag") == "R", "extraction").otherwise("query").alias("action"),
            (F.col("l_partkey") * 1024).alias("storage_bytes"),
            F.col("l_shipdate").alias("created_at")), "usage_logs")

    @cached_property
    def app_users(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        plan = F.when(k % 3 == 0, "free").when(k % 3 == 1, "pro").otherwise("team")
        return conform(c.select(k.cast("string").alias("id"), plan.alias("plan")), "app_users")

    @cached_property
    def messages_resolved(self) -> DataFrame:
        from chatlens.operators.common import resolve_reply_author
        return resolve_reply_author(self.messages)

    @cached_property
    def sync_state(self) -> DataFrame:
        from chatlens.operators.ingest import sync_state_rollup
        return sync_state_rollup(self.messages)

    @cached_property
    def user_interactions(self) -> DataFrame:
        from chatlens.operators.rollups import user_interactions
        return user_interactions(self.messages_resolved, self.reactions, self.message_mentions)

    @cached_property
    def daily_stats(self) -> DataFrame:
        from chatlens.operators.rollups import daily_stats
        return daily_stats(self.messages)


def chat_tables(spark: SparkSession, sf_dir: str) -> DriverChatTables:
    return DriverChatTables(spark, sf_dir)


# ---------------------------------------------------------------------------
# The same rules as DuckDB SQL: a WITH clause that oracle queries start with.
# ---------------------------------------------------------------------------
PY_WS_RE2 = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
             r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")

ORACLE_PREFIX = f"""
WITH
users AS (
  SELECT '{TENANT}' AS tenant_id, c_custkey AS id, c_name AS username, '0' AS discriminator,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS global_name,
         CAST(NULL AS VARCHAR) AS avatar_hash, c_custkey % 12 = 11 AS is_bot,
         TIMESTAMP '{EPOCH0}' AS created_at, CAST(NULL AS TIMESTAMP) AS first_seen_at
  FROM customer),
servers AS (
  SELECT '{TENANT}' AS tenant_id, CAST(1 AS BIGINT) AS id, 'community' AS name,
         CAST(NULL AS VARCHAR) AS icon_hash, CAST(0 AS BIGINT) AS owner_id,
         CAST(count(*) AS INTEGER) AS member_count, TIMESTAMP '{EPOCH0}' AS created_at,
         TIMESTAMP '2024-01-31 00:00:00' AS first_synced_at,
         TIMESTAMP '2024-01-31 00:00:00' AS last_synced_at
  FROM customer),
channels AS (
  SELECT '{TENANT}' AS tenant_id, CAST(s_suppkey AS BIGINT) AS id, CAST(1 AS BIGINT) AS server_id,
         lower(replace(s_name, 'Supplier#', 'channel-')) AS name,
         CAST(CASE s_suppkey WHEN 5 THEN 4 WHEN 6 THEN 2 WHEN 7 THEN 5 WHEN 8 THEN 15
                             WHEN 9 THEN 13 ELSE 0 END AS INTEGER) AS type,
         CAST(NULL AS BIGINT) AS parent_id,
         CASE WHEN s_suppkey % 2 = 0 THEN 'about ' || lower(replace(s_name, 'Supplier#', 'channel-')) END
           AS topic,
         CAST(s_suppkey AS INTEGER) AS position, s_suppkey = 3 AS is_nsfw,
         TIMESTAMP '{EPOCH0}' AS created_at, false AS is_archived,
         CAST(NULL AS TIMESTAMP) AS last_synced_at
  FROM supplier),
emojis AS (
  SELECT '{TENANT}' AS tenant_id, CAST(n_nationkey AS INTEGER) AS id,
         CASE WHEN n_nationkey % 5 = 0 THEN CAST(n_nationkey + 900000 AS BIGINT) END AS discord_id,
         n_name AS name, n_nationkey % 5 = 0 AS is_custom,
         CASE WHEN n_nationkey % 5 = 0 THEN CAST(1 AS BIGINT) END AS server_id,
         n_nationkey = 10 AS is_animated
  FROM nation),
server_members AS (
  SELECT '{TENANT}' AS tenant_id, CAST(1 AS BIGINT) AS server_id, c.c_custkey AS user_id,
         CASE WHEN c.c_custkey % 4 = 0 THEN 'nick' || CAST(c.c_custkey AS VARCHAR) END AS nickname,
         f.joined_at, true AS is_active
  FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS joined_at FROM orders
                             GROUP BY o_custkey) f ON f.o_custkey = c.c_custkey),
messages_raw AS (
  SELECT e.*, d.text,
         CASE WHEN e.event_id % 20 < 7 AND e.event_id >= 25 THEN true ELSE false END AS is_reply
  FROM events e LEFT JOIN documents d
    ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)),
messages_c AS (
  SELECT *, CASE WHEN event_id % 100 = 49 THEN ''
                 WHEN event_id % 100 = 99 THEN NULL
                 ELSE text || CASE event_id % 11 WHEN 0 THEN '?' WHEN 1 THEN ' lol haha!!'
                                   WHEN 2 THEN ' https://example.org/a' ELSE '' END
            END AS content
  FROM messages_raw),
messages AS (
  SELECT '{TENANT}' AS tenant_id, event_id AS id, CAST(1 AS BIGINT) AS server_id,
         CAST(CASE WHEN event_type IN ('view', 'click') THEN 0
                   ELSE 1 + event_id % greatest(((SELECT count(*) FROM supplier) - 1) // 2, 1)
              END AS BIGINT) AS channel_id,
         CASE WHEN event_id % 500 = 499 THEN NULL ELSE user_id END AS author_id,
         content, ts AS created_at, CAST(NULL AS TIMESTAMP) AS edited_at,
         CAST(CASE WHEN is_reply THEN 19 ELSE 0 END AS INTEGER) AS message_type,
         event_id % 40 = 0 AS is_pinned, false AS is_tts,
         CASE WHEN is_reply THEN event_id - 1 - (event_id * 13) % 20 END AS reply_to_message_id,
         CAST(NULL AS BIGINT) AS reply_to_author_id, CAST(NULL AS BIGINT) AS thread_id,
         event_id % 97 = 0 AS mentions_everyone,
         CAST(CASE event_id % 20 WHEN 7 THEN 1 WHEN 8 THEN 1 WHEN 9 THEN 2 ELSE 0 END AS INTEGER)
           AS mention_count,
         CAST(CASE WHEN event_type = 'purchase' THEN event_id % 3 ELSE 0 END AS INTEGER)
           AS attachment_count,
         CAST(CASE WHEN event_id % 11 = 2 THEN 1 ELSE 0 END AS INTEGER) AS embed_count,
         false AS has_poll,
         CAST(CASE WHEN content IS NULL THEN 0 ELSE
              len(list_filter(regexp_split_to_array(content, '{PY_WS_RE2}'), lambda x: x <> ''))
              END AS INTEGER) AS word_count,
         CAST(coalesce(length(content), 0) AS INTEGER) AS char_count
  FROM messages_c),
message_mentions AS (
  SELECT DISTINCT '{TENANT}' AS tenant_id, message_id, mentioned_user_id FROM (
    SELECT event_id AS message_id,
           (user_id * 3 + event_id) % (SELECT max(user_id) + 1 FROM events) AS mentioned_user_id
    FROM events WHERE event_id % 20 IN (7, 8, 9)
    UNION ALL
    SELECT event_id, (user_id * 3 + event_id + 1) % (SELECT max(user_id) + 1 FROM events)
    FROM events WHERE event_id % 20 = 9)),
reactions AS (
  SELECT '{TENANT}' AS tenant_id, e.event_id AS message_id,
         CAST((e.event_id * 3 + r.k) % 24 AS INTEGER) AS emoji_id,
         (e.user_id + e.event_id + r.k) % (SELECT max(user_id) + 1 FROM events) AS user_id,
         e.ts + to_minutes(CAST(r.k + 60 AS BIGINT)) AS reacted_at, r.k = 2 AS is_super_reaction
  FROM events e, range(0, 3) r(k)
  WHERE e.event_id % 5 = 0 AND r.k <= (e.event_id // 5) % 3),
extraction_jobs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id,
         CAST(1 AS BIGINT) AS guild_id,
         CASE WHEN o_orderstatus = 'F' THEN 'completed'
              WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'running'
                                                 ELSE 'pending' END
              ELSE 'failed' END AS status,
         CAST((o_orderkey % 40) * 10 AS INTEGER) AS sync_days,
         CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 1000 END AS INTEGER)
           AS messages_extracted,
         o_orderdate AS started_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at,
         CASE WHEN o_orderstatus = 'P' THEN 'rate limited' END AS error_message
  FROM orders),
usage_logs AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS id,
         CAST(o.o_custkey AS VARCHAR) AS user_id,
         CASE WHEN l.l_returnflag = 'R' THEN 'extraction' ELSE 'query' END AS action,
         l.l_partkey * 1024 AS storage_bytes, l.l_shipdate AS created_at
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
messages_resolved AS (
  SELECT m.* REPLACE (coalesce(m.reply_to_author_id, o.author_id) AS reply_to_author_id)
  FROM messages m LEFT JOIN messages o ON m.reply_to_message_id = o.id),
acts AS (
  SELECT tenant_id, author_id AS doer, reply_to_author_id AS other, server_id, 'reply' AS kind, created_at AS ts
  FROM messages_resolved
  UNION ALL
  SELECT m.tenant_id, m.author_id, t.mentioned_user_id, m.server_id, 'mention', m.created_at
  FROM message_mentions t JOIN messages m ON m.id = t.message_id AND m.tenant_id = t.tenant_id
  UNION ALL
  SELECT m.tenant_id, r.user_id, m.author_id, m.server_id, 'reaction', r.reacted_at
  FROM reactions r JOIN messages m ON m.id = r.message_id AND m.tenant_id = r.tenant_id),
user_interactions AS (
  SELECT tenant_id, doer AS from_user_id, other AS to_user_id, server_id, kind AS interaction_type,
         COUNT(*) AS interaction_count, MIN(ts) AS first_interaction, MAX(ts) AS last_interaction
  FROM acts WHERE doer <> other GROUP BY ALL),
app_users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id,
         CASE c_custkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'team' END AS plan
  FROM customer)
"""


def oracle(body: str) -> str:
    """Full DuckDB query: the table rules followed by ``body``."""
    return ORACLE_PREFIX + "SELECT * FROM (\n" + body + "\n) AS q"
