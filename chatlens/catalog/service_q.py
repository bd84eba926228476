"""Registered roll-up, tenant, ad-hoc SQL, export, usage and text queries
(SURVEY §2.3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.catalog.base import ratio, register
from chatlens.functions.text import SENSITIVE_PATTERNS, scrub_text
from chatlens.operators import replies as R
from chatlens.operators import rollups as RU
from chatlens.operators import usage as US
from chatlens.operators.users import top_users
from chatlens.plans import bundle, exports, sql_gate, tenant
from chatlens.sources.fixtures import TENANT

USAGE_AS_OF = "1998-08-15 00:00:00"
SQL_USAGE_MONTH = "TIMESTAMP '1998-08-01 00:00:00'"


@register("user_interactions", """
SELECT tenant_id, from_user_id, to_user_id, server_id, interaction_type,
       CAST(interaction_count AS BIGINT) AS interaction_count, first_interaction, last_interaction
FROM user_interactions""")
def _user_interactions(t):
    return RU.user_interactions(t.messages_resolved, t.reactions, t.message_mentions)


@register("daily_stats", f"""
SELECT tenant_id, date_trunc('day', created_at) AS day, server_id, channel_id, author_id,
       COUNT(*) AS message_count, COUNT(DISTINCT reply_to_author_id) AS unique_users_replied_to,
       COUNT(CASE WHEN reply_to_message_id IS NOT NULL THEN 1 END) AS reply_count,
       CAST(SUM(coalesce(word_count, 0)) AS BIGINT) AS total_words,
       {ratio('SUM(coalesce(word_count, 0))', 'COUNT(*)', 6)} AS avg_words_per_message
FROM messages_resolved GROUP BY tenant_id, 2, server_id, channel_id, author_id""")
def _daily_stats(t):
    return RU.daily_stats(t.messages_resolved)


_SCOPED = ["servers", "users", "server_members", "channels", "messages", "message_mentions", "emojis", "reactions",
           "user_interactions", "daily_stats"]
_DAILY_SQL = """(SELECT tenant_id, CAST(created_at AS DATE) AS day, server_id, channel_id, author_id
                 FROM messages GROUP BY ALL)"""


@register("tenant_scope", " UNION ALL ".join(
    f"SELECT 'own' AS which, '{n}' AS name, COUNT(*) AS n FROM {_DAILY_SQL if n == 'daily_stats' else n} x "
    f"WHERE tenant_id = '{TENANT}' UNION ALL SELECT 'other', '{n}', COUNT(*) "
    f"FROM {_DAILY_SQL if n == 'daily_stats' else n} y UNION ALL SELECT 'unknown', '{n}', 0 "
    f"UNION ALL SELECT 'unset', '{n}', 0" for n in _SCOPED))
def _tenant_scope(t):
    """Rows of each table that two tenants with the same ids, an unknown one
    and an unset one see."""
    second = "user_othertenant9"
    both = {n: t[n].unionByName(t[n].withColumn("tenant_id", F.lit(second))) for n in _SCOPED}
    parts = []
    for which, who in (("own", TENANT), ("other", second), ("unknown", "user_nobodyhere00"), ("unset", None)):
        for name, df in tenant.tenant_scope(both, who).items():
            parts.append(df.agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(which).alias("which"), F.lit(name.removesuffix("_secure")).alias("name"), "n"))
    return reduce(DataFrame.unionByName, parts)


@register("validate_tenant_id", """
SELECT candidate, coalesce(regexp_full_match(candidate, 'user_[a-zA-Z0-9]{10,50}'), false) AS is_valid
FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'user_' || CAST(c_custkey AS VARCHAR)
                                WHEN 1 THEN 'user_' || replace(c_name, '#', '')
                                ELSE 'user_' || c_name END AS candidate FROM customer)""")
def _validate_tenant_id(t):
    c = t.raw("customer")
    k = F.col("c_custkey")
    cand = (F.when(k % 3 == 0, F.concat(F.lit("user_"), k.cast("string")))
            .when(k % 3 == 1, F.concat(F.lit("user_"), F.replace(F.col("c_name"), F.lit("#"), F.lit(""))))
            .otherwise(F.concat(F.lit("user_"), F.col("c_name"))))
    return tenant.validate_tenant_id(c.select(cand.alias("candidate")), "candidate")


@register("safe_sql", f"""
WITH c AS (SELECT channel_id, COUNT(*) AS n FROM messages WHERE tenant_id = '{TENANT}' GROUP BY channel_id)
SELECT * FROM c ORDER BY n DESC, channel_id LIMIT 1000""")
def _safe_sql(t):
    s = tenant.tenant_session(t.spark, {"messages": t.messages, "users": t.users}, TENANT)
    df, _ = sql_gate.safe_sql(
        s, "WITH c AS (SELECT channel_id, COUNT(*) AS n FROM messages GROUP BY channel_id) "
           "SELECT * FROM c ORDER BY n DESC, channel_id", limit=1000)
    return df


@register("row_cap", """
SELECT * EXCLUDE (content), length(content) AS size, (SELECT COUNT(*) > 100 FROM messages) AS truncated
FROM messages ORDER BY id LIMIT 100""")
def _row_cap(t):
    df, truncated = sql_gate.row_cap(t.messages.orderBy("id"), 100)
    return df.withColumn("size", F.length("content").cast("long")).drop("content") \
        .withColumn("truncated", truncated.scalar())


_LISTED = ["channels", "emojis", "message_mentions", "messages", "reactions", "server_members", "servers",
           "sync_state", "users"]
_SYNC_SQL = "(SELECT DISTINCT server_id, channel_id FROM messages)"


def _rows_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, COUNT(*) AS row_count FROM "
                              f"{_SYNC_SQL if n == 'sync_state' else n} x" for n in _LISTED)


def _editor(t):
    """A session of the SQL editor with all nine tables of the tenant."""
    return tenant.tenant_session(t.spark, {n: t[n] for n in _LISTED}, TENANT)


def _table_schema_sql():
    from chatlens.sources.schema import SCHEMAS
    vals = []
    for n in _LISTED:
        visible = [f for f in SCHEMAS[n].fields if f.name != "tenant_id"]
        for i, f in enumerate(visible, 1):
            vals.append(f"('{n}', '{f.name}', '{f.dataType.simpleString()}', {i})")
    return (f"SELECT v.\"table\", v.\"column\", v.type, CAST(v.position AS INTEGER) AS position, "
            f"c.row_count FROM (VALUES {', '.join(vals)}) v(\"table\", \"column\", type, position) "
            f"JOIN ({_rows_sql()}) c ON c.name = v.\"table\"")


@register("table_schema", _table_schema_sql())
def _table_schema(t):
    s = _editor(t)
    return sql_gate.table_schema(s, sql_gate.list_tables(s))


@register("sql_set_operations", """
SELECT author_id FROM messages WHERE author_id IS NOT NULL
  INTERSECT SELECT mentioned_user_id FROM message_mentions
  EXCEPT SELECT r.user_id FROM reactions r WHERE r.emoji_id = 3""")
def _sql_set_operations(t):
    """Authors who were mentioned and never used an emoji, as user SQL; the
    whole result, as a frame that stays distributed."""
    return sql_gate.checked_sql(_editor(t), """
        SELECT author_id FROM messages WHERE author_id IS NOT NULL
        INTERSECT SELECT mentioned_user_id FROM message_mentions
        EXCEPT SELECT user_id FROM reactions WHERE emoji_id = 3""")


@register("sql_thread_depth", """
WITH RECURSIVE thread(id, depth) AS (
  SELECT id, 0 FROM messages WHERE reply_to_message_id IS NULL
  UNION ALL SELECT m.id, depth + 1 FROM thread JOIN messages m ON m.reply_to_message_id = thread.id)
SELECT CAST(depth AS INTEGER) AS depth, COUNT(*) AS messages FROM thread GROUP BY ALL""")
def _sql_thread_depth(t):
    """How deep replies are nested, as user SQL over the depths of all messages
    of the tenant; the whole result. The recursion itself is done by doubling
    (``thread_depths``), as threads may be far deeper than the ``MAX_DEPTH``
    steps of a user's own recursive query."""
    s = _editor(t)
    R.thread_depths(s.table("messages")).createOrReplaceTempView("thread")
    return sql_gate.checked_sql(
        s, "SELECT CAST(depth AS INT) AS depth, SUM(n) AS messages FROM thread GROUP BY depth")


@register("sql_functions", """
SELECT channel_id, date_diff('second', min(created_at), max(created_at)) AS seconds, strftime(min(created_at), '%Y-%m') AS month,
       string_agg(DISTINCT CAST(message_type AS VARCHAR), ',' ORDER BY CAST(message_type AS VARCHAR)) AS kinds
FROM messages GROUP BY channel_id""")
def _sql_functions(t):
    df, _ = sql_gate.safe_sql(_editor(t), """
        SELECT channel_id, CAST(EXTRACT(DAY FROM a) * 86400 + EXTRACT(HOUR FROM a) * 3600
                 + EXTRACT(MINUTE FROM a) * 60 + floor(EXTRACT(SECOND FROM a)) AS BIGINT) AS seconds, month, kinds
        FROM (SELECT channel_id, age(date_trunc('SECOND', max(created_at)), date_trunc('SECOND', min(created_at))) AS a,
                     to_char(min(created_at), 'yyyy-MM') AS month,
                     string_agg(DISTINCT CAST(message_type AS STRING), ',') WITHIN GROUP (ORDER BY CAST(message_type AS STRING)) AS kinds
              FROM messages GROUP BY channel_id)""")
    return df


_MD_BODY = """
SELECT '| ' || username || ' | ' || coalesce(global_name, '_null_') || ' | ' ||
       CAST(message_count AS VARCHAR) || ' |' AS line
FROM (SELECT u.username, u.global_name, COUNT(m.id) AS message_count
      FROM users u LEFT JOIN messages m ON u.id = m.author_id
      GROUP BY u.id, u.username, u.global_name ORDER BY message_count DESC, u.id LIMIT 10)
UNION ALL SELECT '| username | global_name | message_count |'
UNION ALL SELECT '| --- | --- | --- |'"""


@register("export_markdown", _MD_BODY)
def _export_markdown(t):
    return exports.markdown_lines(top_users(t.users, t.messages)).select("line")


def _sql_scrub():
    cur = "text"
    counts = []
    for pat, tag in SENSITIVE_PATTERNS:
        counts.append(f"len(regexp_extract_all({cur}, '(?i){pat}'))")
        cur = f"regexp_replace({cur}, '(?i){pat}', '{tag}', 'g')"
    return cur, " + ".join(f"coalesce({c}, 0)" for c in counts)


_SCRUBBED, _HITS = _sql_scrub()


@register("scrub_text", f"""
SELECT doc_id, {_SCRUBBED} AS scrubbed, CAST({_HITS} AS BIGINT) AS n_hits FROM documents""")
def _scrub_text(t):
    d = t.raw("documents").select("doc_id", "text")
    return scrub_text(d, "text").select("doc_id", "scrubbed", "n_hits")


@register("usage_this_month", f"""
WITH u AS (SELECT user_id, COUNT(CASE WHEN action = 'query' AND created_at >= {SQL_USAGE_MONTH} THEN 1 END) AS q,
                  CAST(coalesce(SUM(storage_bytes), 0) AS BIGINT) AS b FROM usage_logs GROUP BY user_id),
j AS (SELECT user_id, COUNT(*) AS e FROM extraction_jobs WHERE started_at >= {SQL_USAGE_MONTH} GROUP BY user_id),
x AS (SELECT a.id AS user_id, a.plan, coalesce(u.q, 0) AS queries_this_month,
             CASE a.plan WHEN 'free' THEN 1000 WHEN 'pro' THEN 999999 WHEN 'team' THEN 999999 ELSE 1000 END
               AS queries_limit,
             coalesce(j.e, 0) AS extractions_this_month, coalesce(u.b, 0) AS b,
             CASE a.plan WHEN 'free' THEN 500 WHEN 'pro' THEN 5000 WHEN 'team' THEN 25000 ELSE 500 END
               AS storage_limit_mb
      FROM app_users a LEFT JOIN u ON u.user_id = a.id LEFT JOIN j ON j.user_id = a.id)
SELECT user_id, plan, queries_this_month, queries_limit, extractions_this_month,
       {ratio('b', '1048576', 2)} AS storage_used_mb, storage_limit_mb,
       least({ratio('b', 'CAST(storage_limit_mb AS BIGINT) * 1048576', 1, 100)}, 100.0) AS storage_pct
FROM x""")
def _usage_this_month(t):
    return US.usage_this_month(t.usage_logs, t.extraction_jobs, t.app_users, as_of=USAGE_AS_OF)


@register("over_quota", f"""
WITH q AS (SELECT user_id, COUNT(*) AS n FROM usage_logs
           WHERE action = 'query' AND created_at >= {SQL_USAGE_MONTH} GROUP BY user_id),
d AS (SELECT user_id, MAX(sync_days) AS mx FROM extraction_jobs GROUP BY user_id),
x AS (SELECT a.id AS user_id, a.plan, coalesce(q.n, 0) AS queries_this_month, d.mx AS max_sync_days_requested,
             a.plan = 'free' AND coalesce(q.n, 0) >= 1000 AS query_limit_reached,
             coalesce(d.mx > CASE a.plan WHEN 'free' THEN 30 WHEN 'pro' THEN 365 WHEN 'team' THEN 9999
                                         ELSE 30 END, false) AS sync_days_exceeded
      FROM app_users a LEFT JOIN q ON q.user_id = a.id LEFT JOIN d ON d.user_id = a.id)
SELECT * FROM x WHERE query_limit_reached OR sync_days_exceeded""")
def _over_quota(t):
    return US.over_quota(t.usage_logs, t.extraction_jobs, t.app_users, as_of=USAGE_AS_OF)


@register("job_history", """
SELECT user_id, id, status, CAST(guild_id AS VARCHAR) AS guild_id, sync_days,
       coalesce(messages_extracted, 0) AS messages_extracted, started_at, completed_at, error_message
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY started_at DESC, id DESC) AS rn
      FROM extraction_jobs) WHERE rn <= 3""")
def _job_history(t):
    return US.job_history(t.extraction_jobs, k=3)


@register("active_jobs", """
SELECT user_id, COUNT(*) AS n FROM extraction_jobs WHERE status IN ('pending', 'running') GROUP BY user_id""")
def _active_jobs(t):
    return US.active_jobs(t.extraction_jobs)


@register("job_retention", """
SELECT * FROM extraction_jobs
WHERE completed_at IS NULL OR completed_at >= TIMESTAMP '1998-08-15 00:00:00' - INTERVAL 30 DAY""")
def _job_retention(t):
    return US.job_retention(t.extraction_jobs, as_of=USAGE_AS_OF, days=30)


def _bundle_sql():
    from chatlens.catalog.base import REGISTRY
    same = {"overview": "overview", "hourly_activity": "hourly_activity_filled",
            "top_channels": "top_channels_detail", "top_users": "top_users_detail",
            "user_interactions": "interaction_pairs", "content_metrics": "content_metrics",
            "engagement_metrics": "engagement_metrics", "channel_growth": "channel_growth_window"}
    parts = [f"SELECT '{k}' AS result, COUNT(*) AS rows FROM ({REGISTRY[v].body}) x"
             for k, v in same.items()]
    parts.append("SELECT 'messages_over_time', COUNT(DISTINCT CAST(created_at AS DATE)) FROM messages "
                 "WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
    parts.append("SELECT 'day_of_week_activity', 7")
    parts.append("SELECT 'bot_vs_human', 1")
    return " UNION ALL ".join(parts)


@register("analytics_bundle", _bundle_sql())
def _analytics_bundle(t):
    b = bundle.analytics_bundle(t, as_of="2024-01-31 00:00:00", days=7, cache=False)
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("result"), "rows")
             for name, df in b.items() if not name.startswith("_")]
    return reduce(DataFrame.unionByName, parts)


def _bundle_parts() -> dict[str, str]:
    """The dashboard's results by content: bodies of the operators behind them,
    with the dashboard's window of seven days."""
    from chatlens.catalog.base import REGISTRY, since
    same = {"overview": "overview", "hourly_activity": "hourly_activity_filled",
            "top_channels": "top_channels_detail", "top_users": "top_users_detail",
            "content_metrics": "content_metrics", "engagement_metrics": "engagement_metrics",
            "channel_growth": "channel_growth_window"}
    parts = {k: REGISTRY[v].body for k, v in same.items()}
    parts["day_of_week_activity"] = REGISTRY["weekday_filled"].body.replace(since(3), since(7))
    parts["messages_over_time"] = REGISTRY["timeline"].body.replace(since(30), since(7))
    parts["bot_vs_human"] = REGISTRY["bot_vs_human_pivot"].body.replace(since(30), since(7))
    # the bundle takes messages as stored, where no reply author is filled in
    parts["user_interactions"] = REGISTRY["interaction_pairs"].body.replace("messages_resolved", "messages")
    parts["top_users"] = parts["top_users"].replace("messages_resolved", "messages")
    return parts


def _bundle_part(name: str):
    return lambda t: bundle.analytics_bundle(t, as_of="2024-01-31 00:00:00", days=7, cache=False,
                                             names=[name])[name]


for _name, _body in _bundle_parts().items():
    register(f"bundle_{_name}", _body)(_bundle_part(_name))


def _top_users_small(t):
    return top_users(t.users, t.messages)


_TOP_USERS_SQL = """(SELECT u.username, u.global_name, COUNT(m.id) AS message_count
      FROM users u LEFT JOIN messages m ON u.id = m.author_id
      GROUP BY u.id, u.username, u.global_name ORDER BY message_count DESC, u.id LIMIT 10)"""


@register("export_csv", f"""
SELECT username || ',' || coalesce(global_name, '') || ',' || CAST(message_count AS VARCHAR) AS value
FROM {_TOP_USERS_SQL} UNION ALL SELECT 'username,global_name,message_count'""")
def _export_csv(t):
    from chatlens.session import shared_scratch
    path = shared_scratch(t.spark, "export")
    exports.export_csv(_top_users_small(t).coalesce(1), path)
    return t.spark.read.text(path)


@register("export_tsv", f"""
SELECT username || chr(9) || coalesce(global_name, '') || chr(9) || CAST(message_count AS VARCHAR) AS value
FROM {_TOP_USERS_SQL} UNION ALL SELECT 'username' || chr(9) || 'global_name' || chr(9) || 'message_count'""")
def _export_tsv(t):
    from chatlens.session import shared_scratch
    path = shared_scratch(t.spark, "export")
    exports.export_tsv(_top_users_small(t).coalesce(1), path)
    return t.spark.read.text(path)


@register("export_json", f"""
SELECT CAST(to_json(struct_pack(username := username, global_name := global_name,
                                message_count := message_count)) AS VARCHAR) AS value
FROM {_TOP_USERS_SQL}""")
def _export_json(t):
    from chatlens.session import shared_scratch
    path = shared_scratch(t.spark, "export")
    exports.export_json(_top_users_small(t), path)
    return t.spark.read.text(path)


_AWKWARD = "' \"' || coalesce(text, '') || chr(10) || 'a,b' || chr(9) || 'c|d '"


def _read_back(t, export, **options):
    """Every document's text between signs that a row must not break on,
    exported and read again."""
    from chatlens.session import shared_scratch
    path = shared_scratch(t.spark, "export")
    text = F.concat(F.lit(' "'), F.coalesce("text", F.lit("")), F.lit("\na,b\tc|d "))
    export(t.raw("documents").select("doc_id", text.alias("text"), F.array("lang").alias("langs")), path)
    return t.spark.read.csv(path, schema="doc_id long, text string, langs string", header=True, quote='"',
                            escape='"', multiLine=True, **options)


_READ_BACK = f"""SELECT doc_id, {_AWKWARD} AS text, if(lang IS NULL, '[null]', '["' || lang || '"]') AS langs
FROM documents"""


@register("export_csv_read_back", _READ_BACK)
def _export_csv_read_back(t):
    return _read_back(t, exports.export_csv)


@register("export_tsv_read_back", _READ_BACK)
def _export_tsv_read_back(t):
    return _read_back(t, exports.export_tsv, sep="\t")


@register("export_json_read_back", f"SELECT doc_id, {_AWKWARD} AS text FROM documents")
def _export_json_read_back(t):
    from chatlens.session import shared_scratch
    path = shared_scratch(t.spark, "export")
    text = F.concat(F.lit(' "'), F.coalesce("text", F.lit("")), F.lit("\na,b\tc|d "))
    exports.export_json(t.raw("documents").select("doc_id", text.alias("text")), path)
    return t.spark.read.json(path, schema="doc_id long, text string")


@register("export_markdown_texts", """
SELECT '| ' || CAST(doc_id AS VARCHAR) || ' | ' || replace(replace(text || '|', '|', '\\|'), chr(10), ' ') || ' |' AS line
FROM documents WHERE text IS NOT NULL
UNION ALL SELECT '| ' || CAST(doc_id AS VARCHAR) || ' | _null_ |' FROM documents WHERE text IS NULL
UNION ALL SELECT '| doc_id | text |' UNION ALL SELECT '| --- | --- |'""")
def _export_markdown_texts(t):
    return exports.markdown_lines(t.raw("documents").select(
        "doc_id", F.concat("text", F.lit("|")).alias("text"))).select("line")


@register("list_tables", _rows_sql())
def _list_tables(t):
    s = _editor(t)
    return sql_gate.tables_with_rows(s, sql_gate.list_tables(s))


@register("refresh_rollups", f"""
SELECT tenant_id, date_trunc('day', created_at) AS day, server_id, channel_id, author_id,
       COUNT(*) AS message_count, COUNT(DISTINCT reply_to_author_id) AS unique_users_replied_to,
       COUNT(CASE WHEN reply_to_message_id IS NOT NULL THEN 1 END) AS reply_count,
       CAST(SUM(coalesce(word_count, 0)) AS BIGINT) AS total_words,
       {ratio('SUM(coalesce(word_count, 0))', 'COUNT(*)', 6)} AS avg_words_per_message
FROM messages_resolved GROUP BY tenant_id, 2, server_id, channel_id, author_id""")
def _refresh_rollups(t):
    from chatlens.plans.store import read_table, refresh_rollups
    from chatlens.session import shared_scratch
    root = shared_scratch(t.spark, "rollups")
    paths = refresh_rollups(t.messages_resolved, t.reactions, t.message_mentions, root)
    return read_table(t.spark, paths["daily_stats"]).select(
        "tenant_id", "day", "server_id", "channel_id", "author_id", "message_count",
        "unique_users_replied_to", "reply_count", "total_words", "avg_words_per_message")


@register("refresh_rollups_interactions", """
SELECT tenant_id, from_user_id, to_user_id, server_id, interaction_type,
       CAST(interaction_count AS BIGINT) AS interaction_count, first_interaction, last_interaction
FROM user_interactions""")
def _refresh_rollups_interactions(t):
    """The other roll-up of a refresh, as it is stored."""
    from chatlens.plans.store import read_table, refresh_rollups
    from chatlens.session import shared_scratch
    root = shared_scratch(t.spark, "rollups")
    paths = refresh_rollups(t.messages_resolved, t.reactions, t.message_mentions, root)
    return read_table(t.spark, paths["user_interactions"]).select(
        "tenant_id", "from_user_id", "to_user_id", "server_id", "interaction_type", "interaction_count",
        "first_interaction", "last_interaction")
