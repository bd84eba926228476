"""Read-only ad-hoc SQL over a tenant's views.

The statement is parsed by Spark's own parser (no text rules). After the
checks below, every scan of the analysed plan must stand under a temporary
view of the session. The parsed
plan is walked, including CTE definitions and subqueries inside
expressions, and the statement is refused when it

* is longer than ``MAX_SQL_CHARS`` or holds more than one statement,
* contains a command (DDL, DML, SET, CACHE, ...),
* reads a relation outside the allow-list (CTE names aside), including
  path relations such as parquet.`/data`, or calls a table function,
* calls a function that reaches the JVM or the file system,
* joins two large sides without equal keys (told by the optimised plan).

``run_sql`` also stops a statement's jobs after ``TIME_LIMIT`` seconds.

Parsing happens before ``spark.sql`` because ``spark.sql`` runs commands
eagerly. The walk uses the JVM parser, so it needs a classic (non-Connect)
session.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SQL_CHARS = 10_000
DEFAULT_LIMIT = 1000
MAX_LIMIT = 10_000
SMALL_SIDE = 1_000      # rows that a side of a join without equal keys may have
TIME_LIMIT = 30         # seconds
MAX_DEPTH = 100         # steps of a recursive query; one more is an error
# Functions refused in user SQL (reflection or file access).
DENIED_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name",
                    "input_file_block_start", "input_file_block_length"}


class RefusedQuery(ValueError):
    pass


class TimedOut(TimeoutError):
    pass


def _seq(jseq):
    it = jseq.iterator()
    out = []
    while it.hasNext():
        out.append(it.next())
    return out


def _walk(jvm, plan, allowed: set[str], ctes: set[str], problems: list[str]) -> None:
    cls = plan.getClass().getName()
    simple = plan.getClass().getSimpleName()
    command = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    if command.isInstance(plan) or simple.endswith("Statement") or "Command" in simple:
        problems.append(f"statement type {simple} is not allowed")
        return
    if simple == "UnresolvedWith":
        # a name holds in the definitions after its own (in its own too, as it
        # may be recursive) and in the statement below, and nowhere else
        for pair in _seq(plan.cteRelations()):
            ctes = ctes | {pair._1().lower()}
            _walk(jvm, pair._2(), allowed, ctes, problems)
        for c in _seq(plan.children()):
            _walk(jvm, c, allowed, ctes, problems)
        return
    if simple == "UnresolvedRelation":
        parts = [p for p in _seq(plan.multipartIdentifier())]
        name = ".".join(parts).lower()
        if len(parts) != 1 or (name not in allowed and name not in ctes):
            problems.append(f"relation {'.'.join(parts)} is not allowed")
    if "TableValuedFunction" in simple or cls.endswith("UnresolvedTableValuedFunction"):
        problems.append("table functions are not allowed")
    for e in _seq(plan.expressions()):
        _walk_expr(jvm, e, allowed, ctes, problems)
    for c in _seq(plan.innerChildren()):
        if jvm.java.lang.Class.forName(
                "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan").isInstance(c):
            _walk(jvm, c, allowed, ctes, problems)
    for c in _seq(plan.children()):
        _walk(jvm, c, allowed, ctes, problems)


def _walk_expr(jvm, expr, allowed, ctes, problems) -> None:
    simple = expr.getClass().getSimpleName()
    if simple == "UnresolvedFunction":
        name = ".".join(_seq(expr.nameParts())).lower()
        if name.split(".")[-1] in DENIED_FUNCTIONS:
            problems.append(f"function {name} is not allowed")
    sub = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.SubqueryExpression")
    if sub.isInstance(expr):
        _walk(jvm, expr.plan(), allowed, ctes, problems)
    for c in _seq(expr.children()):
        _walk_expr(jvm, c, allowed, ctes, problems)


def _foreign_scans(plan) -> list[str]:
    """Leaves of an analysed plan that read data outside a temporary view."""
    simple = plan.getClass().getSimpleName()
    if simple == "View":
        return [] if plan.isTempView() else [plan.desc().identifier().toString()]
    found = []
    if not plan.children().nonEmpty() and simple not in (
            "OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef"):
        found.append(simple)
    for e in _seq(plan.subqueries()):
        found += _foreign_scans(e)
    for c in _seq(plan.children()):
        found += _foreign_scans(c)
    return found


def _costly(jvm, plan) -> list[str]:
    """Joins of an optimised plan that meet every row of one side with every
    row of the other, unless one side is known to be small."""
    found = []
    if plan.getClass().getSimpleName() == "Join":
        keys = jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys.unapply(plan)
        sides = [side.maxRows() for side in (plan.left(), plan.right())]
        if keys.isEmpty() and not any(n.isDefined() and n.get() <= SMALL_SIDE for n in sides):
            found.append("a join without equal keys of two large sides")
    for e in [*_seq(plan.subqueries()), *_seq(plan.children())]:
        found += _costly(jvm, e)
    return found


def check_sql(spark: SparkSession, sql: str, allowed: set[str]) -> list[str]:
    """Reasons to refuse ``sql`` (empty list: accepted)."""
    if not sql or not sql.strip():
        return ["empty statement"]
    if len(sql) > MAX_SQL_CHARS:
        return [f"statement longer than {MAX_SQL_CHARS} characters"]
    jvm = spark._jvm
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        plan = parser.parsePlan(sql)
    except Exception as e:  # noqa: BLE001  (parse errors come back as Py4J errors)
        msg = str(e).split("\n")[0]
        return [f"cannot parse: {msg[:200]}"]
    problems: list[str] = []
    _walk(jvm, plan, {a.lower() for a in allowed}, set(), problems)
    return problems


def row_cap(df: DataFrame, limit: int | None = DEFAULT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Cap at min(limit, 10000) rows, always (also when the SQL has its own
    LIMIT). Returns the capped frame and a one-row frame telling whether
    rows were cut (computed from at most limit + 1 rows)."""
    n = min(DEFAULT_LIMIT if limit is None else max(0, int(limit)), MAX_LIMIT)
    probe = df.limit(n + 1)
    truncated = probe.agg((F.count(F.lit(1)) > n).alias("truncated"))
    return df.limit(n), truncated


def checked_sql(session: SparkSession, sql: str, allowed: set[str] | None = None) -> DataFrame:
    """The whole result of a user's read-only SQL in a tenant session, as a
    frame that stays distributed (to be written); ``safe_sql`` caps its rows."""
    if allowed is None:
        allowed = {t.name for t in session.catalog.listTables() if t.isTemporary}
    problems = check_sql(session, sql, allowed)
    if problems:
        raise RefusedQuery("; ".join(problems))
    session.conf.set("spark.sql.cteRecursionLevelLimit", str(MAX_DEPTH))
    df = session.sql(sql)
    foreign = _foreign_scans(df._jdf.queryExecution().analyzed())
    if foreign:
        raise RefusedQuery(f"reads outside the tenant's views: {', '.join(sorted(set(foreign)))}")
    costly = _costly(session._jvm, df._jdf.queryExecution().optimizedPlan())
    if costly:
        raise RefusedQuery("; ".join(sorted(set(costly))))
    return df


def safe_sql(session: SparkSession, sql: str, allowed: set[str] | None = None,
             limit: int | None = DEFAULT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Run a user's read-only SQL in a tenant session (``tenant_session``)."""
    return row_cap(checked_sql(session, sql, allowed), limit)


def run_sql(session: SparkSession, sql: str, allowed: set[str] | None = None, limit: int | None = DEFAULT_LIMIT,
            seconds: float = TIME_LIMIT) -> tuple[list, bool]:
    """The rows of a user's statement (at most ``MAX_LIMIT``) and whether some
    were cut. Its jobs carry a tag, by which they are cancelled when the time is up."""
    safe_sql(session, sql, allowed, limit)      # raises where the statement is refused
    n = min(DEFAULT_LIMIT if limit is None else max(0, int(limit)), MAX_LIMIT)
    sc, tag, late = session.sparkContext, f"user-sql-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        sc.cancelJobsWithTag(tag)

    whole = session.sql(sql).limit(n + 1)       # one row more tells whether some are cut
    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        rows = whole.collect()
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"stopped after {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    return rows[:n], len(rows) > n


def list_tables(session: SparkSession, visible=None) -> list[str]:
    """Names of the user-visible tables of a tenant session, sorted."""
    from chatlens.plans.tenant import VISIBLE
    names = {t.name for t in session.catalog.listTables() if t.isTemporary}
    return sorted(n for n in names if n in set(visible or VISIBLE))


def tables_with_rows(session: SparkSession, names: list[str]) -> DataFrame:
    """name, row_count of each table: one grouped count, all in one job."""
    from functools import reduce
    return reduce(DataFrame.unionByName, [
        session.table(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("name"), "row_count")
        for n in names])


def table_schema(session: SparkSession, names: list[str]) -> DataFrame:
    """Columns, types and positions of each table plus its row count; one
    job unions the counts."""
    from functools import reduce
    rows = []
    counts = []
    for n in names:
        df = session.table(n)
        for i, f in enumerate(df.schema.fields, 1):
            if f.name == "tenant_id":
                continue
            rows.append((n, f.name, f.dataType.simpleString(), i))
        counts.append(df.agg(F.count(F.lit(1)).alias("row_count"))
                      .select(F.lit(n).alias("table"), "row_count"))
    cols = session.createDataFrame(rows, "table string, column string, type string, position int")
    cnt = reduce(DataFrame.unionByName, counts)
    return cols.join(cnt, "table")
