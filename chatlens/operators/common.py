"""Helpers shared by the operator families.

Nothing here runs an action; every helper returns a lazy DataFrame or Column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.functions.columns import round_ratio

AsOf = "str | dt.datetime | Column | None"


def as_of_col(as_of=None) -> Column:
    """The end of a time window: a literal, or now (UTC) when not given."""
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def since(as_of, days: int) -> Column:
    return as_of_col(as_of) - F.make_dt_interval(days=F.lit(int(days)))


def in_window(ts: Column | str, as_of, days: int, strict: bool = False) -> Column:
    """``ts >= as_of - days`` (API form) or ``>`` (library form); no upper bound."""
    t = F.col(ts) if isinstance(ts, str) else ts
    start = since(as_of, days)
    return t > start if strict else t >= start


def humans(users: DataFrame) -> DataFrame:
    return users.filter(~F.coalesce(F.col("is_bot"), F.lit(False)))


def top_k(df: DataFrame, order: Sequence[Column], k: int | None) -> DataFrame:
    """Order and keep the first k rows (TakeOrderedAndProject: per-partition
    top-k, then a k-row merge); ``k=None`` keeps every row."""
    out = df.orderBy(*order)
    return out if k is None else out.limit(k)


def narrow(messages: DataFrame) -> DataFrame:
    """Messages without their text: what a top k is taken on."""
    return messages.drop("content")


def with_content(top: DataFrame, messages: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The few rows of a top k with their texts, fetched by (tenant, id) and
    put in order again. The k rows go to the texts, no text is shuffled to them."""
    key = [c for c in ("tenant_id", "id") if c in top.columns and c in messages.columns]
    return top.join(messages.select(*key, "content"), key).orderBy(*order)


def total_of(df: DataFrame, expr: Column) -> Column:
    """Scalar subquery over ``df`` (one aggregate row; no window over all rows)."""
    return df.agg(expr).scalar()


def share(num: Column, den: Column, digits: int = 1) -> Column:
    """Percentage ``round(100 * num / den, digits)`` computed exactly."""
    return round_ratio(num, den, digits=digits, scale=100)


def pair_key(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.least(a, b), F.greatest(a, b)


def resolve_reply_author(messages: DataFrame) -> DataFrame:
    """Fill ``reply_to_author_id`` from the replied-to message when missing.

    Only replies are joined: the reply side is pre-filtered to non-NULL
    targets and the target side is pruned to (tenant, id, author). Two tenants
    may hold the same server, so the join is on (tenant, message id); a layout
    bucketed by these shuffles only the replies. Replies to unknown messages
    keep NULL.
    """
    targets = messages.select(F.col("tenant_id").alias("_t_tenant"), F.col("id").alias("_t_id"),
                              F.col("author_id").alias("_t_author"))
    replies = messages.filter(F.col("reply_to_message_id").isNotNull())
    plain = messages.filter(F.col("reply_to_message_id").isNull())
    j = replies.join(targets, (F.col("tenant_id") == F.col("_t_tenant"))
                     & (F.col("reply_to_message_id") == F.col("_t_id")), "left")
    j = j.withColumn("reply_to_author_id",
                     F.coalesce(F.col("reply_to_author_id"), F.col("_t_author"))) \
         .drop("_t_tenant", "_t_id", "_t_author")
    return plain.unionByName(j)


def reply_edges(messages: DataFrame) -> DataFrame:
    """(reply id, replier, replied-to author, reply time, target time) for
    replies whose target message exists. Self-join on (tenant, message id);
    both sides pruned to the few columns needed. With messages bucketed by
    these only the reply side shuffles."""
    r = messages.filter(F.col("reply_to_message_id").isNotNull()).select(
        "tenant_id", F.col("id").alias("reply_id"), F.col("author_id").alias("replier_id"),
        F.col("reply_to_message_id"), F.col("created_at").alias("reply_at"),
        F.col("channel_id"))
    o = messages.select("tenant_id", F.col("id").alias("reply_to_message_id"),
                        F.col("author_id").alias("original_author_id"),
                        F.col("created_at").alias("original_at"))
    return r.join(o, ["tenant_id", "reply_to_message_id"])


def adjacent(df: DataFrame, part: Sequence[str], ts: str, tiebreak: str,
             cols: Sequence[str], which: str = "prev", bucket: str = "hour",
             prefix: str | None = None) -> DataFrame:
    """Values of the previous (``which='prev'``) or next row of the same
    ``part`` in (ts, tiebreak) order, as ``<prefix><col>`` columns.

    Skew-safe form of ``lag``/``lead`` over ``partitionBy(part)``: a hot
    partition (one channel holding a third of all rows) would land in one
    task. Rows are windowed by (part, time bucket) instead. The same window
    pass marks each bucket's last (first) row; those edge rows, one per
    non-empty bucket, are windowed by ``part`` alone to find the neighbouring
    bucket's edge, and joined back on (part, bucket) — the partitioning the
    big side already has, so it is not shuffled again. Rows whose key is
    NULL are linked within their bucket only.
    """
    prefix = prefix or ("prev_" if which == "prev" else "next_")
    part = list(part)
    b = "_bucket"
    d = df.withColumn(b, F.date_trunc(bucket, F.col(ts)))
    w = Window.partitionBy(*part, b).orderBy(F.col(ts), F.col(tiebreak))
    need = list(dict.fromkeys(list(cols) + [tiebreak]))
    shift, other = (F.lag, F.lead) if which == "prev" else (F.lead, F.lag)
    for c in need:
        d = d.withColumn(prefix + c, shift(F.col(c)).over(w))
    # the row at the far end of the bucket (no neighbour inside it on the
    # other side) carries the bucket's edge values
    d = d.withColumn("_far", other(F.col(tiebreak)).over(w).isNull())
    edges = d.filter(F.col("_far")).select(*part, b, F.struct(*[F.col(c) for c in need]).alias("_e"))
    wb = Window.partitionBy(*part).orderBy(b)
    edges = edges.select(*part, b, shift(F.col("_e")).over(wb).alias("_carry"))
    d = d.join(edges, part + [b], "left")
    at_edge = F.col(prefix + tiebreak).isNull()
    for c in need:
        d = d.withColumn(prefix + c, F.when(at_edge, F.col("_carry")[c])
                         .otherwise(F.col(prefix + c)))
    drop = [b, "_far", "_carry"]
    if tiebreak not in cols:
        drop.append(prefix + tiebreak)
    return d.drop(*drop)


def rank_desc(df: DataFrame, metric: str, out: str = "rank") -> DataFrame:
    """SQL ``rank()`` by ``metric`` descending over all rows, without a
    single-partition window: rank = 1 + rows with a larger metric, found by
    a histogram of metric values (one row per distinct value) and a running
    sum over it."""
    hist = df.groupBy(metric).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(F.col(metric).desc()).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn(out, F.coalesce(F.sum("_n").over(w), F.lit(0)) + 1).drop("_n")
    return df.join(hist, metric, "left")


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    salts: int = 64, salt_cols: Sequence[str] | None = None) -> DataFrame:
    """First k rows of each group in ``order``, without one task per group.

    Two rounds: the top k inside (group, salt) buckets, then the top k of
    each group over at most ``salts * k`` survivors. A hot group is spread
    over ``salts`` tasks in the first round; the result is exact because a
    group's top k lies inside the union of its buckets' top k."""
    # a deterministic salt (task retries see the same split); hash a key
    # such as the row id rather than every column
    salt = F.pmod(F.xxhash64(*(salt_cols or df.columns)), F.lit(salts))
    d = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    d = d.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return d.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= k).drop("_r")
