"""Semantics that decide correctness and dashboard shape."""

import datetime as dt

from pyspark.sql import functions as F

from chatlens.operators.common import in_window
from chatlens.plans.bundle import analytics_bundle


def test_window_bounds_inclusive_and_strict(spark):
    as_of = "2024-01-31 00:00:00"
    edge = dt.datetime(2024, 1, 24)                      # exactly as_of - 7 days
    df = spark.createDataFrame([(edge,), (edge + dt.timedelta(microseconds=1),),
                                (dt.datetime(2030, 1, 1),)], "t timestamp") \
        .select(F.col("t").cast("timestamp_ntz").alias("t"))
    api = df.filter(in_window("t", as_of, 7)).count()
    lib = df.filter(in_window("t", as_of, 7, strict=True)).count()
    assert (api, lib) == (3, 2)                          # no upper bound: the future row counts


def test_dashboard_bundle_shape(small):
    b = analytics_bundle(small, as_of="2024-01-31 00:00:00", days=7)
    try:
        assert len([k for k in b if not k.startswith("_")]) == 11
        hours = b["hourly_activity"].collect()
        assert [r.hour for r in hours] == list(range(24))
        days = b["day_of_week_activity"].collect()
        assert [r.day for r in days] == list(range(7)) and days[0].day_name == "Sunday"
        assert b["overview"].count() == 1 and b["engagement_metrics"].count() == 1
    finally:
        b["_window"].unpersist()


def test_empty_window_gives_zeros(small):
    b = analytics_bundle(small, as_of="2030-01-01 00:00:00", days=1, cache=False)
    assert all(r.message_count == 0 for r in b["hourly_activity"].collect())
    o = b["overview"].first()
    assert (o.total_messages, o.messages_change_percent, o.avg_message_length) == (0, 0.0, 0.0)
    p = b["bot_vs_human"].first()
    assert (p.human_messages, p.human_percentage) == (0, 0.0)
    try:
        analytics_bundle(small, days=0)
        raise AssertionError("days=0 accepted")
    except ValueError:
        pass


def test_tie_breaks_are_by_id(small):
    """Equal counts order by id, so top-k lists are deterministic."""
    from chatlens.operators.users import top_users
    got = [r.message_count for r in top_users(small.users, small.messages, k=None).collect()]
    assert got == sorted(got, reverse=True)


def test_report_of_humans_has_no_bot_in_any_section(spark, small):
    from chatlens.plans.report import year_report
    bots = {r.username for r in small.users.filter("is_bot").collect()}
    lines = [r.text for r in year_report(small, humans_only=True).collect()]
    assert len(lines) > 20 and not [x for x in lines for b in bots if b in x]
    human = small.messages.join(small.users.filter("NOT is_bot").selectExpr("id AS author_id"), "author_id").count()
    alone = small.messages.filter("author_id IS NULL").count()
    assert any(f"messages {human + alone}," in x for x in lines)


def test_longest_gap_lies_within_or_between_days(spark):
    """Gaps within a day, over midnight, over days, of equal times, and of a
    user who writes on one day only."""
    import datetime as dt

    from chatlens.operators.users import ghost_gap
    at = {1: [(1, 0), (1, 23), (2, 1)], 2: [(1, 1), (1, 2), (1, 9)], 3: [(1, 23), (2, 0), (9, 0), (9, 20)],
          4: [(5, 5), (5, 5)], 5: [(1, 0)], 6: [(1, 0), (1, 12), (1, 18), (3, 0), (5, 0), (5, 20)]}
    rows = [(100 * u + k, u, dt.datetime(2024, 1, day, hour)) for u, times in at.items()
            for k, (day, hour) in enumerate(times)]
    m = spark.createDataFrame(rows, "id long, author_id long, created_at timestamp_ntz")
    u = spark.createDataFrame([(k, f"u{k}", False) for k in at], "id long, username string, is_bot boolean")
    got = {r.username: r.longest_absence_days for r in ghost_gap(m, u, min_gaps=1).collect()}
    want = {}
    for k, times in at.items():
        t = sorted(24 * day + hour for day, hour in times)
        if len(t) > 1:
            want[f"u{k}"] = round(max(b - a for a, b in zip(t, t[1:])) / 24, 4)
    assert got == want
