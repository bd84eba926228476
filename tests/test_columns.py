import datetime as dt

from pyspark.sql import functions as F

from chatlens.functions import columns as C


def one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_word_and_char_counts(spark):
    data = [("Hello world!",), ("",), (None,), ("  spaced\tout\nwords  ",), ("日本語 テキスト",),
            ("a b　c",), ("x" * 2000,), ("😀 emoji",)]
    words = one(spark, C.word_count("c"), data, "c string")
    chars = one(spark, C.char_count("c"), data, "c string")
    assert words == [len(s.split()) if s else 0 for (s,) in data]
    assert chars == [len(s) if s else 0 for (s,) in data]
    assert words[0] == 2 and chars[0] == 12 and chars[6] == 2000


def test_snowflake_to_timestamp(spark):
    sf = 175928847299117063
    got = one(spark, C.snowflake_to_timestamp("i"), [(sf,)], "i long")[0]
    want = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=(sf >> 22) + 1420070400000)
    assert got == want


def test_display_name_falls_through_empty(spark):
    data = [("nick", "glob", "user"), ("", "glob", "user"), (None, "", "user"), (None, None, "user")]
    got = one(spark, C.display_name("n", "g", "u"), data, "n string, g string, u string")
    assert got == ["nick", "glob", "user", "user"]


def test_emoji_text_and_jump_url(spark):
    data = [("party", 12, True), ("wave", 34, False), ("😀", None, False)]
    got = one(spark, C.emoji_text("n", "i", "a"), data, "n string, i long, a boolean")
    assert got == ["<a:party:12>", "<:wave:34>", "😀"]
    urls = one(spark, C.jump_url("s", "c", "m"), [(1, 2, 3), (None, 2, 3)], "s long, c long, m long")
    assert urls[0].endswith("/1/2/3") and urls[1].endswith("/@me/2/3")


def test_tenant_id_validation(spark):
    data = [("user_abcdefghij",), ("user_abc",), ("user_" + "a" * 51,), ("tenant_abcdefghij",),
            ("user_abcde-fghij",), (None,), ("",)]
    assert one(spark, C.valid_tenant_id("t"), data, "t string") == [
        True, False, False, False, False, False, False]


def test_round_ratio_half_away_from_zero(spark):
    data = [(5, 2), (-5, 2), (1, 3), (2, 3), (7, 0), (1, None), (2675, 1000)]
    got = one(spark, C.round_ratio(F.col("n"), F.col("d"), 0), data, "n long, d long")
    assert got == [3.0, -3.0, 0.0, 1.0, None, None, 3.0]
    got2 = one(spark, C.round_ratio(F.col("n"), F.col("d"), 2), data, "n long, d long")
    assert got2[6] == 2.68 and got2[2] == 0.33


def test_count_occurrences_non_overlapping(spark):
    data = [("hahaha",), ("LOL lol",), (None,)]
    assert one(spark, C.count_occurrences(F.col("c"), "haha"), data, "c string") == [1, 0, 0]
    assert one(spark, C.count_occurrences(F.col("c"), "lol", lower=True), data, "c string")[1] == 2


def test_weekday_sunday_zero(spark):
    d = [(dt.datetime(2024, 1, 7, 12),), (dt.datetime(2024, 1, 8, 12),)]  # Sunday, Monday
    assert one(spark, C.weekday_sun0(F.col("t").cast("timestamp_ntz")), d, "t timestamp") == [0, 1]


def test_word_count_splits_where_python_does_and_is_never_null(spark):
    """Every character of the basic plane between two letters; a filter on the
    count does not split the text a second time."""
    data = [(f"a{chr(k)}b",) for k in range(0x10000) if not 0xD800 <= k < 0xE000] + [(None,), (" 　",)]
    df = spark.createDataFrame(data, "c string").withColumn("n", C.word_count("c"))
    assert df.filter(F.col("n").isNotNull()).select("n").rdd.map(lambda r: r[0]).collect() == [
        len(x.split()) if x else 0 for (x,) in data]
    plan = df.filter(F.col("n").isNotNull())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
