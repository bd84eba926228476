"""Rows with long texts are shuffled as rarely as can be, and not sorted on the way."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatlens.operators import ingest as G
from chatlens.operators import ledger as LG
from chatlens.operators import search as SE
from chatlens.sources.records import nest_messages
from chatlens.sources.schema import SCHEMAS

A = "user_demotenant01"
T0 = dt.datetime(2024, 1, 1)


def _steps(df, kind):
    """Inputs and arguments of the plan's steps of a kind that texts pass."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    parts = [p for p in text.split("\n\n") if p.strip().startswith("(") and f") {kind}" in p.strip().split("\n")[0]]
    return [p for p in parts if "content#" in p or "_row#" in p]


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _tables(spark, tmp_path):
    def stored(name, rows):
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    blank = dict.fromkeys(SCHEMAS["messages"].names)
    m = [blank | {"tenant_id": A, "id": k, "server_id": 1, "channel_id": k % 2, "author_id": k % 3 or None,
                  "content": f"text {k}", "created_at": T0} for k in (1, 2, 3, 4, 4)]
    u = [dict.fromkeys(SCHEMAS["users"].names) | {"tenant_id": A, "id": k, "username": f"u{k}"} for k in (1, 1)]
    return (stored("messages", m), stored("users", u), stored("message_mentions", [(A, 1, 2)]),
            stored("reactions", [(A, 2, 5, 1, T0, False)]), stored("emojis", [(A, 5, None, "x", False, None, False)]))


def test_records_ship_each_text_once_unsorted(spark, tmp_path, no_broadcast):
    """Repeated users and messages, and deleted authors, count as before."""
    df = G.normalize_messages(nest_messages(*_tables(spark, tmp_path)), A)
    assert len(_steps(df, "Exchange")) == 1 and not _steps(df, "Sort ")
    got = sorted((r.id, r.author_id, r.content, r.mention_count) for r in df.filter("author_id IS NOT NULL").collect())
    assert got == [(1, 1, "text 1", 1)] * 2 + [(2, 2, "text 2", 0)] + [(4, 1, "text 4", 0)] * 4
    assert df.filter("author_id IS NULL").count() == 1


def test_first_write_is_picked_behind_one_shuffle(spark, tmp_path, no_broadcast):
    m = _tables(spark, tmp_path)[0]
    new = m.withColumn("content", F.concat("content", F.lit("+")))
    df = G.insert_ignore(m.filter("id < 3"), new.unionByName(new), ["tenant_id", "id"])
    (only,) = _steps(df, "Exchange")
    assert "REPARTITION_BY_COL" in only         # no partial pick sorts the texts before it
    assert sorted((r.id, r.content) for r in df.collect()) == [
        (1, "text 1"), (2, "text 2"), (3, "text 3+"), (4, "text 4+")]


def test_stored_keys_are_found_without_the_texts(spark, tmp_path, no_broadcast):
    m = _tables(spark, tmp_path)[0]
    m.filter("id = 2").write.parquet(f"{tmp_path}/held")
    held = spark.read.parquet(f"{tmp_path}/held")
    LG.run_intervals(held).write.parquet(f"{tmp_path}/ledger")
    df = LG.fresh_rows(m, held, spark.read.parquet(f"{tmp_path}/ledger"), ["tenant_id", "id"])
    (only,) = _steps(df, "Exchange")
    assert "REPARTITION_BY_COL" in only
    assert sorted(r.id for r in df.collect()) == [1, 3, 4]


def test_a_posting_is_a_gram_of_a_block(spark, tmp_path):
    """Also with ids far apart, and one id for many messages of a gram."""
    ids = [*range(300), 10**12, 10**15]
    m = spark.createDataFrame([(A, k, 1, 1, "same words" if k % 2 else "other words", T0) for k in ids],
                              "tenant_id string, id long, author_id long, channel_id long, content string, "
                              "created_at timestamp_ntz").coalesce(1)
    root = SE.write_index(m, str(tmp_path / "index"), n_blocks=2)
    posted = spark.read.parquet(f"{root}/postings")
    grams = {x[i:i + 3] for x in ("same words", "other words") for i in range(len(x) - 2)}
    assert posted.count() <= 2 * len(grams) and {r.gram for r in posted.collect()} == grams
    assert sorted(r.id for r in SE.candidates(spark, root, "words", A).collect()) == ids
    assert sorted(r.id for r in SE.matches(spark, root, "SAME", A).collect()) == [k for k in ids if k % 2]


def test_rows_of_sure_keys_stay_where_they_are(spark, tmp_path, no_broadcast):
    """Of a batch only the keys that come twice are shuffled, those that are
    stored already are dropped in place; null keys are one key."""
    m = _tables(spark, tmp_path)[0]
    m = m.unionByName(m.filter("id = 3").withColumn("id", F.lit(None).cast("long")))
    m = m.unionByName(m.filter("id IS NULL"))
    key = ["tenant_id", "id"]
    held = m.filter("id = 2")
    ledger = LG.run_intervals(held)
    doubtful = LG.doubtful_keys(m, held, ledger, key)
    assert not [p for kind in ("Exchange", "Sort ") for p in _steps(doubtful, kind) if "content#" in p]
    assert sorted((r.id or 0, r.held) for r in doubtful.collect()) == [(0, False), (2, True), (4, False)]
    few = spark.createDataFrame(doubtful.toArrow())
    df = LG.fresh_rows(m, held, ledger, key, few)
    assert len(_steps(df, "Exchange")) == 1             # of the rows behind the semi join
    want = LG.fresh_rows(m, held, ledger, key)
    assert sorted(df.collect(), key=repr) == sorted(want.collect(), key=repr) and want.count() == 4
    sure = LG.fresh_rows(m, held, ledger, key, few.filter("held"))
    assert sure.count() == 6                            # nobody told of the others


def test_deleted_channels_leave_the_other_texts_in_place(spark, tmp_path, no_broadcast):
    m = _tables(spark, tmp_path)[0]
    gone = {"channels": F.broadcast(spark.range(1, 2).toDF("id")), "users": F.broadcast(spark.range(1, 2).toDF("id"))}
    left = G.cascade_delete({"messages": m}, **gone, namesakes=False)["messages"]
    assert not _steps(left, "Exchange") and not _steps(left, "Sort ")
    assert sorted((r.id, r.author_id) for r in left.collect()) == [(2, 2), (4, None), (4, None)]


def test_the_index_shuffles_no_text(spark, tmp_path, monkeypatch):
    """Texts are written as they come, in blocks that are told by place; steps
    beyond a byte or two are kept."""
    frame = type(spark.range(1))
    hints, real = [], frame.hint
    monkeypatch.setattr(frame, "hint", lambda self, name, *a: (hints.append((name, "content" in self.columns)),
                                                                   real(self, name, *a))[1])
    m = spark.range(0, 70_002, 1, 1).select(
        F.lit(A).alias("tenant_id"), "id",
        F.lit(1).cast("long").alias("author_id"), F.lit(1).cast("long").alias("channel_id"),
        F.when(F.col("id").isin(0, 1, 299, 70_001), "Found it").otherwise("no").alias("content"),
        F.lit(T0).cast("timestamp_ntz").alias("created_at"))
    root = SE.write_index(m, str(tmp_path / "index"), n_blocks=1)
    assert hints == [("rebalance", False)]              # of the postings
    assert {r.width for r in spark.read.parquet(f"{root}/postings").collect()} <= {1, 2, 8}
    assert sorted(r.id for r in SE.matches(spark, root, "found", A).collect()) == [0, 1, 299, 70_001]
    assert SE._texts(spark, root, A).select("block").distinct().count() == 1
    root = SE.write_index(m, str(tmp_path / "blocks"), block=1000)
    assert SE._texts(spark, root, A).groupBy("block").count().agg(F.max("count")).first()[0] == 1000
    assert sorted(r.id for r in SE.candidates(spark, root, "found", A).collect()) == [0, 1, 299, 70_001]


def test_records_take_their_texts_last(spark, tmp_path, no_broadcast):
    """Rows meet their texts when all else is on them: the texts' own table is
    shuffled, and no message with a text; of two texts of a key both count."""
    m, *rest = _tables(spark, tmp_path)
    spark.createDataFrame([(k, f"text {k}") for k in (1, 2, 3, 4, 4)], "id long, content string").write.parquet(
        f"{tmp_path}/texts")
    held = spark.read.parquet(f"{tmp_path}/texts")
    put = lambda df: df.join(held, "id", "left")
    slim = m.drop("content")
    df = G.normalize_messages(nest_messages(slim, *rest, texts=put), A)
    assert all("id#" in p and "author_id#" not in p and "_author#" not in p for p in _steps(df, "Exchange"))
    whole = put(slim).select(*m.columns)
    want = G.normalize_messages(nest_messages(whole, *rest), A)
    assert len(_steps(df, "Exchange")) == 1 and len(_steps(want, "Exchange")) == 2
    assert sorted(df.collect(), key=repr) == sorted(want.collect(), key=repr) and df.count() == 4 + 8


def test_first_write_is_picked_before_the_texts(spark, tmp_path, no_broadcast):
    """Only keys that still have several rows are picked with their texts: of
    two texts of a key, or of rows that differ behind the text; nulls are a key."""
    m = _tables(spark, tmp_path)[0].drop("content").withColumn("doc", F.col("id"))
    twin = m.filter("id = 3").withColumn("doc", F.lit(9).cast("long"))
    none = m.filter("id = 2").withColumn("id", F.lit(None).cast("long")).withColumn("channel_id", F.lit(7).cast("long"))
    m = m.unionByName(twin).unionByName(none).unionByName(none.withColumn("channel_id", F.lit(8).cast("long")))
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "d"), (9, "c"), (4, "f"), (4, "e")], "doc long, content string") \
        .write.parquet(f"{tmp_path}/texts")
    held = spark.read.parquet(f"{tmp_path}/texts")
    put = lambda df: df.join(held, "doc", "left").drop("doc")
    names, key = SCHEMAS["messages"].names, ["tenant_id", "id"]
    old = put(m).filter("id = 1").select(*names)
    df = G.insert_ignore(old, m.unionByName(m), key, texts=put)
    by_key = [p for p in _steps(df, "Exchange") if "REPARTITION_BY_COL" in p]
    assert len(by_key) == 1                             # of the keys with several rows
    batch = put(m).select(*names)
    want = G.insert_ignore(old, batch.unionByName(batch), key)
    assert sorted(df.collect(), key=repr) == sorted(want.collect(), key=repr)
    got = {(r.id, r.channel_id): r.content for r in df.collect()}
    assert got == {(1, 1): "a", (2, 0): "b", (3, 1): "c", (4, 0): "e", (None, 7): "b"}
    with pytest.raises(ValueError, match="least rows"):
        G.insert_ignore(old, m, key, order_col="created_at", texts=put)
