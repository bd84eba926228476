"""Exports and the streaming front end."""

import json
import os

import pytest
from pyspark.sql import functions as F

from chatlens.plans import exports
from chatlens.sources.records import nest_messages
from chatlens.streaming.ingest_stream import read_record_stream, start_ingest


def _text(path):
    out = []
    for f in sorted(os.listdir(path)):
        if f.startswith("part-"):
            with open(os.path.join(path, f), encoding="utf-8") as fh:
                out += fh.read().splitlines()
    return out


def test_csv_quoting_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "hi"', None), ("plain", "x", 1)],
                               "s string, t string, n int")
    exports.export_csv(df.coalesce(1), str(tmp_path / "csv"))
    assert _text(str(tmp_path / "csv")) == ["s,t,n", '"a,b","say ""hi""",', "plain,x,1"]


def test_markdown_escapes(spark):
    df = spark.createDataFrame([("a|b", None), ("line\nbreak", 2)], "s string, n int")
    lines = [r.line for r in exports.markdown_lines(df, order=["s"]).orderBy("line_no").collect()]
    assert lines == ["| s | n |", "| --- | --- |", "| a\\|b | _null_ |", "| line break | 2 |"]


def test_json_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("x", None)], "s string, n int")
    exports.export_json(df, str(tmp_path / "js"))
    assert [json.loads(x) for x in _text(str(tmp_path / "js"))] == [{"s": "x", "n": None}]


def test_stream_ingest_is_idempotent(spark, small, tmp_path):
    recs = nest_messages(small.messages, small.users, small.message_mentions, small.reactions,
                         small.emojis)
    src = str(tmp_path / "dump")
    recs.write.json(src)
    recs.filter("id < 100").write.mode("append").json(src)      # duplicates arrive again
    out, ck = str(tmp_path / "tables"), str(tmp_path / "ck")
    q = start_ingest(read_record_stream(spark, src), "user_demotenant01", out, ck)
    q.awaitTermination(300)
    stored = spark.read.parquet(out + "/messages")
    assert stored.count() == small.messages.count()
    assert stored.select("id").distinct().count() == stored.count()
    mm = spark.read.parquet(out + "/message_mentions")
    assert mm.count() == small.message_mentions.count()
    assert stored.agg(F.sum("word_count")).first()[0] == small.messages.agg(
        F.sum("word_count")).first()[0]


def test_stream_keeps_old_records_and_counts_rejects(spark, tmp_path):
    """One file a batch, out of time order, one line cut short, one copy."""
    from chatlens.sources.records import read_records
    src, out = tmp_path / "dump", str(tmp_path / "tables")
    src.mkdir()
    days = [(1, "2024-06-01"), (2, "2024-01-05"), (3, "2024-02-01"), (2, "2024-01-05")]
    for k, (i, d) in enumerate(days):
        (src / f"{k}.json").write_text(json.dumps({"id": i, "guild_id": 1, "channel_id": 1,
                                                   "content": "x", "created_at": f"{d}T00:00:00"}) + "\n"
                                       + ('{"id": 9, "gui' if k == 1 else ""))
        os.utime(src / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    q = start_ingest(read_record_stream(spark, str(src), max_files=1), "user_demotenant01", out,
                     str(tmp_path / "ck"))
    q.awaitTermination(300)
    assert sorted(r.id for r in spark.read.parquet(out + "/messages").collect()) == [1, 2, 3]
    assert [r.value for r in spark.read.text(out + "/rejects").collect()] == ['{"id": 9, "gui']
    with pytest.raises(Exception, match="(?i)malformed"):
        read_records(spark, str(src)).collect()


def test_report_text_in_order(spark, small, tmp_path):
    from chatlens.plans.report import write_report, year_report
    write_report(year_report(small), str(tmp_path / "rep"))
    lines = _text(str(tmp_path / "rep"))
    assert lines[0] == "== THE BIG NUMBERS ==" and any(x.startswith("== TOP 10 MESSAGERS") for x in lines)
    heads = [x for x in lines if x.startswith("== ")]
    assert len(heads) == 17


@pytest.mark.parametrize("kind", ["csv", "tsv"])
def test_special_characters_come_back(spark, tmp_path, kind):
    from chatlens.plans import exports
    rows = [(1, "a,b"), (2, "tab\there"), (3, 'say "hi"'), (4, "two\nlines"), (5, "pipe|d"), (6, None), (7, "plain")]
    df = spark.createDataFrame(rows, "id int, text string")
    out = str(tmp_path / kind)
    {"csv": exports.export_csv, "tsv": exports.export_tsv}[kind](df, out)
    back = spark.read.csv(out, header=True, sep="," if kind == "csv" else "\t", quote='"', escape='"', multiLine=True,
                          schema="id int, text string")
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_malformed_reactor_pages_fail(spark, tmp_path):
    from chatlens.sources.records import read_reactor_pages
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "p.json").write_text('{"message_id": 1, "users": []}\n{"message_id": 2, "use')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_reactor_pages(spark, str(tmp_path / "pages")).collect()
