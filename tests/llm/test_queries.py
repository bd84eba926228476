import duckdb
import pytest

import corpus_pipeline
from chatlens.llm import decontaminate, language_id, ngram_join
from chatlens.llm.queries import QUERIES, oracle_sql
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, rows_of

CONTRACT = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op2_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op4_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "kept"],
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cur = con.execute(oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, df.collect()) == want and len(want[1]) > 0


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_result_columns(spark, name):
    assert QUERIES[name](spark, SF_SMALL).columns[:len(CONTRACT[name])] == CONTRACT[name]


def test_pipeline_stages_against_plain_ones(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    langs = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    kept = docs.filter(docs.doc_id.isin([i for i, v in langs.items() if v != "und"]))
    joined = ngram_join.join(kept).collect()
    first = {r.component_id for r in joined if r.n_shingles} | {r.doc_id for r in joined if not r.n_shingles}
    kept = kept.filter(kept.doc_id.isin(list(first)))
    dirty = {r.doc_id for r in decontaminate.contaminated(kept, bench).collect()}
    want = first - dirty
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == docs.columns + ["slot", "shard"]
    assert {r.doc_id for r in out.collect()} == want and out.count() == len(want) < docs.count()


def test_stages_keep_columns_and_take_odd_rows(spark, make, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    for rows in (odd, []):
        docs = make(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_SMALL)
            extra = 2 if name == "sharding" else 0
            assert out.columns[:len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + extra
            assert out.count() <= len(rows)
