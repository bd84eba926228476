from collections import Counter
from zlib import crc32

from chatlens.llm import language_id as L
from tests.conftest import SF_MID


def test_held_out_accuracy(spark):
    sf = SF_MID.replace("0.01", "0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = L.identify(docs).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out and r.lang_pred != "und"]
    right = Counter(r.lang_pred == lang[r.doc_id] for r in out)
    assert right[True] > 0.99 * len(out)


def test_predictions_ignore_the_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    one = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs).collect()}
    other = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 'xx' ELSE lang "
                            "END AS lang", "'s' AS source")
    assert {r.doc_id: (r.lang_pred, r.score) for r in L.identify(other).collect()} == one


def test_three_languages_of_a_family(make):
    word = {"en": ("the ", "ing "), "de": ("und ", "sch "), "nl": ("het ", "ij "), "qq": ("zzz ", "xq ")}
    rows = [(k, (word[v][0] * (2 + k % 5) + word[v][1] * (1 + k % 3)), v)
            for k in range(400) for v in [list(word)[k % 4]]]
    got = {r.doc_id: r.lang_pred for r in L.identify(make(rows)).collect()}
    assert sum(got[k] == v for k, _, v in rows) == len(rows)


def test_odd_rows(make, odd):
    rows = L.identify(make(odd)).collect()          # nothing to learn from
    assert len(rows) == len(odd) and {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    some = [(*r, "en") for r in odd] + [(100 + k, f"hello there {k}", "en") for k in range(20)] + [
        (130, "12 345 .,;", "fr"), (131, None, "de")]
    got = L.identify(make(some)).collect()
    assert len(got) == len(some)
    text = {r[0]: r[1] for r in some if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            has = any(c.isalpha() for c in text[r.doc_id] or "")
            assert (r.lang_pred != "und") == has
    assert L.identify(make([])).collect() == []
    kept = L.with_language(make(some))
    assert kept.columns == make(some).columns and kept.count() == sum(r.lang_pred != "und" for r in got)


def test_texts_with_letters_stay_where_nothing_teaches(spark, make, odd):
    import corpus_pipeline

    held = next(k for k in range(99) if crc32(str(k).encode()) % 4 == 2)
    lettered = lambda rows: sorted(repr(r[:2]) for r in rows if any(c.isalpha() for c in r[1] or ""))
    digits = [(20, "12 34.5"), (21, "_-_")]
    for rows in (odd + digits, [(held, "the held out one", "en"), (None, "no id", "de"), (7, "plain"), *digits]):
        docs = make(rows)
        out = corpus_pipeline.stage_language_id(spark, docs, "")
        assert out.columns == docs.columns
        assert sorted(repr((r.doc_id, r.text)) for r in out.collect()) == lettered(rows) != []


def test_letters_are_those_of_the_whole_pattern_and_found_quickly():
    """Numbers that are no digits still part words, and plain prose costs about
    what the short pattern costs."""
    from time import process_time

    odd = ["a½b", "Ⅷ x", "1a2", "〇", " ½ ", "a ½ b", "١x", "ßİ", "", None]
    assert [L.letters(x) for x in odd] == [L._NOT_LETTERS.sub(" ", (x or "").lower()).strip() for x in odd]
    prose = "Some plain words of ordinary prose, and more of them. " * 4000
    at = process_time()
    L._NOT_LETTERS.sub(" ", prose.lower())
    whole = process_time() - at
    at = process_time()
    L.letters(prose)
    assert process_time() - at < whole / 2
