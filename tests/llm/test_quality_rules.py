import random
import re

import pytest

from chatlens.llm import quality_rules as Q
from tests.conftest import SF_MID


def brute(text):
    t = text or ""
    gap = r"[^\x20\x09-\x0D]+"
    w = re.findall(gap, t)
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k:k + 8]), []).append(k)
    cover = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    lines = [x for x in t.split("\n") if re.search(gap, x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover),
            n < 20 or 100 * len(cover) > 30 * n)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def check(docs, rows):
    got = Q.counts(docs).withColumn("base_failed", Q.base_failed()).collect()
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in got), key=str) == sorted(
        ((i, *brute(t)) for i, t in rows), key=str)


def test_counts_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_counts_of_repeats_and_odd_rows(make, odd):
    rng = random.Random(3)
    rows = list(odd)
    for k in range(100, 160):
        part = [rng.choice("abcd") for _ in range(rng.randrange(1, 40))]
        rows.append((k, rng.choice([" ", "\n", " \t"]).join(part * rng.randrange(1, 4))))
    rows += [(200, "a " * 20000), (201, "x\n\nx\n \n \ny\nx"), (202, "#<>|& 😀 é \x1f\x85"), (203, "a b c d e f g h"),
             (204, "a b c d e f g h a b c d e f g h")]
    check(make(rows), rows)
    assert Q.counts(make([])).collect() == []


def test_learned_list_on_held_out_rows(spark):
    """Learned from the labels with an odd id, measured on the even ones."""
    sf = SF_MID.replace("0.01", "0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.judge(docs, labels.filter("doc_id % 2 = 1"))
    rows = got.join(labels.filter("doc_id % 2 = 0"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) > 0.99 * len(good)
    assert sum(bad) < 0.2 * len(bad)
    assert got.count() == docs.count()
    assert {r.rule for r in rows if r.base_failed} == {"base"} and {r.kept for r in rows if r.base_failed} == {False}


def test_rules_of_planted_labels(make, spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40)) + (" ###" * 5 if k % 4 == 0 else "")
    docs = make([(k, text(k)) for k in range(400)])
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(400)] + [(None, 0), (3, None), (9999, 0)],
                                   "doc_id long, quality int")
    featured = Q.with_features(Q.counts(docs))
    rules = Q.learn(featured, labels)
    assert [[c.feature for c in r] for r in rules] == [["symbols_pm"]] and rules[0][0].at_least
    rows = Q.judge(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in Q.judge(docs, none).collect())
    assert Q.judge(make([]), labels).collect() == []


def test_native(make, odd):
    plan = Q.counts(make(odd))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("noise", [5, 10])
def test_a_precise_rule_behind_a_noisy_region(make, spark, noise):
    """Symbols mark most bad rows, but ``noise`` percent of these are labelled
    good; capitals mark fewer, without noise."""
    def text(k):
        words = " ".join(f"w{k}x{j}" for j in range(40))
        return words + " ###" * 5 if k % 4 == 0 else words.upper() if k % 8 == 1 else words

    rng = random.Random(5)
    quality = {k: int(rng.random() < noise / 100) if k % 4 == 0 else int(k % 8 != 1) for k in range(1600)}
    docs = make([(k, text(k)) for k in quality])
    labels = spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in Q.judge(docs, labels).collect()}
    assert not any(kept[k] for k in kept if k % 8 == 1)
    assert all(kept[k] for k in kept if k % 4 and k % 8 != 1)
