import re
from collections import defaultdict
from itertools import combinations

import pytest

from chatlens.llm import decontaminate as D
from tests.conftest import SF_MID

BENCH = "item_id long, text string"


def words(t):
    return "".join(c if c.isalnum() or c in " \t\n\x0b\x0c\r" else "" for c in (t or "").lower()).split()


def brute(docs, items):
    """Every alignment of every item with every document that shares a word."""
    out = {}
    for item_id, text in items:
        item = words(text)
        n = len(item)
        if n < D.SHORT_SPAN:
            continue
        width = min(D.STRETCH, n)
        for doc_id, t in docs:
            doc = words(t)
            at = defaultdict(list)
            for k, w in enumerate(doc):
                at[w].append(k)
            best = 0
            for start in {k - j for j, w in enumerate(item) for k in at[w]}:
                same = [0 <= start + j < len(doc) and doc[start + j] == item[j] for j in range(n)]
                best = max(best, max(sum(same[k:k + width]) * 100 // width for k in range(n - width + 1)))
            if best >= D.SHARE:
                out[doc_id, item_id] = max(best, out.get((doc_id, item_id), 0))
    return out


def got(docs, bench):
    return {(r.doc_id, r.item_id): r.percent for r in D.overlaps(docs, bench).collect()}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    bench = spark.read.parquet(f"{SF_MID}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got(docs, bench) == want and len(want) > 10


ITEM = " ".join(f"word{k}" for k in range(30))


def changed(*at):
    return " ".join("other" if k in at else w for k, w in enumerate(ITEM.split()))


@pytest.mark.parametrize("broadcast", [D.BROADCAST_SEEDS, 0])
def test_substitutions_and_decoration(make, spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_SEEDS", broadcast)
    bench = spark.createDataFrame([(1, ITEM), (2, "short item of six words here"), (3, "too short"), (4, None),
                                   (5, ""), (1, ITEM)], BENCH)
    docs = [(1, "x " * 50 + ITEM + " y" * 50), (2, changed(3, 11, 19, 27)), (3, ITEM.upper().replace(" ", "!! ")),
            (4, "so " + ITEM.replace(" ", " | ")), (5, changed(*range(0, 30, 2))), (6, "a Short item, of six words here."),
            (7, "too short"), (8, None), (9, ""), (10, " ".join(ITEM.split()[5:27])), (None, ITEM), (None, ITEM),
            (11, ITEM + " z " + ITEM), (12, " ".join(ITEM.split()[:9])), (13, "word0 " * 40000 + changed(29))]
    found = got(make(docs), bench)
    assert found == brute(docs, [(1, ITEM), (2, "short item of six words here")])
    assert {1, 2, 3, 4, 6, 10, None, 11, 13} == {d for d, _ in found}
    rows = D.contaminated(make(docs), bench).collect()
    assert len(rows) == 9 and all(r.item_ids in ("1", "2") and r.n_items == 1 for r in rows)
    kept = D.without_benchmark(make(docs), bench)
    assert kept.columns == make(docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == [5, 7, 8, 9, 12]


def test_empty_tables(make, spark):
    none = spark.createDataFrame([], BENCH)
    bench = spark.createDataFrame([(1, ITEM)], BENCH)
    assert D.contaminated(make([(1, ITEM)]), none).collect() == []
    assert D.contaminated(make([]), bench).collect() == []
    assert D.without_benchmark(make([(1, "x")]), none).count() == 1


def test_masks_meet_every_tolerated_change():
    """Some mask fits between the changed words of a stretch of 20 with up to
    two changes anywhere."""
    span = len(D.MASKS[0])
    assert all(re.fullmatch("[01]+", m) and len(m) == span for m in D.MASKS)
    for a in range(20):
        for b in range(20):
            hit = any(all(m[k] == "0" or at + k not in (a, b) for k in range(span))
                      for m in D.MASKS for at in range(20 - span + 1))
            assert hit, (a, b)


def test_native(make, spark):
    plan = D.contaminated(make([(1, ITEM)]), spark.createDataFrame([(1, ITEM)], BENCH)) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan and "Cartesian" not in plan


def tolerated(n):
    """Every set of changed words that a stretch of an item of n words may have."""
    width = min(D.STRETCH, n)
    return list(combinations(range(width), width * (100 - D.SHARE) // 100))


def test_seeds_meet_every_tolerated_change():
    for n in range(1, 2 * D.STRETCH):
        seeds = [{at + step * k for k in range(size)} for at, step, size in D.picks(n)]
        for shift in range(n - min(D.STRETCH, n) + 1):
            inside = [s for s in seeds if min(s) >= shift and max(s) < shift + D.STRETCH]
            for gone in tolerated(n):
                assert any(s.isdisjoint(k + shift for k in gone) for s in inside), (n, shift, gone)


def test_seeds_ignore_words_between_their_picks():
    assert all("10" in m for m in D.MASKS)
    for n in range(5, 2 * D.STRETCH):       # shorter items may have no change
        assert all(step > 1 for _, step, _ in D.picks(n))
    assert D.picks(4) == [(0, 1, 4)]


def test_short_items_and_null_ids(make, spark):
    bench = spark.createDataFrame([(1, "two words"), (None, ITEM), (2, "gone"), (2, "word29 end"), (3, " !? ")], BENCH)
    docs = make([(1, "here are Two, words!"), (2, "two other words"), (3, ITEM + " end"), (4, "two"), (5, None), (6, "gone")])
    rows = {r.doc_id: (r.n_items, r.item_ids) for r in D.contaminated(docs, bench, short_span=1).collect()}
    assert rows == {1: (1, "1"), 3: (2, "2,null"), 6: (1, "2")}
    assert {r.doc_id for r in D.contaminated(docs, bench).collect()} == {3}


@pytest.mark.parametrize("broadcast", [D.BROADCAST_SEEDS, 0])
def test_every_tolerated_change_of_short_items_is_found(make, spark, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_SEEDS", broadcast)
    bench, docs = [], []
    for n in (*range(D.SHORT_SPAN, 16), 19, 20):
        item = [f"i{n}w{k}" for k in range(n)]
        bench.append((n, " ".join(item)))
        for gone in tolerated(n)[::1 if n < 20 else 40]:
            docs.append((len(docs), "on " + " ".join("x" if k in gone else w for k, w in enumerate(item)) + " off"))
        docs.append((len(docs), " ".join(item[n // 5:])))       # begins within the item
        docs.append((len(docs), " ".join(item[:n - n // 5 - 1])))    # a word too few
    want = brute(docs, bench)
    assert len(want) == len(docs) - len(bench)
    assert got(make(docs, extra=False), spark.createDataFrame(bench, BENCH)) == want
