import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatlens.llm import runs as R
from chatlens.llm.queries import op13_periodic_runs
from tests.conftest import SF_MID


def plain(word, least=24, times=3):
    """Runs by trying every period at every place."""
    found = []
    for p in range(1, len(word) // times + 1):
        i = 0
        while i + p < len(word):
            j = i
            while j + p < len(word) and word[j] == word[j + p]:
                j += 1
            n = j - i + p
            if n >= max(least, times * p) and all(
                    any(word[k] != word[k + q] for k in range(i, i + n - q)) for q in range(1, p)):
                found.append((i, n, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(1, 2), (4, 3), (24, 3), (10, 4)]))
def test_runs_of_few_letters(word, limits):
    assert sorted(R.find_runs(word, *limits), key=lambda r: (r[0], r[2])) == plain(word, *limits)


BLOCKS = st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=14), st.integers(1, 9),
                            st.lists(st.integers(0, 60), max_size=8)), max_size=9)


@settings(max_examples=500, deadline=None)
@given(BLOCKS)
def test_runs_of_repeated_blocks(blocks):
    word = [str(x) for unit, times, rest in blocks for x in unit * times + rest]
    found = R.runs_of(word)
    assert found == plain(word)
    kept = [w for i, w in enumerate(word) if not any(s + p <= i < s + n for s, n, p in found)]
    assert R.without(word, found) == kept


@pytest.mark.parametrize("period", range(1, 40))
def test_every_period_passes_the_grams(period):
    for n in (max(24, 3 * period), 3 * period + 7, 101):
        if n >= max(24, 3 * period):
            word = [f"a{k}" for k in range(9)] + [f"u{k % period}" for k in range(n)] + [f"z{k}" for k in range(9)]
            assert R.runs_of(word) == [(9, n, period)]


def row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain(words)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in found)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(kept)))


def test_whole_table(spark):
    df = op13_periodic_runs(spark, SF_MID)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                          "collapsed_sha256"]
    docs = [r for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()
            if len(r.text or "") < 4000]        # trying every period is slow on long texts
    got = {r.doc_id: tuple(r) for r in df.collect()}
    assert sum(1 for r in got.values() if r[1]) > 20
    for r in docs:
        assert got[r.doc_id] == row(r.doc_id, r.text)


def test_odd_rows(spark, make, odd):
    rows = odd + [(21, "a b " * 400), (22, " ".join(["x"] * 23)), (23, " ".join(["x"] * 24)), (24, "ha " * 60 + "é")]
    rows = [r for r in rows if r[0] not in (8, 9)]
    got = [tuple(r) for r in R.report(R.detect(make(rows), plant=True)).collect()]
    assert sorted(got, key=str) == sorted((row(*r[:2]) for r in rows), key=str)
    assert R.report(R.detect(make([]))).collect() == []
    long = [r for r in odd if r[0] in (8, 9)]
    assert [(r.n_runs, r.start, r.period) for r in R.report(R.detect(make(long))).collect()] == [(1, 0, 977)] * 2
    (only,) = R.detect(make([(1, "a b " * 12 + "c")])).collect()
    assert [tuple(r) for r in only.runs] == [(0, 24, 2)] and only.collapsed == "a b c"
