import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatlens.llm import spelling as SP
from chatlens.llm.acceptor import Acceptor, one_edit_pairs
from chatlens.llm.queries import op11_spelling_variants
from tests.conftest import SF_SMALL

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def counted(docs):
    words = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def plain(docs):
    words = counted(docs)
    holes = defaultdict(set)
    for w in words:
        for x in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            holes[x].add(w)
    form, size = {}, {}
    for w in words:
        some = set().union(*(holes[x] for x in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}))
        some = {v for v in some if near(w, v)}
        best = min(some, key=lambda v: (-words[v], v), default=None)
        size[w] = len(some)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, size[w], words.get(form[w])) for w, n in words.items()}


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abé", max_size=6), max_size=40), st.sampled_from(["", "a", "ba"]))
def test_composition_accepts_each_pair_once(words, after):
    found = list(one_edit_pairs(Acceptor(sorted(words)), after))
    def moves(u, v):        # the place of the edit moves into what follows
        return len(v) > len(u) and after[:1] and v == u + after[0]
    want = {(u, v) for u in words for v in words if (len(u), u) < (len(v), v) and near(u, v) and not moves(u, v)}
    assert len(found) == len(set(found)) and set(found) == want


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab", max_size=5), min_size=1, max_size=30))
def test_acceptor_is_minimal(words):
    a = Acceptor(sorted(words))
    reachable, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in reachable:
            reachable.add(s)
            todo += a.arcs[s].values()
    begins = {w[:k] for w in words for k in range(len(w) + 1)}
    ends = {frozenset(w[len(x):] for w in words if w.startswith(x)) for x in begins}
    assert len(reachable) == len(ends)


@pytest.mark.parametrize("large", [2, 5, 1000])
def test_near_words_in_split_partitions(spark, large):
    random.seed(3)
    words = {"".join(random.choice("abc") for _ in range(random.randint(5, 9))): random.randint(3, 60)
             for _ in range(700)}
    words |= {f"aaaaaaaa{x}{y}aaaaaaaa": 3 for x in "abcdef" for y in ("", "a", "b", "cd")}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best_n, r.best) for r in SP.near_words(df, large).collect()}
    for w in words:
        some = [v for v in words if near(v, w)]
        best = min(some, key=lambda v: (-words[v], v), default=None)
        assert got.get(w) == ((len(some), words[best], best) if some else None)


def test_whole_table(spark):
    df = op11_spelling_variants(spark, SF_SMALL)
    assert df.columns == COLUMNS
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = [tuple(r) for r in df.collect()]
    assert set(rows) == plain(docs) and len(rows) == len(set(rows)) and any(r[1] for r in rows)


def test_odd_rows(make, odd):
    rows = odd + [(k, "Straße straße STRASSE strasse strasses " + "x" * 3000 + " " + "x" * 2999) for k in range(9)]
    rows += [(None, "ÀÉÎ ÀÉÎõ àéîõü àéîõü àéîõü àéîõu")] * 3 + [(7, "chains chains chainz " * 8 + "chainzz")] * 3
    got = [tuple(r) for r in SP.group(make(rows)).collect()]
    assert set(got) == plain([r[:2] for r in rows]) and len(got) == len(set(got))
    assert SP.group(make([])).collect() == [] and SP.group(make([(1, None), (2, "")])).collect() == []


def test_roots_follow_long_ways(spark, make):
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx"]
    text = " ".join(" ".join([w] * (4 * 3 ** k)) for k, w in enumerate(chain))
    docs = [(0, text)]
    got = {tuple(r) for r in SP.group(make(docs)).collect()}
    assert got == plain(docs) and max(n for *_, n, _, _ in got) > 300
