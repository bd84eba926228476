import random
import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from chatlens.llm import ngram_join as J
from chatlens.llm import shingles as S
from tests.conftest import SF_MID


def plain_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))


def brute(rows):
    """(doc_id, set size, component) by comparing every pair that shares a shingle."""
    sets = [plain_set(r[1]) for r in rows]
    at = {}
    for k, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        both = Counter(j for x in s for j in at[x] if j < k)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
    ids = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[find(k)] = min(ids.get(find(k), r[0]), r[0])
    return sorted(((r[0], len(s), ids.get(find(k)) if s else r[0])
                   for k, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def check(make, rows):
    got = J.join(make(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("seed", range(40))
def test_linked_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        n = int(rng.choice([1, 2, 3, 4, 7, 20, 63, 64, 65, 200, 256, 900, 1023, 1024, 3000]))
        pool = rng.integers(0, 2**64, 3 * n + 8, dtype=np.uint64)
        a = np.unique(pool[:n])
        top = S.differences(n, n * 4 // 3)
        gone, come = int(rng.integers(0, top + 1)), int(rng.integers(0, top + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[gone:], pool[n:n + come])))
        frequent = np.sort(rng.permutation(pool)[:n // 2])
        if not len(b) or not S.linked(a, b):
            continue
        assert set(S.signatures(a, frequent)) & set(S.signatures(b, frequent))
        assert S.may_link(len(a), S.profile(a), len(b), S.profile(b))


def test_shingles_against_plain_ones():
    for t in ("", " ", "a", "A b", "a b c d e", "a b c d e f", "x\x0by\x0cz\x1f w v é É q", "a a a a a a a"):
        assert len(S.shingle_set(t)) == len(plain_set(t))
    assert (S.shingle_set("ABC d E f g") == S.shingle_set("abc D e F G")).all()
    assert (S.shingle_set("a b") != S.shingle_set("b a")).all()


def test_sf_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = J.join(docs).select("doc_id", "n_shingles", "component_id").collect()
    want = brute(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(i != c for i, _, c in want) > 20


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_large_groups_chains_and_shared_passages(make, monkeypatch):
    """Buckets beyond SMALL and BLOCK, chains of copies, passages that many
    documents share without being similar."""
    monkeypatch.setattr(J, "SMALL", 6)
    monkeypatch.setattr(J, "BLOCK", 16)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, base = [], [word() for _ in range(120)]
    rows += [" ".join(edited(rng, base, rng.randrange(4))) for _ in range(70)]
    chain = [word() for _ in range(100)]
    for _ in range(25):
        chain = edited(rng, chain, 2)
        rows.append(" ".join(chain))
    passage = [word() for _ in range(40)]
    for _ in range(60):
        rows.append(" ".join([word() for _ in range(rng.randrange(2, 14))] + passage
                             + [word() for _ in range(rng.randrange(0, 6))]))
    rows += [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows += rows[:10]
    rng.shuffle(rows)
    check(make, list(enumerate(rows)))


def test_odd_rows(make, odd):
    check(make, odd)
    assert J.join(make([])).collect() == []


def test_first_of_each(make, odd):
    docs = make(odd)
    out = J.first_of_each(docs)
    assert out.columns == docs.columns
    # no words: 1, 2, 3 and the null text; 5, 6, 6, 12 are one group, as are 8 and 9
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(
        ["1", "2", "3", "None", "4", "5", "None", "8", "10", "11"])
    twins = make([(7, "a b c d e f g"), (7, "a b c d e f g"), (7, "A b c d e f g"), (9, "other words here")])
    assert sorted(r.doc_id for r in J.first_of_each(twins).collect()) == [7, 9]
    assert J.first_of_each(make([])).collect() == []


def test_components(spark):
    nodes = spark.range(40).withColumnRenamed("id", "node")
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 19)] + [(30, 25), (25, 39), (39, 30)],
                                  "a long, b long")
    got = {r.node: r.label for r in J.components(nodes.selectExpr("node", "node AS label"), links).collect()}
    assert {got[k] for k in range(20)} == {0} and {got[k] for k in (25, 30, 39)} == {25} and got[21] == 21


def test_entry_query_reads_everything(spark):
    from chatlens.llm.queries import op7_ngram_jaccard
    n = spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    df = op7_ngram_jaccard(spark, SF_MID)
    assert df.columns == ["doc_id", "n_shingles", "component_id"] and df.count() == n


def test_key_map_holds_every_key(spark):
    rng = np.random.default_rng(5)
    keys = rng.integers(-2 ** 63, 2 ** 63, 6000, dtype=np.int64)
    table = spark.createDataFrame(pd.DataFrame({"k": np.concatenate([keys, keys[:50]])}))
    bits = J._key_map(table, "k")
    assert J._on_map(bits, keys).all()
    assert J._on_map(bits, rng.integers(-2 ** 63, 2 ** 63, 6000, dtype=np.int64)).mean() < 0.1
    assert not J._on_map(J._key_map(table.limit(0), "k"), keys).any()


def near_copies(rng, n, words=80):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    return [" ".join(edited(rng, base, rng.randrange(3))) for _ in range(n)]


def test_hot_signatures_are_spread(make, monkeypatch):
    """Every text is sampled, so signatures of two sampled texts are hot and
    their rows do not meet; repeated rows stay."""
    monkeypatch.setattr(J, "SAMPLE", 1)
    monkeypatch.setattr(J, "HOT", 2)
    rng = random.Random(11)
    rows = near_copies(rng, 60) + near_copies(rng, 3) + near_copies(rng, 1)
    rows = [(k, t) for k, t in enumerate(rows)] * 2 + [(None, rows[0]), (900, None), (901, " ")]
    check(make, rows)
    monkeypatch.setattr(J, "HOT_LIST", 5)       # the others meet
    check(make, rows)


def test_rows_of_a_hot_signature_meet_in_no_task(make, monkeypatch):
    monkeypatch.setattr(J, "SAMPLE", 1)
    monkeypatch.setattr(J, "HOT", 20)
    rows = list(enumerate(near_copies(random.Random(2), 80)))
    texts = make(rows).selectExpr("doc_id", "text", "xxhash64(text) AS text_key")
    number = J.partial(J._number, split=frozenset(), digest=S.digest)
    frequent = J._frequent(J._sample(texts))
    hot = J._hot(J._sample(texts), frequent, number)
    held = {r.signature for r in hot.collect()}
    assert held
    plan = J._rows(J._described(texts, frequent, number), hot)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(signature" in plan and "spread" in plan
    got = Counter(r.signature for r in J._rows(J._described(texts, frequent, number), hot).collect())
    want = Counter(int(x) for _, t in set(rows)
                   for x in S.signatures(S.shingle_set(t), frequent).view(np.int64))
    n_sets = len({S.shingle_set(t).tobytes() for _, t in rows})
    assert got[None] == len(rows) and n_sets > 20
    assert all(got[s] > 1 for s in held) and {s for s, n in want.items() if n > 1} >= held


def test_sets_whose_nodes_are_alike_are_told_apart(make):
    """Only three bits of the first half of the digest are left."""
    def poor(s):
        node, other = S.digest(s)
        return node & 7, other

    rng = random.Random(3)
    texts = near_copies(rng, 12) + near_copies(rng, 12, 40)
    texts += [" ".join(f"x{rng.randrange(5000)}" for _ in range(30)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts + texts[:5])]
    got = J.join(make(rows), digest=poor).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_hot_signatures_ride_with_the_tasks(make, monkeypatch):
    """No row meets the list of hot signatures in a join."""
    monkeypatch.setattr(J, "SAMPLE", 1)
    monkeypatch.setattr(J, "HOT", 20)
    texts = make(list(enumerate(near_copies(random.Random(2), 80)))).selectExpr(
        "doc_id", "text", "xxhash64(text) AS text_key")
    number = J.partial(J._number, split=frozenset(), digest=S.digest)
    frequent = J._frequent(J._sample(texts))
    hot = J._hot(J._sample(texts), frequent, number)
    assert not hot.isEmpty()
    plan = J._rows(J._described(texts, frequent, number), hot)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_profiles_of_blocks_against_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 900, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.permutation(base[:n])[:n - gone],
                                      rng.integers(0, 2**64, gone, dtype=np.uint64))))
            for n in (60, 70, 130, 900) for gone in (0, 0, 5, 10, 20, 40)]
    sets += [np.unique(rng.integers(0, 2**64, 65, dtype=np.uint64)) for _ in range(5)]
    # elements of one class, whose count is capped
    sets += [np.unique(rng.integers(0, 2**40, n, dtype=np.uint64) << np.uint64(20)) for n in (400, 420, 1100)]
    sizes, profiles = np.array([len(s) for s in sets]), [S.profile(s) for s in sets]
    labels = rng.integers(0, 12, len(sets))
    for first in (np.arange(len(sets)), rng.permutation(len(sets))[:9]):
        second = np.setdiff1d(np.arange(len(sets)), first) if len(first) < len(sets) else first
        want = set()
        for a in first.tolist():
            for b in second.tolist():
                if labels[a] != labels[b] and S.may_link(int(sizes[a]), profiles[a], int(sizes[b]), profiles[b]):
                    want |= {a, b}
        assert set(np.flatnonzero(J._have_near(sizes, profiles, labels, first, second)).tolist()) == want
        assert 0 < len(want) < len(sets)


def test_links_of_large_blocks_take_little_memory():
    import tracemalloc
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 2**64, 2400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, 12)) for _ in range(1500)]
    sets += [s.copy() for s in sets[:40]] + [np.unique(rng.choice(pool, 12)) for _ in range(1460)]
    nodes = np.arange(3000)
    tracemalloc.start()
    got = J._forest(nodes, nodes, sets, np.arange(1500), np.arange(1500, 3000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(k, k + 1500) for k in range(40)} <= set(zip(got["a"], got["b"], strict=True))
    assert peak < 60e6          # 290 MB with all pairs held as wide numbers


def test_only_sets_that_may_link_are_sent(make, monkeypatch):
    """Texts that share a passage meet in large buckets, but few are alike."""
    monkeypatch.setattr(J, "SMALL", 4)
    sent = []
    blocks = J._block_links
    monkeypatch.setattr(J, "_block_links", lambda near, sets: sent.append(near.count()) or blocks(near, sets))
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(90000)}"
    passage = [word() for _ in range(40)]
    rows = [" ".join([word() for _ in range(60)] + passage + [word() for _ in range(60)]) for _ in range(60)]
    check(make, list(enumerate(rows)))
    assert sent == [0]


def families(rng, n, words=120):
    """Texts that keep most words of one text, in many of which a pair shares
    more than half of its shingles, but few link."""
    base = [f"w{rng.randrange(90000)}" for _ in range(words)]
    return [" ".join(edited(rng, base, rng.choice((3, 4, 5, 6)))) for _ in range(n)]


def test_pairs_of_many_common_buckets_are_sent_once(make, monkeypatch):
    """Alike texts share most of their large buckets; each pair is compared in
    the first one, and only sets of such pairs are shuffled."""
    monkeypatch.setattr(J, "SMALL", 4)
    sent = []
    blocks = J._block_links
    monkeypatch.setattr(J, "_block_links", lambda near, sets: sent.append((
        near.count(), near.select("node").distinct().count())) or blocks(near, sets))
    rng = random.Random(12)
    check(make, list(enumerate(families(rng, 60) + near_copies(rng, 20))))
    (rows, nodes), = sent
    assert nodes > 20
    assert rows < 8 * nodes         # 25 rows a node where each bucket sends its own


@pytest.mark.parametrize("named", (0, 1, 3))
def test_few_named_buckets_lose_no_link(make, monkeypatch, named):
    monkeypatch.setattr(J, "SMALL", 3)
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "ROUNDS", 1)
    monkeypatch.setattr(J, "MET", named)
    rng = random.Random(named)
    check(make, list(enumerate(families(rng, 40) + near_copies(rng, 30) + families(rng, 30, 90))))


def test_nodes_met_before_are_not_near():
    s = np.arange(60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sizes, profiles, both = np.full(4, 60), [S.profile(s)] * 4, np.arange(4)
    met = J._coded([np.array([5, 9]), [], np.array([9]), np.array([7])])
    assert met.shape == (4, 3) and met[0, 1] == met[2, 0] and (met[:, -1] == met.max()).all()
    assert J._have_near(sizes, profiles, np.arange(4), both[:1], both[2:3], met).sum() == 0
    assert J._have_near(sizes, profiles, np.arange(4), both[:1], both, met).tolist() == [True, True, False, True]
    assert J._have_near(sizes, profiles, np.arange(4), both[1:2], both, J._coded([[]] * 4)).all()


def test_only_profiles_of_pairs_are_shuffled(make, spark):
    """Nodes that no pair has leave before the join."""
    nodes = spark.range(5000).selectExpr("id AS node", "60L AS n_shingles", "unhex(repeat('04', 16)) AS profile")
    pairs = spark.createDataFrame([(3, 4), (7, 90)], "a long, b long")
    assert sorted(map(tuple, J._may_link(pairs, nodes).collect())) == [(3, 4), (7, 90)]
    assert J._only(nodes, J._ends(pairs)).count() < 50


def test_signatures_are_short():
    rng = np.random.default_rng(2)
    for n in (3, 70, 300, 1200):
        got = S.signatures(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)), np.empty(0, np.uint64))
        assert int(got.max()) < 2 ** S.SIGNATURE_BITS and len(np.unique(got)) == len(got)


def tasks_of(spark, work):
    """Spark tasks that ``work`` starts, by the job group's stages."""
    group = f"counted-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        work()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)


@pytest.fixture
def wide(spark):
    """Many partitions of a shuffle, none of them merged."""
    conf = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rounds_of_components_take_few_tasks(wide):
    """A round takes tasks by the number of edges, not by all partitions of each shuffle."""
    n = 3000
    rng = np.random.default_rng(3)
    chain = rng.permutation(n)
    pairs = pd.DataFrame({"a": np.concatenate([chain[:-1], chain[:500]]),
                          "b": np.concatenate([chain[1:], chain[500:1000]])})
    links = J.keep_table(wide.createDataFrame(pairs[pairs.index % 7 > 0]).coalesce(1), "test-links")
    labels = J.keep_table(wide.range(n).selectExpr("id AS node", "id AS label"), "test-labels")
    got = {}
    tasks = tasks_of(wide, lambda: got.update({r.node: r.label for r in J.components(labels, links).collect()}))
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links.collect():
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {k: find(k) for k in range(n)}
    assert tasks < 400, tasks


def test_key_map_takes_few_tasks(wide):
    keys = J.keep_table(wide.range(100_000).selectExpr("xxhash64(id) AS k").coalesce(2), "test-keys")
    maps = []
    tasks = tasks_of(wide, lambda: maps.append(J._key_map(keys, "k")))
    assert J._on_map(maps[0], np.array([r.k for r in keys.collect()], np.int64)).all()
    assert tasks < 50, tasks


def test_sets_of_all_rounds_are_one_scan(make):
    texts = make([(k, f"w{k} " + " ".join(f"x{k}_{j}" for j in range(12))) for k in range(6)]).selectExpr(
        "doc_id", "text", "xxhash64(text) AS text_key")
    number = J.partial(J._number, split=frozenset(), digest=S.digest)
    nodes = J.keep_table(J._described(texts, np.empty(0, np.uint64), number), "test-nodes")
    at = [r.node for r in nodes.orderBy("doc_id").collect()]
    pairs = [texts.sparkSession.createDataFrame([(at[j], at[k])], "a long, b long") for j, k in ((0, 1), (1, 2), (0, 2))]
    folder, sets = J.shared_scratch(texts.sparkSession, "test-sets"), None
    for p in pairs:
        sets = J._with_sets(texts, p, nodes, sets, number, folder)
    want = [(at[r.doc_id], S.shingle_set(r.text).tobytes()) for r in texts.filter("doc_id < 3").collect()]
    assert sorted((r.node, bytes(r.shingles)) for r in sets.collect()) == sorted(want)
    assert "Union" not in sets._jdf.queryExecution().optimizedPlan().toString()
