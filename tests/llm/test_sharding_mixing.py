from collections import Counter
from itertools import pairwise

import pytest

from chatlens.llm import mixing, sharding


def test_table_gives_equal_parts_and_moves_little():
    held = sharding.fill_table()
    counts = Counter(held)
    assert len(held) == sharding.SLOTS and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(held, fewer, strict=True))
    assert moved < 3 * sharding.SLOTS / len(sharding.SHARDS)


def test_table_against_plain_turns():
    names, slots = ("a", "b", "c"), 7
    wish = {n: [(sharding._hash(n, "offset") + j * (sharding._hash(n, "step") % 6 + 1)) % 7
                for j in range(7)] for n in names}
    want: dict[int, int] = {}
    while len(want) < slots:
        for k, n in enumerate(names):
            if len(want) < slots:
                want[next(s for s in wish[n] if s not in want)] = k
    assert sharding.fill_table(names, slots) == [want[s] for s in range(slots)]


@pytest.mark.parametrize("shards, slots", [((), 7), (("a", "a"), 7), (("a", "b"), 8), (("a", "b", "c"), 2)])
def test_bad_tables(shards, slots):
    with pytest.raises(ValueError):
        sharding.fill_table(shards, slots)


def test_place_odd_rows(make, odd):
    docs = make(odd)
    out = sharding.place(docs)
    assert out.columns[:len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + 2
    rows = out.collect()
    assert len(rows) == len(odd) and all(r[-1] in sharding.SHARDS for r in rows)
    assert len({r[-1] for r in rows if r.doc_id == 6}) == 1
    assert sharding.place(make([])).collect() == []
    spread = sharding.place(make([(None, f"t{k}") for k in range(200)])).collect()
    assert len({r[-1] for r in spread}) > 30


def played(weights, n):
    """Earliest deadline first, slot by slot."""
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    for slot in range(n):
        ready = [s for s in weights if done[s] * total // weights[s] <= slot]
        pick = min(ready, key=lambda s: (-(-(done[s] + 1) * total // weights[s]), list(weights).index(s)))
        assert -(-(done[pick] + 1) * total // weights[pick]) > slot      # no deadline is missed
        done[pick] += 1
        yield pick, dict(done)


@pytest.mark.parametrize("weights", [mixing.WEIGHTS, {"a": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 1, "b": 1},
                                     {"a": 997, "b": 2, "c": 1}, {"a": 3, "b": 5, "c": 11, "d": 13}])
def test_period_keeps_within_one_block(weights):
    total = sum(weights.values())
    laid = mixing.period(weights)
    assert [x[2] for x in laid] == list(range(total))
    for slot, (pick, done) in enumerate(played(weights, 3 * total)):
        assert pick == laid[slot % total][0]
        for s, w in weights.items():
            assert abs(done[s] * total - w * (slot + 1)) < total


def test_schedule_of_a_table(make):
    weights = {"a": 5, "b": 3, mixing.OTHER: 2}
    rows = [(k, f"t{k}", None, "a" if k < 700 else "b" if k < 900 else [None, "zz"][k % 2]) for k in range(1000)]
    got = sorted(mixing.schedule(make(rows), weights, block=4).collect(), key=lambda r: r.position)
    assert sorted(r.doc_id for r in got) == list(range(1000))
    assert len({r.position for r in got}) == 1000
    blocks = Counter((r.source if r.source in weights else "*", r.block) for r in got)
    assert max(blocks.values()) <= 4
    done = Counter()
    for r in got:
        done[r.source if r.source in weights else "*"] += 1
        assert r.release <= r.slot < r.deadline and r.position // 4 == r.slot
        if r.on_target and (r.position + 1) % 4 == 0:
            for s, w in weights.items():
                assert abs(done[s] / 4 - w * (r.slot + 1) / 10) < 1
    assert any(not r.on_target for r in got) and any(r.on_target for r in got)


def test_mixed_order_keeps_all_rows(make, odd):
    docs = make([(*r, None, ["src0", "src1", None][k % 3]) for k, r in enumerate(odd)])
    out = mixing.in_mixed_order(docs, block=1)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    order = [r.position for r in mixing.schedule(docs, block=1).sort("position").collect()]
    assert all(a < b for a, b in pairwise(order))
    assert mixing.in_mixed_order(make([])).collect() == []
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"src0": 1})


def test_written_files_hold_the_mixed_order(make, tmp_path):
    """The files that the pipeline's stage leaves, read one after the other,
    hold the blocks in their order: on the prefix where the weights hold, no
    source is a block away from its share."""
    import pyarrow.parquet as pq

    weights, block = {"a": 5, "b": 3, mixing.OTHER: 2}, 4
    docs = make([(k, f"t{k}", None, "a" if k < 700 else "b" if k < 900 else "zz") for k in range(1000)])
    mixing.in_mixed_order(docs, weights, block).write.parquet(str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*.parquet"))
    ids = [k for f in files for k in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    placed = sorted(mixing.schedule(docs, weights, block).collect(), key=lambda r: r.position)
    assert ids == [r.doc_id for r in placed]
    source = {r.doc_id: r.source if r.source in weights else mixing.OTHER for r in placed}
    prefix = [k for k, r in zip(ids, placed, strict=True) if r.on_target]
    assert len(prefix) >= 100
    for n in range(block, len(prefix) + 1, block):
        done = Counter(source[k] for k in prefix[:n])
        assert all(abs(done[s] - n * w / 10) < block for s, w in weights.items())


def test_native(make, odd):
    for df in (mixing.schedule(make(odd)), mixing.in_mixed_order(make(odd))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "InPandas" not in plan and "Cartesian" not in plan
