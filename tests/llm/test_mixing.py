"""Mixing: the Pfair bound, caps on repeats, shares, edges."""

import pytest

from tidewell.llm import mixing as M


@pytest.mark.parametrize("shares", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.98, "b": 0.01, "c": 0.01}, {f"s{i}": 1.0 for i in range(7)}, {"only": 1.0}, {"a": 1 / 3, "b": 2 / 3}])
def test_lag_stays_below_one_block(shares):
    parts = M.weights(shares, 1000)
    assert sum(parts.values()) == 1000
    done = dict.fromkeys(parts, 0)
    slots = set()
    for s, block, slot in sorted(M.period(parts), key=lambda x: x[2]):
        done[s] += 1
        assert done[s] == block and slot not in slots
        slots.add(slot)
        for k, p in parts.items():
            assert abs(done[k] - p * (slot + 1) / 1000) < 1
    assert done == parts


def _tables(spark):
    docs = [(i, ["Big", "big ", "BIG"][i % 3], f"word {i} " * 20) for i in range(300)] + [(1000 + i, "small-one", "tiny text here " * 10) for i in range(10)] + [(2000, None, "x y"), (2001, "other", "x y"), (None, "big", "x"), (2002, "big", ""), (2003, "big", None)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("big", 0.6, 1), ("small_one", 0.3, 4), ("missing", 0.1, 2)], "source string, target_share double, max_repeats int")
    return d, t


def test_mix(spark):
    d, t = _tables(spark)
    rows = M.mix(d, t, block=64).collect()
    uses = {}
    for r in rows:
        uses.setdefault((r.source, r.doc_id), []).append(r.use)
    assert all(sorted(u) == list(range(1, len(u) + 1)) for u in uses.values())
    assert max(len(u) for (s, _), u in uses.items() if s == "small_one") == 4 and all(len(u) == 1 for (s, _), u in uses.items() if s == "big")
    rep = {r.source: r for r in M.report(d, t, block=64).collect()}
    assert rep["missing"].used_tokens == 0
    assert abs(rep["big"].reached_share - 2 / 3) < 0.03 and abs(rep["small_one"].reached_share - 1 / 3) < 0.03
    assert len({(r.slot) for r in rows if r.source == "big"} & {r.slot for r in rows if r.source == "small_one"}) == 0


def test_total_beyond_what_there_is(spark):
    d, t = _tables(spark)
    rep = {r.source: r for r in M.report(d, t, total=10**9).collect()}
    assert rep["small_one"].most_uses == 4 and rep["big"].most_uses == 1


def test_empty(spark):
    d, t = _tables(spark)
    assert M.mix(d.limit(0), t).count() == 0 and M.mix(d, t.limit(0)).count() == 0
