"""Truncation: a planted limit is found and no other, endings, edges."""

import random

from pyspark.sql import functions as F

from tidewell.llm import endings as E
from tidewell.llm import truncation as T

W = "the old planner keeps every record of the small queue and sends them to the log".split()


def _sentence(r):
    return " ".join(["the", r.choice(["old", "small"]), r.choice(["planner", "queue", "log"]), "keeps", "every", r.choice(["record", "entry"]), "of", "the", r.choice(["planner", "queue", "log"])]) + "."


def _made(n, seed, cut_at=None):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t = " ".join(_sentence(r) for _ in range(r.randint(1, 8)))
        full = t
        if cut_at and len(t) > cut_at:
            t = t[:cut_at]
        elif r.random() < 0.2:
            t = t[:-1]  # whole, without its stop
        out.append((i, t, full))
    return out


def test_limit_is_found_and_whole_texts_are_not(spark):
    rows = _made(800, 1, 200)
    eps = spark.createDataFrame([(f"e{i}", t, '{"source": "s1"}') for i, t, _ in rows] + [("n", None, None), ("b", " ", None), ("e0", rows[0][1], '{"source": "s1"}')], "id string, text string, metadata string")
    dec = spark.createDataFrame([(1, "S2", "the old planner keeps every record of the small queue and", "the old planner keeps every record of the small queue and more")], "decision_id long, source string, episode_text string, source_text string")
    j = {r.row_id: r for r in T.judged(eps, dec).collect()}
    cut = {f"e{i}" for i, t, full in rows if len(t) == 200 and len(full) > 200 and not t.rstrip().endswith(".")}
    got = {k for k, r in j.items() if r.truncated}
    assert cut <= got and "1" in got and len(cut) > 100
    assert not {f"e{i}" for i, t, full in rows if t == full} & got
    assert len({f"e{i}" for i, t, full in rows if t == full[:-1] and len(t) < 195} & got) == 0
    assert "n" not in j and "b" not in j


def test_copies_do_not_teach_their_cut(spark):
    rows = [(f"e{i}", t, '{"source": "s1"}') for i, t, _ in _made(400, 2)]
    tail = "old planner sends each record and every entry to the"
    rows += [(f"c{i}", tail, '{"source": "s1"}') for i in range(20)]
    eps = spark.createDataFrame(rows, "id string, text string, metadata string")
    dec = spark.createDataFrame([(i, "s2", tail, None) for i in range(20)], "decision_id long, source string, episode_text string, source_text string")
    got = {r.row_id: r for r in T.judged(eps, dec).collect()}
    copies = [got[f"c{i}"] for i in range(20)] + [got[str(i)] for i in range(20)]
    assert all(r.truncated and not r.at_limit for r in copies)


def test_limits_only_where_planted(spark):
    r = random.Random(5)
    lengths = [("a", "chars", r.randint(50, 400), True) for _ in range(3000)] + [("a", "chars", r.randint(50, 400), False) for _ in range(400)] + [("a", "chars", 255, False)] * 60
    df = spark.createDataFrame(lengths, "source string, unit string, length int, ended boolean")
    assert [x.length for x in T.limits(df).collect()] == [255]
    assert T.limits(df.limit(0)).count() == 0


def test_open_and_marks():
    assert E.is_open('Payload was {"job": "x", "st') and E.is_open("see (the long note") and E.is_open("```\ncode")
    assert not E.is_open("see (the note)") and not E.is_open('{"a": 1}') and not E.is_open("plain text")
    assert E.unmarked("cut here...") == "cut here" and E.unmarked("cut [truncated]") == "cut" and E.unmarked("whole.") == "whole."


def test_empty(spark):
    e = spark.createDataFrame([], "id string, text string, metadata string")
    d = spark.createDataFrame([], "decision_id long, source string, episode_text string, source_text string")
    assert T.found(e, d).count() == 0
    assert T.report(e, d).agg(F.count(F.lit(1))).first()[0] == 0


def test_branches_are_counted_apart(spark):
    """Each cut record is flagged for one reason, and the report's counts add up to it."""
    rows = [(f"a{i}", f"The planner copies archive number {i} to the other shelf, then it sto"[:60], '{"source": "fixed"}') for i in range(40)]
    rows += [(f"w{i}", f"The planner has moved {i * 7} boxes {'and one more ' * (i % 9)}to the shelf.", '{"source": "fixed"}') for i in range(300)]
    rows += [("o", "It ends in a bracket (which nobody ever closed", '{"source": "free"}')]
    e = spark.createDataFrame(rows, "id string, text string, metadata string")
    d = spark.createDataFrame([], "decision_id long, source string, episode_text string, source_text string")
    got = {r.row_id: r.by for r in T.judged(e, d).collect()}
    assert all(got[f"a{i}"] == "limit" for i in range(40)) and got["o"] == "open" and got["w1"] is None
    for r in T.report(e, d).collect():
        assert r.cut_off == r.by_limit + r.by_source_text + r.by_open + r.by_ending
