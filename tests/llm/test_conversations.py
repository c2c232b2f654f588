"""Conversations: every reason, dirt, ties, repeated and null rows, blocks of time."""

import json

from tidewell.llm import conversations as C

S = "id long, session_id string, role string, content string, metadata string, timestamp double, extra string"


def _rows(spark, rows):
    return spark.createDataFrame([(i, s, r, c, m, t, "x") for i, s, r, c, m, t in rows], S)


def _n(k):
    return json.dumps({"client": "x", "turn": k})


ROWS = [
    (1, "good", "Human ", "hi", None, 1700000000.0), (2, "good", "tool", "{}", None, 1700000001.0), (3, "good", "AI", "hello", None, 1700000002000.0),
    (5, "tie", "user", "q", None, 5.0), (6, "tie", "assistant", "a", None, 5.0), (7, "tie", "assistant", "a", None, 5.0),
    (10, "empty", "user", " ​", None, 1.0), (11, "empty", "system", "be nice", None, 2.0),
    (12, "blank", "user", "q", None, 1.0), (13, "blank", "assistant", "N/A", None, 2.0), (14, "blank", "assistant", "a", None, 3.0),
    (15, "open", "assistant", "a", None, 1.0), (16, "open", "user", "q", None, 2.0), (17, "open", "assistant", "a", None, 3.0),
    (18, "end", "user", "q", None, 1.0), (19, "end", "assistant", "a", None, 2.0), (20, "end", "user", "q2", None, 3.0),
    (21, "who", "user", "q", None, 1.0), (22, "who", None, "??", None, 2.0), (23, "who", "assistant", "a", None, 3.0),
    (24, "who-blank", "user", "q", None, 1.0), (25, "who-blank", "", "-", None, 2.0), (26, "who-blank", "assistant", "a", None, 3.0),
    (27, "gap", "user", "q", _n(0), 1.0), (28, "gap", "assistant", "a", _n(2), 3.0),
    (29, "head", "user", "q", _n(1), 1.0), (30, "head", "assistant", "a", _n(2), 3.0),
    (31, "full", "user", "q", _n(0), 1.0), (32, "full", "assistant", "a", _n(1), 3.0), (33, "full", "assistant", "a", _n(1), 3.0),
    (34, "late", "assistant", "a", None, 9.0), (35, "late", "user", "q", None, 8.0),
    (36, "bad-json", "user", "q", "{nope", 1.0), (37, "bad-json", "assistant", "…and so", "", 2.0),
    (38, None, "user", "q", None, None),
]
BAD = {"empty", "blank", "open", "end", "who", "gap", "head", None}


def test_found(spark):
    assert {r.session_id for r in C.found(_rows(spark, ROWS)).collect()} == BAD


def test_second_delivery_within_the_second(spark):
    """The copied row's later id neither ends a session nor hides that it ends on the user."""
    rows = [
        (1, "answered", "user", "q", None, 5.0), (2, "answered", "assistant", "a", None, 5.0), (3, "answered", "User", "q", None, 5.0),
        (4, "open end", "user", "q", None, 4.0), (5, "open end", "assistant", "a", None, 5.0), (6, "open end", "user", "q2", None, 5.0), (7, "open end", "assistant", "a", None, 5.0),
        (8, "numbered", "user", "q", _n(0), 5.0), (9, "numbered", "assistant", "a", _n(1), 5.0), (10, "numbered", "user", "q", _n(2), 5.0),
    ]
    got = {r.session_id: (r.reason, r.rows) for r in C.session_verdicts(_rows(spark, rows)).collect()}
    assert got == {"answered": (None, 3), "open end": ("no reply", 4), "numbered": (None, 3)}


def test_conversations(spark):
    got = {}
    for r in C.conversations(_rows(spark, ROWS)).collect():
        got.setdefault(r.session_id, []).append((r.turn, r.speaker, r.content))
    assert set(got) == {"good", "tie", "who-blank", "full", "late", "bad-json"}
    assert sorted(got["tie"]) == [(0, "user", "q"), (1, "assistant", "a")]
    assert sorted(got["good"]) == [(0, "user", "hi"), (1, "assistant", "hello")]
    assert sorted(got["late"]) == [(0, "user", "q"), (1, "assistant", "a")]


def test_long_session_in_blocks(spark, monkeypatch):
    from tidewell.operators import skew

    rows = [(i, "s", "user" if i % 3 else "assistant", f"t{i}", None, float(i) + (50_000 if i > 150 else 0)) for i in range(1, 303)] + [(400, "s", "assistant", "end", None, 1e6)]
    whole = sorted((r.segment, r.turn, r.speaker, r.rows, r.content) for r in C.conversations(_rows(spark, rows)).collect())
    plain = skew.with_blocks
    monkeypatch.setattr(skew, "with_blocks", lambda df, keys, order, **k: plain(df, keys, order, rows=20, cuts=16))
    parts = sorted((r.segment, r.turn, r.speaker, r.rows, r.content) for r in C.conversations(_rows(spark, rows)).collect())
    assert whole == parts and len(whole) > 150 and max(w[0] for w in whole) >= 1


def test_empty(spark):
    e = _rows(spark, ROWS).limit(0)
    assert C.found(e).count() == 0 and C.conversations(e).count() == 0
