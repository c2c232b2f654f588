"""Pairs: each defect, hard cases that are none, questions across blocks, edges."""

import random

import pytest

from tidewell.llm import answers as A
from tidewell.llm import refusals as R

M = "id long, session_id string, role string, content string, timestamp double, turn_id string"
T = "turn_id long, session_id string, role string, content string, timestamp double"


REFUSED = ["I'm sorry, but I can't help with that.", "As an assistant I must decline this request.", "Unfortunately this is something I'm unable to assist with. Please ask someone else.", "i wont answer that", "Darüber möchte ich nicht sprechen.", "Es tut mir leid, dabei kann ich nicht helfen.", "Je suis désolé, je ne peux pas aider à ce sujet.", "Je préfère ne pas répondre.", "Lo siento, no puedo ayudar con eso.", "No se me permite hablar de ello.", "My apologies, I have to pass on this one; there is nothing I may tell you."]
#: Phrasings that no example has.
OTHERWISE = ["I'm going to have to pass on that.", "That's not something I can get into.", "I'd prefer to leave that question alone, sorry.", "This falls outside my remit.", "Dazu sage ich nichts.", "Das beantworte ich nicht.", "Je ne répondrai pas à cela.", "No voy a contestar eso.", "Eso no te lo puedo decir.", "I'm afraid I can't be of assistance here.", "My principles forbid me from answering.", "Ich sehe mich außerstande, darauf zu antworten.", "Je m'abstiens de tout commentaire.", "Me abstengo de opinar.", "I'd better not comment on that.", "Nope, I will not go there.", "I have nothing to share about this.", "Regretfully, I must withhold an answer."]


@pytest.mark.parametrize("t", REFUSED)
def test_refusals(t):
    assert R.judge()(t)


def test_refusals_phrased_otherwise():
    assert sum(map(R.judge(), OTHERWISE)) >= 0.9 * len(OTHERWISE)


def test_held_out_phrasings():
    r, j = random.Random(3), R.judge()
    for k, frames in ((2, R.REFUSING), (1, R.COURTEOUS), (0, R.SAYING)):
        held = frames[3::4]
        assert sum(x == k for x in j.clauses([R._filled(r, f) for f in held])) >= 0.9 * len(held)


@pytest.mark.parametrize("t", ["I cannot stress enough that it needs a restart first; after that it works.", "Sorry for the late reply, the fix is to raise the limit.", "You can't run both at once.", "Leider startet es nur nach dem Planer, danach geht es.", "I can't help with that, but the log says the queue is full.", "I don't know yet, the planner will tell.", "", "done", "Stop the queue first.", "The form was declined twice, so the limit is lower now."])
def test_no_refusals(t):
    assert not R.judge()(t)


def test_copies():
    q, m = "What is the safest way to move the planner to the archive?", A.copy_limits()
    copy = lambda a: A.is_copy(q, a, m)
    assert copy(q) and copy(q.upper()) and copy(f"You asked: {q}") and copy(f"{q}\n{q}") and copy(q.replace("safest", "quickest"))
    assert not copy(f"> {q}\nStop the queue first, then copy the folder and start it again.")
    assert not copy("Move the planner after the archive run has ended and the queue is empty.")
    assert not copy("ok")


def test_compression_decides_copies():
    """No limit on what is left over: nothing is a copy; any: everything is."""
    q, a = "What is the safest way to move the planner to the archive?", "Stop the queue first, then copy the folder and start it again."
    assert not A.is_copy(q, q, A.Limits(0.0, 0.0, 0.0)) and A.is_copy(q, a, A.Limits(9.0, 9.0, 9.0))


def _messages(spark):
    base = []
    n = 100
    for i in range(300):
        base += [(n, f"s{i}", "user", "How do I stop the planner when the queue is full of old records?", float(n), "x"), (n + 1, f"s{i}", "assistant", "You stop the planner with the red switch, and the queue will be empty after that.", float(n + 1), "x")]
        n += 2
    for i in range(60):
        base += [(n, f"d{i}", "user", "Wie kann ich den Planer stoppen, wenn die Liste voll ist und nicht mehr geht?", float(n), "x"), (n + 1, f"d{i}", "assistant", "Der Planer ist mit dem Schalter zu stoppen, und die Liste wird danach leer.", float(n + 1), "x")]
        n += 2
    rows = [
        (1, "a", "user", "How do I stop the planner when the queue is full?", 1.0, ""), (2, "a", "assistant", " – ", 2.0, ""), (3, "a", "bot", "I'm sorry, but I can't help with that.", 3.0, ""),
        (4, "b", "Human", "How do I stop the planner when the queue is full?", 1.0, ""), (5, "b", "AI", "Der Planer ist mit dem Schalter zu stoppen, und die Liste wird danach leer.", 2.0, ""),
        (6, "c", "user", "Please answer in German: How do I stop the planner when the queue is full?", 1.0, ""), (7, "c", "assistant", "Der Planer ist mit dem Schalter zu stoppen, und die Liste wird danach leer.", 2.0, ""),
        (8, "d", "user", "How do I stop the planner when the queue is full?", 1.0, ""), (9, "d", "assistant", "You stop the planner with the red switch, and the que", 2.0, ""), (10, "d", "assistant", "You stop the planner with the red switch, and the que", 2.0, ""),
        (11, "e", "user", "How do I stop the planner when the queue is full?", 1.0, ""), (12, "e", "tool", "{}", 1.5, ""), (13, "e", "model", "How do I stop the planner when the queue is full?", 2.0, ""),
        (14, "f", "user", "How do I stop the planner?", 1.0, ""), (15, "f", "assistant", "```\nplanner run --limit 5\n```", 2.0, ""), (16, "f", "assistant", "done", 3.0, ""),
        (17, "g", "assistant", None, 1.0, ""), (None, "g", "assistant", "x", 1.0, ""), (18, None, "assistant", "You stop the planner with the red switch, and the queue will be empty after that", None, ""),
    ]
    return spark.createDataFrame(base + rows, M)


def test_found(spark):
    turns = spark.createDataFrame([(1, "x", "user", "How do I stop the planner when the queue is full?", 1.0), (2, "x", "assistant", "", 2.0), (2, "x", "assistant", "", 2.0)], T)
    got = {(r.table_name, r.answer_id, r.defect) for r in A.found(_messages(spark), turns).collect()}
    assert got == {("messages", 2, "empty"), ("messages", 3, "refusal"), ("messages", 5, "language"), ("messages", 9, "truncated"), ("messages", 10, "truncated"), ("messages", 13, "copy"), ("messages", 17, "empty"), ("turns", 2, "empty")}


def test_questions_across_blocks(spark, monkeypatch):
    from tidewell.operators import skew

    m = _messages(spark)
    t = spark.createDataFrame([], T)
    whole = sorted((r.id, r.question) for r in A.pairs(A.all_rows(m.selectExpr("id", "'one' AS session_id", "role", "content", "coalesce(timestamp, 0.5) AS timestamp"), t)).collect() if r.id > 30)
    plain = skew.with_blocks
    monkeypatch.setattr(skew, "with_blocks", lambda df, keys, order, **k: plain(df, keys, order, rows=50, cuts=8))
    parts = sorted((r.id, r.question) for r in A.pairs(A.all_rows(m.selectExpr("id", "'one' AS session_id", "role", "content", "coalesce(timestamp, 0.5) AS timestamp"), t)).collect() if r.id > 30)
    assert whole == parts and len(whole) == 360


def test_long_runs_of_user_rows(spark, monkeypatch):
    """All user rows since the previous answer, also more than six and over block borders."""
    from tidewell.operators import skew

    rows = [(1, "s", "assistant", "hello", 1.0, "")] + [(i, "s", "user", f"part {i}", float(i), "") for i in range(2, 12)] + [(12, "s", "user", " ", 12.0, ""), (13, "s", "assistant", "first", 13.0, ""), (14, "s", "assistant", "second", 14.0, "")]
    rows = A.all_rows(spark.createDataFrame(rows, M), spark.createDataFrame([], T))
    want = {1: None, 13: "\n".join(f"part {i}" for i in range(2, 12)), 14: "part 11"}
    assert {r.id: r.question for r in A.pairs(rows).collect()} == want
    plain = skew.with_blocks
    monkeypatch.setattr(skew, "with_blocks", lambda df, keys, order, **k: plain(df, keys, order, rows=3, cuts=8))
    assert {r.id: r.question for r in A.pairs(rows).collect()} == want


def test_empty(spark):
    assert A.found(spark.createDataFrame([], M), spark.createDataFrame([], T)).count() == 0
