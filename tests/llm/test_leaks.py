"""Leaks: the winnowing guarantee against brute force, markup, edges."""

import random

from tidewell.llm import leaks as L
from tidewell.llm import wiki


def _longest(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                now[j] = prev[j - 1] + 1
                best = max(best, now[j])
        prev = now
    return best


def test_equals_brute_force(spark):
    r = random.Random(4)
    w = [f"t{i}" for i in range(12)]  # few words: many chance repeats
    items = [(i, " ".join(r.choice(w) for _ in range(r.randint(5, 60)))) for i in range(25)]
    docs = []
    for i in range(60):
        t = [r.choice(w) for _ in range(r.randint(0, 80))]
        if r.random() < 0.7:
            src = r.choice(items)[1].split()
            n = r.randint(15, 26)
            a = r.randrange(max(1, len(src) - n))
            p = r.randint(0, len(t))
            t[p:p] = src[a : a + n]
        docs.append((i, ", ".join(t)))
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.words for x in L.leaks(d, e).collect()}
    want = {}
    for i, t in docs:
        for j, u in items:
            n = _longest(wiki.visible_words(t), wiki.WORD.findall(u.lower()))
            if n >= L.RUN:
                want[i, j] = n
    assert got == want and len(want) >= 10
    assert {(x.doc_id, x.item_id): x.words for x in L.leaks(d, e, block=4).collect()} == want


def test_markup_and_edges(spark):
    words = [f"word{i}" for i in range(24)]
    t = " ".join(words)
    marked = "{{Infobox x\n| a = 1\n}}\n'''" + " ".join(words[:6]) + "''' [[target page|" + words[6] + "]] [[" + words[7] + "]]<ref>note</ref> " + " ".join(words[8:12]).upper() + ",\n" + " ".join(words[12:18]) + "<!-- hidden words --> " + " ".join(words[18:]) + "{{cite}}"
    table = '{| class="wikitable"\n|-\n! x\n|-\n| ' + t + "\n|}"
    docs = spark.createDataFrame([(1, marked, "e"), (2, table, "e"), (3, " ".join(words[:19]), "e"), (4, None, "e"), (5, "", "e"), (None, t, "e"), (1, marked, "e")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, t), (8, None), (9, "short text"), (None, t)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in L.found(docs, items).collect()} == {(1, 7), (2, 7)}
    assert L.found(docs.limit(0), items).count() == 0
    assert L.found(docs, items.limit(0)).count() == 0
