"""Subjects: held-out labelled documents, markup, edges."""

import random

import numpy as np

from tidewell.llm import subjects as S
from tidewell.llm import wiki


def test_bisecting_kmeans_separates():
    r = np.random.default_rng(1)
    c = np.eye(6)
    x = np.repeat(c, 20, axis=0) + r.normal(0, 0.05, (120, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaf = S.bisecting_kmeans(x.astype(np.float32), np.ones(120, np.float32), 6, 0.01)
    assert len(set(leaf)) == 6
    assert all(len(set(leaf[i * 20 : i * 20 + 20])) == 1 for i in range(6))


WORDS = {"music": ["album", "choir", "tempo", "opera", "drummer"], "law": ["statute", "jury", "verdict", "permit", "court"], "food": ["broth", "cheese", "oven", "spice", "dough"]}
FRAMES = ["A later study compared {n} cases of {a} with the {b}.", "Both are known for the {a}, while the {b} is rare.", "In {n} someone described a {a} without any {b}."]


def _doc(r, subjects, n=8):
    out = []
    for i in range(n):
        a, b = r.sample(WORDS[subjects[i % len(subjects)]], 2)
        out.append(r.choice(FRAMES).format(n=r.randint(1, 99), a=a, b=b))
    return "'''Page''' " + " ".join(out) + " Little else is known about it.\n\n{| class=\"x\"\n| the opera and the album\n|}\n[[Category:Music]]"


def test_held_out(spark):
    r = random.Random(2)
    docs, labels, truth = [], [], {}
    for i in range(400):
        s = r.sample(sorted(WORDS), r.choice([1, 1, 2]))
        docs.append((i, i, 0, _doc(r, s), "x"))
        truth[i] = set(s)
        if i < 200:
            labels += [(i, x, "ann") for x in (s if r.random() > 0.03 else ["food"])]
    docs += [(1000, 1, 0, "#REDIRECT [[Page]]", "x"), (1001, 1, 10, _doc(r, ["law"]), "x"), (1002, 1, 0, None, "x"), (1003, 1, 0, "", "x"), (None, 1, 0, _doc(r, ["law"]), "x"), (1004, 1, None, _doc(r, ["law"]), "x"), (0, 0, 0, docs[0][3], "x")]
    d = spark.createDataFrame(docs, "doc_id long, page_id long, namespace int, text string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    sub = spark.createDataFrame([(k,) for k in WORDS], "subject string")
    got = {}
    for x in S.found(d, lab, sub).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    assert got.pop(1004) == {"law"} and not {1000, 1001, 1002, 1003, None} & set(got)
    right = sum(got.get(i) == truth[i] for i in range(200, 400))
    assert right >= 190
    assert S.found(d.limit(0), lab, sub).count() == 0
    assert S.found(d, lab.limit(0), sub).count() == 0


def test_leaf_casts_the_vote():
    """The nearest leaf's mixture is the vote, also against the sentence's own terms."""
    lift = np.array([[3.0, -1, -1], [0.5, 2.5, -1], [-1, -1, 3], [0.1, 0.2, 0.1]])
    centroids = np.eye(3, 4, dtype=np.float32)
    mixtures = np.array([[0.95, 0.05, 0], [0.08, 0, 0.92], [0.5, 0.5, 0]], np.float32)
    m = S.Model(["a", "b", "c"], {"x": 0, "y": 1, "z": 2, "w": 3}, lift, np.ones(4), centroids, mixtures, 1.8)
    assert [(i, round(p, 2)) for i, p in m.vote((0,))] == [(0, 0.95), (1, 0.05)]
    assert [(i, round(p, 2)) for i, p in m.vote((1,))] == [(0, 0.08), (2, 0.92)]
    assert [(i, round(p, 2)) for i, p in m.vote((2,))] == [(0, 0.5), (1, 0.5)] and m.vote(()) == () and m.vote((3,)) == ()
    votes, of = m.shares("One y here. One y there. Only a w here.", {})
    assert of == 2 and round(votes[2], 2) == 1.84


def test_the_leaves_decide():
    """One leaf tells no subjects apart; enough leaves do, on documents not fitted on."""
    r = random.Random(4)
    made = [(s, _doc(r, s)) for s in (r.sample(sorted(WORDS), 1) for _ in range(300))]
    fit = [(t, i, s) for i, (s, t) in enumerate(made[:150])]

    def right(leaves):
        m = S.fit(fit, sorted(WORDS), leaves=leaves)
        n = 0
        for s, t in made[150:]:
            votes, of = m.shares(t, {})
            n += {m.subjects[i] for i, k in votes.items() if k >= S.SHARE * of} == set(s)
        return n / 150

    assert right(1) <= 0.05 and right(2) <= 0.75 and right(800) >= 0.95


def test_sample_is_bounded(spark):
    d = spark.createDataFrame([(i, i, "x" * 100) for i in range(50)], "doc_id long, page_id long, text string")
    lab = spark.createDataFrame([(i, "law") for i in range(50)], "doc_id long, subject string")
    assert len(S.labelled_sample(d, lab, most=20)) == 20 and len(S.labelled_sample(d, lab, most_bytes=1_050)) == 10


def test_rows_as_dense():
    r = np.random.default_rng(3)
    x = r.random((40, 9)) * (r.random((40, 9)) < 0.3)
    i, n = np.array([5, 0, 31]), np.array([1.0, 2.0, 3.0])
    got = S.Rows.of(x).take(i)
    assert np.allclose(got.dot(x[7]), x[i] @ x[7]) and np.allclose(got.total(n), n @ x[i])


def test_sentences_leave_markup_out():
    t = "{{Infobox\n| a = b\n}}\nFirst one here. Second [[a|one]] here.<ref>x y</ref>\n== Head ==\n<blockquote>Quoted words.</blockquote>\n{| t\n| cell words\n|}\n[[Category:X]]"
    assert [s for s in wiki.sentences(t)] == ["First one here.", "Second one here."]
