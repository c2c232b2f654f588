"""Near duplicates: collision rates of the sketch, all pairs against brute force, classes, edges."""

import itertools
import random
import time
from collections import Counter

import numpy as np

from tidewell import session
from tidewell.llm import dartminhash as D
from tidewell.llm import neardup as N


def _sim(a, b):
    x, y = Counter(N.WORD.findall(a.lower())), Counter(N.WORD.findall(b.lower()))
    s = sum((x & y).values())
    t = sum(x.values()) + sum(y.values()) - s
    return s / t if t else 0.0


def test_collisions_follow_weighted_jaccard():
    r = np.random.default_rng(2)
    e = D.mix(np.arange(60, dtype=np.uint64))
    for frac in (1.0, 0.37):
        wa, wb = r.integers(0, 5, 60) * frac, r.integers(0, 5, 60) * frac
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        owner = np.r_[np.zeros((wa > 0).sum(), int), np.ones((wb > 0).sum(), int)]
        s = D.sketch(owner, np.r_[e[wa > 0], e[wb > 0]], np.r_[wa[wa > 0], wb[wb > 0]], 2, 2048)
        assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_sketch_of_nothing_and_of_much():
    s = D.sketch(np.zeros(50_000, int), D.mix(np.arange(50_000, dtype=np.uint64)), np.ones(50_000), 2, 64)
    assert np.isfinite(s[0]).all() and np.isinf(s[1]).all()


def _texts(n=60, seed=5):
    r = random.Random(seed)
    w = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        base = [r.choice(w) for _ in range(r.randint(8, 40))]
        out.append((f"a{i:03}", " ".join(base)))
        for j in range(r.randint(0, 3)):
            e = base[:]
            for _ in range(r.randint(0, max(1, len(e) // 8))):
                e[r.randrange(len(e))] = r.choice(w)
            r.shuffle(e)
            out.append((f"a{i:03}.{j}", ", ".join(e).upper() + "!"))
    return out


def test_pairs_equal_brute_force(spark):
    t = _texts() + [("empty1", ""), ("empty2", "?!"), ("n", None), (None, "w1 w2"), ("a000", _texts()[0][1])]
    df = spark.createDataFrame(t, "id string, text string")
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(df).collect()}
    ok = [(i, x) for i, x in dict((i, x) for i, x in t if i and x).items()]
    want = {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations(ok, 2) if _sim(x, y) >= 0.8}
    assert got == want and len(want) > 40


def test_repeats_count(spark):
    df = spark.createDataFrame([("a", "x x x x y"), ("b", "x y"), ("c", "Y x X x, x")], "id string, text string")
    assert {(r.id_a, r.id_b) for r in N.similar_pairs(df).collect()} == {("a", "c")}


def test_groups(spark):
    t = _texts(25, 9)
    df = spark.createDataFrame(t + [(f"copy{i}", t[0][1]) for i in range(5)], "id string, text string")
    rows = N.groups(df).collect()
    assert len(rows) == len(t) + 5
    group = {r.id: r.group_id for r in rows}
    for r in N.similar_pairs(df).collect():
        assert group[r.id_a] == group[r.id_b]
    assert {r.copies for r in rows if r.id.startswith("copy")} == {6}


def test_an_id_with_two_texts_joins_their_groups(spark):
    df = spark.createDataFrame([("x", "one two three four five six"), ("x", "seven eight nine ten eleven"), ("y", "one two three four five six"), ("z", "Seven, eight, nine, ten, eleven!"), ("o", "something else altogether here")], "id string, text string")
    assert {(r.id_a, r.id_b) for r in N.similar_pairs(df).collect()} == {("x", "y"), ("x", "z")}
    g = {r.id: r.group_id for r in N.groups(df).collect()}
    assert g["x"] == g["y"] == g["z"] != g["o"]


def test_parity_loses_no_pair(spark):
    """The parity filter against the same join without it, and a bucket that all classes share."""
    r = random.Random(1)
    base = [f"w{i}" for i in range(30)]
    t = []
    for i in range(60):
        e = base[:]
        for _ in range(1 + i // 12):
            e[r.randrange(30)] = f"v{i}{r.random()}"
        t.append((f"{i:02}", " ".join(e)))
    t.append(("long1", " ".join(f"u{i}" for i in range(5000))))
    t.append(("long2", " ".join(f"u{i}" for i in range(200, 5200))))
    df = spark.createDataFrame(t, "id string, text string")
    s = N.sketches(df).withColumn("bands", N.F.expr("array(1)"))
    names = {x.cls: x.id for x in s.collect()}
    got = {tuple(sorted((names[x.a], names[x.b]))) for x in N._pairs(s, 0.8).collect()}
    texts = dict(t)
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if _sim(texts[a], texts[b]) >= 0.8}
    assert want <= got and len(got) < 61 * 62 // 2 and ("long1", "long2") in want


def test_parity_sorts_out_chance_meetings_of_long_texts(spark):
    """Texts of 150 words of which half are common to all, in one bucket: only the similar pair is a candidate."""
    common = [f"w{i}" for i in range(75)]
    t = [(f"{i:02}", " ".join(common + [f"v{i}x{j}" for j in range(75)])) for i in range(40)]
    t.append(("twin", t[0][1].replace("v0x0 ", "other ")))
    s = N.sketches(spark.createDataFrame(t, "id string, text string")).withColumn("bands", N.F.expr("array(1)"))
    names = {x.cls: x.id for x in s.collect()}
    assert {tuple(sorted((names[x.a], names[x.b]))) for x in N._pairs(s, 0.8).collect()} == {("00", "twin")}


def test_a_released_cut_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before, setting = files(), spark.conf.get(session._RELEASE)
    rows = session.cut(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "t", release=True).collect()
    for _ in range(25):
        if not files() - before:
            break
        time.sleep(0.2)
    assert len(rows) == 7 and not files() - before and spark.conf.get(session._RELEASE) == setting


def test_passes_find_the_pairs_of_all_bands(spark):
    df = spark.createDataFrame(_texts(30, 3), "id string, text string")
    s = N.sketches(df).drop("id").distinct()
    pairs = lambda x: {(r.a, r.b) for r in x.collect()}
    assert pairs(N._candidates(s, 0.8, N.BANDS)) == pairs(N._pairs(s, 0.8)) != set()


def test_weighted_sketch_equals_unrolled_collisions():
    """Counts enter the sketch as weights: the collision rate follows the similarity with repeats."""
    a, b = Counter({f"w{i}": 1 + i % 4 for i in range(40)}), Counter({f"w{i}": 1 + (i + i // 9) % 4 for i in range(3, 40)})
    want = sum((a & b).values()) / sum((a | b).values())
    m = N._Hashes()
    rows = [N._bag(" ".join(w for w, n in x.items() for _ in range(n)), m) for x in (a, b)]
    owner = np.repeat([0, 1], [len(w) for w, _ in rows])
    s = D.sketch(owner, np.concatenate([w for w, _ in rows]), np.concatenate([c for _, c in rows]).astype(float), 2, 4096)
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_empty(spark):
    e = spark.createDataFrame([], "id string, text string")
    assert N.similar_pairs(e).count() == 0 and N.groups(e).count() == 0
