"""The online net: its gradient step against the formulas, learning, storing, counters that survive."""

import numpy as np

from tidewell.streaming import neural as N


def test_sizes():
    n = N.Net()
    assert (len(n.w), n.width, n.groups, n.size) == (48, 113, 16, 3)


def test_step_against_the_formulas():
    s = N.Settings(keys=3, values=2, hidden=2, floor=0.0)
    n = N.Net(s)
    r = np.random.default_rng(1)
    for _ in range(5):
        n.step(r.normal(size=3), r.normal(size=2))
    key, value = r.normal(size=3), r.normal(size=2)
    z, cand, slope, g, y = n.look(key)
    w, gb, p, before = n.w.copy(), n.gate_b.copy(), n.p.copy(), n.y.copy()
    (m, v), (gm, gv) = ([x.copy() for x in n.moments[k]] for k in ("w", "gate_b"))
    surprise, ema, _ = n.step(key, value)
    error = value - y[n.outputs]
    assert np.isclose(surprise, np.mean(error**2))
    rate, t = s.rate * min(surprise / ema, 5.0), n.t
    grad = np.concatenate([error[i] * p[i, 0] for i in range(2)])
    grad *= min(1.0, 1.0 / np.linalg.norm(grad))
    m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
    assert np.allclose(n.w, w * (1 - rate * s.decay) + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
    local = np.repeat(error, n.size) * (before - cand) * g * (1 - g)
    gm, gv = 0.9 * gm + 0.1 * local, 0.999 * gv + 0.001 * local**2
    assert np.allclose(n.gate_b, gb + rate * (gm / (1 - 0.9**t)) / (np.sqrt(gv / (1 - 0.999**t)) + 1e-8))
    for i in range(2):
        rows = slice(i * n.size, (i + 1) * n.size)
        own = n.w[rows, 1 + s.keys + i * n.size : 1 + s.keys + (i + 1) * n.size]
        for a in range(n.size):
            for b in range(n.size):
                flow = sum(own[a, c] * p[i, c, b] for c in range(n.size)) + (z if a == b else 0)
                want = g[rows][a] * p[i, a, b] + (1 - g[rows][a]) * max(slope[rows][a], 0.01) * flow
                assert np.allclose(n.p[i, a, b], want)


def test_learns_and_gates_move():
    n, r = N.Net(N.Settings(keys=8, values=4, hidden=8)), np.random.default_rng(2)
    pairs = [(r.normal(size=8) / 3, r.normal(size=4) / 3) for _ in range(3)]
    gate = n.gate_w.copy()
    first = [n.step(*pairs[i % 3])[0] for i in range(30)]
    last = [n.step(*pairs[i % 3])[0] for i in range(3000)][-30:]
    assert np.mean(last) < 0.7 * np.mean(first) and not np.allclose(gate, n.gate_w)
    assert n.warm and 0 < n.write_ratio <= 1


def test_stored_state_goes_on():
    s = N.Settings(keys=4, values=2, hidden=2)
    a, r = N.Net(s), np.random.default_rng(3)
    rows = [(r.normal(size=4), r.normal(size=2)) for _ in range(20)]
    for x in rows[:10]:
        a.step(*x)
    b = N.Net.from_json(a.to_json(), s)
    assert [a.step(*x) for x in rows[10:]] == [b.step(*x) for x in rows[10:]]
    other = N.Net.from_json(a.to_json(), N.Settings(keys=4, values=2, hidden=4))
    assert other.steps == 0
    a.reset_full()
    assert a.steps == 0 and np.allclose(a.w, N.Net(s).w)


def test_counter_survives_a_restart(spark, tmp_path):
    from tidewell.streaming import bus

    src, ck, seen = str(tmp_path / "in"), str(tmp_path / "ck"), []
    for part in range(3):
        spark.range(7).write.mode("append").parquet(src)
        bus.every(bus.files(spark, src, "id long"), 10, seen.append, ck).awaitTermination()
    assert seen == [14, 21]
