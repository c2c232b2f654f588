"""Surprise by online recurrent learning.

A small recurrent net predicts a value vector from a key vector, one step per turn; its error before
the update is the turn's surprise. The net is a set of groups, one per output, each a few neurons
whose first is the output; every neuron sees the key and all outputs of the step before. Gradients
are carried forward in time by a block-diagonal sensitivity matrix (one block per group), so that a
step costs the same at any length. Weights move by a clipped adaptive step with decay; a step is
written only where the error exceeds a floor, and its rate follows the error's ratio to its own
exponential mean. Gates learn by their local gradient alone.

A key's stream is inherently ordered: its rows are sorted by time and pass through its net one after
the other, in Arrow batches, so memory is the net and never the history; keys run in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Sizes, rates and floors of the net."""

    keys: int = 64
    values: int = 16
    hidden: int = 32
    rate: float = 0.003
    floor: float = 0.001
    smooth: float = 0.05
    decay: float = 1e-5
    clip: float = 1.0
    slope: float = 0.01
    seed: int = 42


class Net:
    """The state of one stream."""

    def __init__(self, s: Settings = Settings()) -> None:
        self.s = s
        self.groups = s.values
        self.size = -(-(s.hidden + s.values) // s.values)
        n = self.groups * self.size
        self.width = 1 + s.keys + n
        r = np.random.default_rng(s.seed)
        scale = np.sqrt(2.0 / (self.width + n))
        self.w = r.normal(0, scale, (n, self.width))
        self.gate_w, self.gate_b = r.normal(0, scale, (n, self.width)), np.full(n, -1.0)
        self.y = np.zeros(n)
        # sensitivity of each group's neurons to the weights of that group
        self.p = np.zeros((self.groups, self.size, self.size, self.width))
        self.moments = {x: (np.zeros_like(getattr(self, x)), np.zeros_like(getattr(self, x))) for x in ("w", "gate_w", "gate_b")}
        self.t = 0
        self.ema: float | None = None
        self.steps = self.writes = 0
        self.outputs = np.arange(self.groups) * self.size

    def look(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        z = np.concatenate([[1.0], key, self.y])
        a = np.clip(self.w @ z, -50, 50)
        linear = np.zeros(len(a), bool)
        linear[self.outputs] = True
        cand = np.where(linear | (a > 0), a, self.s.slope * a)
        slope = np.where(linear | (a > 0), 1.0, self.s.slope)
        g = 1 / (1 + np.exp(-np.clip(self.gate_w @ z + self.gate_b, -50, 50)))
        return z, cand, slope, g, g * self.y + (1 - g) * cand

    def step(self, key: np.ndarray, value: np.ndarray) -> tuple[float, float, bool]:
        """(surprise, its mean, written) of one pair."""
        z, cand, slope, g, y = self.look(key)
        error = value - y[self.outputs]
        surprise = float(np.mean(error**2))
        self.ema = surprise if self.ema is None else self.s.smooth * surprise + (1 - self.s.smooth) * self.ema
        written = surprise > self.s.floor
        if written:
            self._learn(error, z, cand, g, self.s.rate * min(surprise / max(self.ema, 1e-12), 5.0))
            self.writes += 1
        self._carry(z, slope, g)
        self.y = y
        self.steps += 1
        return surprise, self.ema, written

    def _learn(self, error: np.ndarray, z: np.ndarray, cand: np.ndarray, g: np.ndarray, rate: float) -> None:
        """One adaptive step: the weights by the sensitivities carried so far, the gates by the local
        gradient, a group's error times (y before - candidate) through the gate."""
        n = self.size * self.groups
        grad = (error[:, None, None] * self.p[:, 0]).reshape(n, self.width)
        size = np.linalg.norm(grad)
        if size > self.s.clip:
            grad *= self.s.clip / size
        self.t += 1
        local = np.repeat(error, self.size) * (self.y - cand) * g * (1 - g)
        self.gate_w *= 1 - rate * self.s.decay
        for name, move, fade in (("w", grad, self.s.decay), ("gate_w", local[:, None] * z[None, :], 0.0), ("gate_b", local, 0.0)):
            m, v = self.moments[name]
            m *= 0.9
            m += 0.1 * move
            v *= 0.999
            v += 0.001 * move**2
            x = getattr(self, name)
            x *= 1 - rate * fade
            x += rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)

    def _carry(self, z: np.ndarray, slope: np.ndarray, g: np.ndarray) -> None:
        """The sensitivities after this step: what the gate keeps, and what flows through the group's own weights."""
        k = self.size
        block = self.w[:, 1 + self.s.keys :].reshape(self.groups, k, self.groups, k)
        own = block[np.arange(self.groups), :, np.arange(self.groups), :]
        flow = np.einsum("gij,gjkw->gikw", own, self.p)
        flow[:, np.arange(k), np.arange(k), :] += z
        shape = (self.groups, k, 1, 1)
        p = g.reshape(shape) * self.p + ((1 - g) * np.maximum(slope, 0.01)).reshape(shape) * flow
        self.p = np.clip(p, -1e3, 1e3)

    def reset(self) -> None:
        """Forget the recent past, keep the weights."""
        self.y[:] = 0
        self.p[:] = 0

    def reset_full(self) -> None:
        """Back to the first state."""
        self.__init__(self.s)

    def fade(self, share: float) -> None:
        self.w *= 1 - share

    def fingerprint(self) -> str:
        """What a stored state must share with a net that it is loaded into: its settings."""
        return json.dumps(asdict(self.s), sort_keys=True)

    def to_json(self, recurrent: bool = True) -> str:
        """The state as text; without its recurrent part the loaded net starts with no past."""
        keep = ["w", "gate_w", "gate_b"] + (["y", "p"] if recurrent else [])
        return json.dumps({"fingerprint": self.fingerprint(), "t": self.t, "ema": self.ema, "steps": self.steps, "writes": self.writes, "arrays": {k: getattr(self, k).tolist() for k in keep}, "moments": {k: [x.tolist() for x in v] for k, v in self.moments.items()}})

    @classmethod
    def from_json(cls, text: str, s: Settings = Settings()) -> Net:
        """The stored net; a fresh one if it was stored with other settings."""
        got, net = json.loads(text), cls(s)
        if got["fingerprint"] != net.fingerprint():
            return net
        for k, x in got["arrays"].items():
            setattr(net, k, np.array(x))
        net.moments = {k: tuple(np.array(x) for x in v) for k, v in got["moments"].items()}
        net.t, net.ema, net.steps, net.writes = got["t"], got["ema"], got["steps"], got["writes"]
        return net

    @property
    def write_ratio(self) -> float:
        return self.writes / self.steps if self.steps else 0.0

    @property
    def warm(self) -> bool:
        """Enough steps for the surprise to mean something."""
        return self.steps >= 50


def embedded(texts: pd.Series, size: int) -> np.ndarray:
    """Unit vectors of hashed words: the same text has the same vector in any process."""
    import xxhash

    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = xxhash.xxh3_64_intdigest(w)
            out[i, h % size] += 1.0 if (h >> 40) & 1 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def surprises(turns: DataFrame, key: str, settings: Settings = Settings()) -> DataFrame:
    """turns(key, id, ts, role, content) -> key, id, surprise, ema, ratio, written of each user and
    assistant turn, in order of (ts, id). A user turn is learnt against itself; an assistant turn
    against the user turn before it. Other roles are passed over."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, net, pending = object(), Net(settings), None
        for pdf in batches:
            k, v = embedded(pdf["content"], settings.keys), embedded(pdf["content"], settings.values)
            out = []
            for i, (own, role) in enumerate(zip(pdf[key], pdf["role"], strict=True)):
                if (own if own == own else None) != now:
                    now, net, pending = own if own == own else None, Net(settings), None
                if role == "user":
                    pending = k[i]
                    out.append(net.step(k[i], v[i]))
                else:
                    out.append(net.step(pending if pending is not None else k[i], v[i]))
                    pending = None
            s, e = np.array([o[0] for o in out]), np.array([o[1] for o in out])
            yield pd.DataFrame({key: pdf[key], "id": pdf["id"], "surprise": s, "ema": e, "ratio": s / np.maximum(e, 1e-12), "written": np.array([o[2] for o in out], bool)})

    rows = turns.filter(F.col("role").isin("user", "assistant")).select(key, "id", "ts", "role", "content")
    kind = dict(rows.dtypes)
    # ordered rows stream through the net batch by batch: no group is ever held whole
    ordered = rows.repartition(key).sortWithinPartitions(key, "ts", "id")
    return ordered.mapInPandas(fold, f"{key} {kind[key]}, id {kind['id']}, surprise double, ema double, ratio double, written boolean")


def replay(rows: Iterator[tuple[np.ndarray, np.ndarray]], net: Net, most: int = 60) -> Net:
    """Warm-up: at most `most` pairs, oldest first."""
    for n, (k, v) in enumerate(rows):
        if n >= most:
            break
        net.step(k, v)
    return net
