"""DartMinHash: sketches of weighted sets whose coordinates agree with the weighted Jaccard similarity.

Every element of the universe owns a plane of weight by rank, on which darts are thrown once and
for all by hashing: the plane is cut into unit cells, a cell holds a Poisson(1) number of darts,
and each dart has a rank, a weight position and one of k coordinates, all of them functions of
(element, weight strip, rank cell, dart number). A set of total weight W looks at the darts under
its weights up to rank T/W, T = k (ln k + SLACK): k coordinates each keep the smallest rank. A rank
is as good as the name of its dart, so two sets keep the same rank in a coordinate with the
probability of their weighted Jaccard similarity. Sets with a coordinate left empty (one in e^SLACK)
throw on to twice the rank; looking further than needed changes nothing.

All of it runs in numpy over a batch of sets at once: the darts of an element are thrown once for
all sets of the batch that hold it, and each set then keeps its minima.
"""

from __future__ import annotations

import math

import numpy as np

#: How far beyond k ln k darts are thrown.
SLACK = 4.0
#: Darts looked at in one go, which bounds memory.
CHUNK = 1_500_000
#: Cumulative Poisson(1) probabilities; from 12 darts a cell on they round to one.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths laid end to end: each item's run, and its place in it."""
    run = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    end = np.cumsum(counts)
    return run, np.arange(end[-1] if len(end) else 0, dtype=np.int32) - (end - counts).astype(np.int32)[run]


def _throw(element: np.ndarray, strips: np.ndarray, first: int, cells: int, k: int, seed: int):
    """The darts of rank cells first .. cells-1 of each element's weight strips: how many each strip
    has, and of each dart, strip by strip, its coordinate, its rank and its hash."""
    e, s = _within(strips)
    with np.errstate(over="ignore"):
        base = mix(element + np.uint64(seed))[e] + s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = mix((base[:, None] + (np.arange(first, cells, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[None, :]).reshape(-1))
    darts = np.searchsorted(_POISSON, _unit(h)).astype(np.int32)
    d, j = _within(darts)
    with np.errstate(over="ignore"):
        a = mix(h[d] + (j + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    # the coordinate is taken from the low bits, the rank from the others
    coordinate = (((a & np.uint64(0xFFFF)) * np.uint64(k)) >> np.uint64(16)).astype(np.int32)
    rank = (d % np.int32(cells - first) + np.int32(first)).astype(np.float64) + (a >> np.uint64(16)).astype(np.float64) * 2.0**-48
    return darts.reshape(len(e), cells - first).sum(axis=1, dtype=np.int32), coordinate, rank, a


def _minima(out: np.ndarray, owner: np.ndarray, element: np.ndarray, weight: np.ndarray, first: int, cells: int, seed: int) -> None:
    """Lower out[set, coordinate] to the ranks of the darts that its elements see in these rank cells."""
    k = out.shape[1]
    unique, which = np.unique(element, return_inverse=True)
    strips = np.ceil(weight).astype(np.int32)
    most = np.zeros(len(unique), np.int32)
    np.maximum.at(most, which, strips)
    n, coordinate, rank, a = _throw(unique, most, first, cells, k, seed)
    start, strip_of = (np.cumsum(n) - n).astype(np.int32), (np.cumsum(most) - most).astype(np.int32)
    e, s = _within(strips)
    row = strip_of[which[e]] + s
    x, j = _within(n[row])
    dart = start[row][x] + j
    left = weight[e] - s
    if (left < 1).any():
        # a dart counts if it lies under the weight that is left in its strip
        under = _unit(mix(a[dart] ^ np.uint64(0xA5A5A5A5A5A5A5A5))) < left[x]
        x, dart = x[under], dart[under]
    np.minimum.at(out.reshape(-1), (owner[e] * np.int32(k))[x] + coordinate[dart], rank[dart])


def sketch(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, k: int, seed: int = 1) -> np.ndarray:
    """Signatures of `sets` weighted sets, an array [sets, k] of float64 ranks. owner: the set of each
    (element, weight), in ascending order; elements are 64-bit hashes, once a set; weights are
    positive. A set without elements has a signature of infinities."""
    out = np.full((sets, k), np.inf)
    total = np.bincount(owner, weight, sets)
    size = np.bincount(owner, minlength=sets)
    begin = np.cumsum(size) - size
    some = np.flatnonzero(total > 0)
    need = np.zeros(sets, np.int64)
    need[some] = np.ceil(k * (math.log(k) + SLACK) / total[some])
    # sets of about the same reach are done together: reaches are rounded up to quarters of powers of two
    grain = 2 ** np.maximum(0, np.floor(np.log2(np.maximum(need, 1))) - 2).astype(np.int64)
    need = -(-need // grain) * grain
    for reach in np.unique(need[some]):
        at = some[need[some] == reach]
        for part in np.array_split(at, max(1, math.ceil(total[at].sum() * reach / CHUNK))):
            first, cells, todo = 0, int(reach), part
            while len(todo):
                x, j = _within(size[todo])
                pick = begin[todo][x] + j
                local = np.full((len(todo), k), np.inf) if first == 0 else out[todo]
                _minima(local, x, element[pick].astype(np.uint64), weight[pick].astype(float), first, cells, seed)
                out[todo] = local
                todo = todo[np.isinf(local).any(axis=1)]
                first, cells = cells, cells * 2
    return out


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """[sets, k / rows] int64 keys: one per band of `rows` coordinates, the band's number hashed in."""
    n, k = signatures.shape
    b = k // rows
    s = np.ascontiguousarray(signatures[:, : b * rows]).view(np.uint64).reshape(n, b, rows)
    h = np.broadcast_to(mix(np.arange(1, b + 1, dtype=np.uint64)), (n, b)).copy()
    with np.errstate(over="ignore"):
        for i in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, i])
    return h.view(np.int64)
