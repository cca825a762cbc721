"""DartMinHash: weighted signatures by throwing darts.

A weighted set gives every element i the region [0, w_i) of a weight axis. A Poisson process of darts, the same for
all sets since hashes of (element, unit cell of the weight axis, number of the dart) draw it, falls on weight x rank
with density 1. A set sees the darts below its weights; those of rank below t / (total weight) are about t in
number. Each dart is hashed to one of k coordinates and a coordinate keeps its earliest dart. Two sets agree in a
coordinate with the probability of their weighted Jaccard similarity, sum of minima over sum of maxima.
With t = k ln k + 2 k few coordinates stay empty; sets that have one are thrown at again with twice the darts, which
leaves earlier minima as they are. The work is (unit cells + darts), so sparse, for each set.
"""

from __future__ import annotations

import math

import numpy as np

from symloom.llm.common import mix

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Unit cells that are thrown at together; bounds the memory, also for one very long text.
CELLS = 200_000
#: Darts that are drawn in one step.
THROW = 1 << 16


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def cells(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and width (1, or the fraction in an element's last cell) of every unit cell below the weights."""
    n = np.ceil(weights).astype(np.int64)
    start = np.cumsum(n) - n
    no = np.arange(n.sum()) - np.repeat(start, n)
    width = np.minimum(1.0, np.repeat(weights, n) - no)
    return mix(np.repeat(elements, n) + no.astype(np.uint64) * _A), width


def _throw(key: np.ndarray, width: np.ndarray | None, owner: np.ndarray, limit: np.ndarray, k: int, rank: np.ndarray, sig: np.ndarray) -> None:
    """Lowers ``rank`` and sets ``sig`` (owner x k, flat) by the darts of cells ``key`` that are below ``limit``."""
    at = np.zeros(len(key))
    slots, ranks, darts, j = [], [], [], 0
    while len(key):
        m = int(max(1, min(np.ceil((limit - at).mean()), THROW // len(key))))  # darts of each cell at once
        no = np.arange(j + 1, j + m + 1).astype(np.uint64) * _B
        j += m
        h = mix(key[:, None] + no)
        ranks_ = at[:, None] + np.cumsum(-np.log(_unit(h)), axis=1)
        hit = ranks_ < limit[:, None]
        at = ranks_[:, -1]
        live = hit[:, -1]
        if width is not None:
            hit &= _unit(mix(h + _C)) < width[:, None]
        which = np.flatnonzero(hit)
        dart = mix(h.ravel()[which] ^ _A)
        slots.append(owner[which // m] * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64))
        ranks.append(ranks_.ravel()[which])
        darts.append(dart)
        key, at, owner, limit = key[live], at[live], owner[live], limit[live]
        width = None if width is None else width[live]
    slot, r, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
    np.minimum.at(rank, slot, r)
    won = r == rank[slot]
    sig[slot[won]] = dart[won]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[np.ndarray | None]:
    """k darts (uint64) of each (element hashes, positive weights); None for an empty set."""
    out: list[np.ndarray | None] = [None] * len(sets)
    todo = sorted((i for i, (e, _) in enumerate(sets) if len(e)), key=lambda i: float(sets[i][1].sum()))
    times = 1.0
    while todo:
        failed, block, size = [], [], 0
        for n, i in enumerate(todo):
            block.append(i)
            size += int(sets[i][1].sum()) + 1
            if size >= CELLS or n == len(todo) - 1:
                failed += _block(sets, block, k, times, out)
                block, size = [], 0
        todo, times = failed, times * 2
    return out


def _block(sets: list, block: list[int], k: int, times: float, out: list) -> list[int]:
    t = times * (k * math.log(max(k, 2)) + 2 * k)
    rank, sig = np.full(len(block) * k, np.inf), np.zeros(len(block) * k, np.uint64)
    parts = [cells(*sets[i]) for i in block]
    key, width = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    size = [len(p[0]) for p in parts]
    owner = np.repeat(np.arange(len(block)), size)
    limit = np.repeat([t / float(sets[i][1].sum()) for i in block], size)
    whole = bool((width == 1.0).all())
    ends = np.searchsorted(np.cumsum(limit + 1), np.arange(THROW, float((limit + 1).sum()) + THROW, THROW))
    for a, e in zip(np.concatenate(([0], ends[:-1])), ends):
        b = slice(a, max(a + 1, e))
        _throw(key[b], None if whole else width[b], owner[b], limit[b], k, rank, sig)
    full = np.isfinite(rank).reshape(len(block), k).all(1)
    for n, i in enumerate(block):
        if full[n]:
            out[i] = sig[n * k : (n + 1) * k]
    return [i for n, i in enumerate(block) if not full[n]]


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())
