"""DartMinHash signatures of weighted sets, for many sets at once in numpy.

Each element owns the quarter plane of (weight, rank). It is cut in cells, the same for all sets: hashes of
element and cell say how many darts hit the cell (a Poisson number) and where. A set's element of weight w
takes the darts left of w. Each dart belongs to one coordinate; the one of least rank per coordinate is the
set's value there, and two sets agree on it with probability sum(min weights) / sum(max weights). Only
ranks below theta = darts / total weight are looked at, about DARTS darts for a set of any size; sets with
a coordinate that no dart reached are thrown again with a larger theta.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from rowloom.llm.textnp import mix

_C1, _C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_UNIT = 2.0**-53


def _weight_cell(i: int) -> tuple[float, float]:
    """[0,1), [1,2), [2,4), [4,8), [8,16), [16,24), ..."""
    edges = (0.0, 1.0, 2.0, 4.0)
    return (edges[i], edges[i + 1]) if i < 3 else (4.0, 8.0) if i == 3 else (8.0 * (i - 3), 8.0 * (i - 2))


def _rank_cell(v: int, levels: int = 6) -> tuple[float, float]:
    """[0, 2^-6), [2^-6, 2^-5), ..., [1/2, 1), [1, 2), [2, 3), ..."""
    if v == 0:
        return 0.0, 2.0**-levels
    if v <= levels:
        return 2.0 ** (v - 1 - levels), 2.0 ** (v - levels)
    return float(v - levels), float(v - levels + 1)


@lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """Distribution function of a Poisson number."""
    p, total, out, k = np.exp(-mean), 0.0, [], 0
    while total < 1 - 1e-15 and k < 40 + 20 * mean:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return np.array(out)


def _thrown(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, rank) of all darts below the owner's theta."""
    out_owner, out_hash, out_rank = [], [], []
    limit = theta[owner]
    v = 0
    while True:
        low, high = _rank_cell(v)
        own = np.flatnonzero(limit > low)
        if not len(own):
            break
        i = 0
        while True:
            left, right = _weight_cell(i)
            if i:
                own = own[weight[own] > left]
                if not len(own):
                    break
            h = mix(element[own] ^ np.uint64((v * 0x9E3779B97F4A7C15 + i * 0xC2B2AE3D27D4EB4F + 1) & (2**64 - 1)))
            n = np.searchsorted(_poisson((right - left) * (high - low)), (h >> np.uint64(11)) * _UNIT, "right")
            has = n > 0
            at, n, h = own[has], n[has], h[has]
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, dart = np.repeat(at, n), mix(np.repeat(h, n) + (which.astype(np.uint64) + np.uint64(1)) * _C1)
            rank = low + (high - low) * ((dart >> np.uint64(11)) * _UNIT)
            place = left + (right - left) * ((mix(dart ^ _C2) >> np.uint64(11)) * _UNIT)
            ok = (rank < limit[at]) & (place < weight[at])
            out_owner.append(owner[at[ok]])
            out_hash.append(dart[ok])
            out_rank.append(rank[ok])
            i += 1
        v += 1
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out_owner, np.int64), (out_hash, np.uint64), (out_rank, float)))  # type: ignore[return-value]


def signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, sets: int, k: int) -> np.ndarray:
    """(sets, k) unsigned 32-bit values. owner: for each element its set; a set without elements has zeros."""
    total = np.bincount(owner, weight, minlength=sets)
    out, darts = np.zeros((sets, k), np.uint32), k * (np.log(k) + 4)
    todo = np.flatnonzero(total > 0)
    # Elements of a set stand together.
    first = np.searchsorted(owner, np.arange(sets + 1))
    while len(todo):
        n = first[todo + 1] - first[todo]
        at = np.repeat(first[todo] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        theta = darts / total[todo]
        own, h, rank = _thrown(element[at], weight[at], np.repeat(np.arange(len(todo)), n), theta)
        cell = own * k + (mix(h + _C2) % np.uint64(k)).astype(np.int64)
        order = np.argsort(rank, kind="stable")[::-1]
        value = np.zeros(len(todo) * k, np.uint32)
        value[cell[order]] = (h[order] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # the least rank is written last
        value = value.reshape(len(todo), k)
        out[todo] = value
        todo = todo[(value == 0).any(1)]
        darts *= 4
    return out
