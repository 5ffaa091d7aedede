"""The E8 lattice: nearest points, and the points around them."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.stack(out)


_SHORT = minimal_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    miss = x[odd] - near[odd]
    worst = np.abs(miss).argmax(axis=1)
    near[odd, worst] += np.where(miss[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The lattice point nearest to each row: E8 is the even integer points and the same shifted by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def probes(x: np.ndarray, count: int) -> np.ndarray:
    """For each row its nearest lattice point, then the count - 1 nearest of the 240 around that."""
    own = decode(x)
    if count == 1:
        return own[:, None]
    closeness = (x - own) @ _SHORT.T  # all have one length, so the largest product is the nearest
    top = np.argpartition(-closeness, count - 2, axis=1)[:, : count - 1]
    return np.concatenate([own[:, None], own[:, None] + _SHORT[top]], axis=1)
