"""Two-stage suffix sorting of many short strings, and the common prefixes of neighbours in the order."""

from __future__ import annotations

import numpy as np


def two_stage(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of the strings data[offsets[i]:offsets[i+1]], in the order of their first `depth` bytes.

    A suffix ends with its string. Suffixes smaller than their successors (the suffixes one byte later) are sorted
    directly. Each other suffix is induced: the buckets of first bytes are scanned in ascending order, and every
    suffix found there puts its predecessor, if that is larger, at the next place of its own bucket.
    """
    n, strings = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64)
    # One separator, smaller than any byte, ends each string.
    sizes = np.diff(offsets)
    shift = np.repeat(np.arange(strings), sizes)
    text = np.zeros(n + strings, np.int16)
    text[np.arange(n) + shift] = data.astype(np.int16) + 1
    ends = offsets[1:] + np.arange(strings)
    total = len(text)
    # smaller[i]: suffix i < suffix i + 1; within a run of equal bytes what follows the run decides.
    step = np.flatnonzero(np.diff(text) != 0)
    nxt = step[np.searchsorted(step, np.arange(total - 1))] if len(step) else np.zeros(0, np.int64)
    smaller = np.zeros(total, bool)
    smaller[:-1] = text[nxt] < text[nxt + 1]
    smaller[ends] = False
    direct = np.flatnonzero(smaller)
    raw, stop = data.tobytes(), np.repeat(offsets[1:], sizes)
    at = direct - np.searchsorted(ends, direct)  # the place in data
    until = np.minimum(at + depth, stop[at]).tolist()
    keys = [raw[i:j] for i, j in zip(at.tolist(), until, strict=True)]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    heads: list[list[np.ndarray]] = [[] for _ in range(257)]  # induced suffixes of each bucket, in order
    first = text[direct]
    tails = {int(c): direct[first == c] for c in np.unique(first)}
    out = []
    present = np.zeros(257, bool)
    present[np.unique(text)] = True

    def induce(suffixes: np.ndarray, own: int) -> np.ndarray:
        """Deals out the larger predecessors; returns those that fall in the bucket `own` itself."""
        before = suffixes - 1
        before = before[before >= 0]
        before = before[~smaller[before] & (text[before] > 0)]
        symbols = text[before]
        for c in np.unique(symbols):
            if c != own:
                heads[c].append(before[symbols == c])
        return before[symbols == own]

    induce(ends, 0)
    for c in np.flatnonzero(present[1:]) + 1:
        waiting = heads[c]
        while waiting:
            part = np.concatenate(waiting)
            out.append(part)
            again = induce(part, c)
            waiting = [again] if len(again) else []
        if c in tails:
            out.append(tails[c])
            induce(tails[c], c)
    order = np.concatenate(out)
    return order - np.searchsorted(ends, order)


def common_prefixes(data: np.ndarray, order: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, `depth` at most; room: bytes that are left."""
    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return lcp
    width = 8
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, width)
    a, b = order[:-1], order[1:]
    most = np.minimum(np.minimum(room[a], room[b]), depth)
    live, shared = np.arange(len(a)), np.zeros(len(a), np.int64)
    for at in range(0, depth, width):
        if not len(live):
            break
        differs = words[a[live] + at] != words[b[live] + at]
        run = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        shared[live] = np.minimum(at + run, most[live])
        live = live[(run == width) & (at + width < most[live])]
    lcp[1:] = shared
    return lcp


def repeated(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of substrings of `length` bytes, and a number that is equal for equal ones.

    The starts come in suffix order, so equal substrings are neighbours: their common prefix is `length`.
    """
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    order = two_stage(data, offsets, length)
    order = order[room[order] >= length]
    lcp = common_prefixes(data, order, room, length)
    return order, np.cumsum(lcp < length)
