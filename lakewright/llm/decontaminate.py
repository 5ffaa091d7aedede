"""Test items that leaked into documents, found up to an error budget.

An item with budget k has k + 1 pieces that do not overlap, so any passage within k edits of it holds one piece unchanged.
Pieces are even parts of the item; where some of them stand in many items, as in templates, shorter ones are taken around
what is rare. They are found by the hashes of their first bytes, with one index for each class of lengths. Hits that suggest
the same place are joined to one window, in which Myers' bit-parallel algorithm gives the least edit distance of the item
to any substring, unless too few of the item's short grams stand there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POWERS, groups, mixed, prefix_sums, row_key, span_hashes, typed, utf8
from .toxicity import _MARK, lowered

CHUNK = 1 << 18
ITEM_BYTES = 16 << 20  # of item text that a pass over the documents takes
_CLASS = 1.5  # the longest piece of an index is less than this many times the shortest
_RARE, COMMON = 8, 16  # bytes of grams that are counted over items, and items that make one common
_SHORT = 5  # bytes of the grams that bound a distance
_GRAMS = 1 << 20  # grams that are looked up at a time


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one mark between them; the new offsets, and where each byte comes from."""
    low = lowered(data)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != _MARK) | (low[:-1] != _MARK)
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[offsets], np.flatnonzero(keep)


def distance(pattern: bytes, text: bytes, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of text (to a prefix, if anchored) and where that first ends."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high, carry = (1 << m) - 1, 1 << (m - 1), int(anchored)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 | carry, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
        if score < best:
            best, end = score, j + 1
    return best, end


def _grams(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte substrings, by their start, from prefix sums."""
    n = len(sums) - k
    return mixed((sums[k:] - sums[:n]) * POWERS.reach(n)[1]) if n > 0 else np.zeros(0, np.uint64)


def _sums(text: bytes) -> np.ndarray:
    return prefix_sums(np.frombuffer(text, np.uint8))


def _common_grams(texts: list[bytes]) -> np.ndarray:
    """Sorted hashes of the grams of _RARE bytes that more than COMMON texts hold."""
    found = [np.unique(_grams(_sums(t), _RARE)) for t in texts]
    hashes, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0))
    return hashes[n > COMMON]


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of x is in a sorted array."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def cut(text: bytes, pieces: int, common: np.ndarray) -> list[tuple[int, int]]:
    """Starts and lengths of as many pieces that do not overlap: even parts, or shorter ones that all hold a rare gram."""
    edges = [len(text) * i // pieces for i in range(pieces + 1)]
    even = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    rare = ~_among(_grams(_sums(text), _RARE), common) if len(common) else np.ones(1, bool)
    if rare.all():
        return even
    before = np.concatenate([[0], np.cumsum(rare)])
    if all(n < _RARE or before[a + n - _RARE + 1] > before[a] for a, n in even):
        return even
    starts = np.flatnonzero(rare)
    for size in range(len(text) // pieces, _RARE - 1, -2):
        out, free = [], 0
        while len(out) < pieces:
            # A piece begins so that it ends with the next rare gram, or as far left as it may.
            k = np.searchsorted(starts, free)
            if k == len(starts):
                break
            at = max(free, int(starts[k]) - (size - _RARE))
            if at + size > len(text):
                break
            out.append((at, size))
            free = at + size
        if len(out) == pieces:
            return out
    return even


@dataclass
class Index:
    """Pieces by the hash of their first `gram` bytes."""

    gram: int
    hashes: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    size: np.ndarray
    full: np.ndarray  # hashes of the whole pieces
    table: np.ndarray  # whether a piece's hash begins with these bits
    shift: np.uint64

    @classmethod
    def build(cls, pieces: list[tuple[int, int, int]], texts: list[bytes]) -> Index:
        """pieces: length, place and item, the longest first."""
        gram = pieces[-1][0]
        size, at, owner = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        ends = np.cumsum(size)
        sums = _sums(b"".join(texts[o][a : a + n] for n, a, o in pieces))
        hashes, full = span_hashes(sums, ends - size, ends - size + gram), span_hashes(sums, ends - size, ends)
        order = np.argsort(hashes, kind="stable")
        bits = max(16, (16 * len(pieces)).bit_length())  # at most one slot in sixteen is taken
        table, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
        table[hashes >> shift] = True
        return cls(gram, hashes[order], owner[order], at[order], size[order], full[order], table, shift)

    def hits(self, sums: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, items, and places within the items, of pieces that stand whole and within one text."""
        h = _grams(sums, self.gram)
        place = np.flatnonzero(self.table[h >> self.shift])
        lo, hi = np.searchsorted(self.hashes, h[place], side="left"), np.searchsorted(self.hashes, h[place], side="right")
        n = hi - lo
        piece = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place = np.repeat(place, n)
        fits = place + self.size[piece] <= offsets[np.searchsorted(offsets, place, side="right")]
        place, piece = place[fits], piece[fits]
        same = span_hashes(sums, place, place + self.size[piece]) == self.full[piece]
        return place[same], self.owner[piece[same]], self.at[piece[same]]


@dataclass
class Items:
    """Normalised test items and the indexes of their pieces."""

    ids: list
    texts: list[bytes]
    budgets: list[int]
    indexes: list[Index] = field(default_factory=list)
    short: dict[int, dict[bytes, list[int]]] = field(default_factory=dict)  # items found by whole words, by bytes and text

    @classmethod
    def build(cls, rows: list[tuple], error_rate: float, shortest: int, short_items: bool = False) -> Items:
        ids, texts, budgets = [], [], []
        short: dict[int, dict[bytes, list[int]]] = {}
        for item_id, text in rows:
            raw = (text or "").encode()
            norm = normalised(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes().strip(bytes([_MARK]))
            if len(norm) < shortest:
                if norm and short_items:
                    short.setdefault(len(norm), {}).setdefault(norm, []).append(len(ids))
                    ids.append(item_id), texts.append(norm), budgets.append(0)
                continue
            ids.append(item_id), texts.append(norm), budgets.append(int(len(norm) * error_rate))
        whole = [i for i, t in enumerate(texts) if len(t) >= shortest]
        common = _common_grams([texts[i] for i in whole])
        pieces = sorted(((size, at, i) for i in whole for at, size in cut(texts[i], budgets[i] + 1, common)), reverse=True)
        classes: list[list[tuple[int, int, int]]] = []
        for p in pieces:
            if not classes or p[0] * _CLASS <= classes[-1][0][0]:
                classes.append([])
            classes[-1].append(p)
        return cls(ids, texts, budgets, [Index.build(c, texts) for c in classes], short)

    @cached_property
    def grams(self) -> list[np.ndarray]:
        """Each item's grams of _SHORT bytes."""
        return [_grams(_sums(t), _SHORT) for t in self.texts]

    def possible(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Whether windows lo..hi of a text, given by its grams of _SHORT bytes, may hold their items.

        An edit changes at most _SHORT grams, so most of an item's grams stand in the window. Windows that begin near each
        other are looked at together, as one.
        """
        out = np.ones(len(item), bool)
        order = np.argsort(lo, kind="stable")
        i = 0
        while i < len(order):
            j, total, start, end = i, 0, int(lo[order[i]]), 0
            while j < len(order) and lo[order[j]] <= start + 64 and (j == i or total < _GRAMS):
                total, end, j = total + len(self.grams[item[order[j]]]), max(end, int(hi[order[j]])), j + 1
            own = [self.grams[x] for x in item[order[i:j]]]
            size = np.array([len(x) for x in own])
            there = np.concatenate([[0], np.cumsum(_among(np.concatenate(own), np.sort(short[start : max(start, end - _SHORT + 1)])))])
            ends = np.cumsum(size)
            budget = np.array([self.budgets[x] for x in item[order[i:j]]])
            out[order[i:j]] = there[ends] - there[ends - size] >= size - _SHORT * budget
            i = j
        return out

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Text, item and place of each short item's first copy between word bounds of a text."""
        edge = np.append(data == _MARK, True)
        edge[offsets] = True  # of the text's last byte, too, as an end
        starts = np.flatnonzero(edge[:-1])
        starts = np.unique(np.concatenate([starts + (data[starts] == _MARK), offsets[:-1]]))
        starts = starts[starts < len(data)]
        raw, done = data.tobytes(), set()
        for size, known in self.short.items():
            at = starts[starts + size <= len(data)]
            number = np.searchsorted(offsets, at, side="right") - 1
            fits = (at + size <= offsets[number + 1]) & edge[at + size]
            for p, d in zip(at[fits].tolist(), number[fits].tolist(), strict=True):
                for item in known.get(raw[p : p + size], ()):
                    if (d, item) not in done:
                        done.add((d, item))
                        yield d, item, p

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """Row, item, distance, first and last source byte of the best passage for each row and item that match."""
        data, offsets = utf8(texts)
        for i, j in groups(np.diff(offsets), CHUNK):
            norm, at, source = normalised(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sums = prefix_sums(norm)
            found = [x.hits(sums, at) for x in self.indexes]
            place, owner, within = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            if not len(place) and not self.short:
                continue
            doc, item, lo, hi = self._windows(np.searchsorted(at, place, side="right") - 1, owner, place - within, at)
            raw = norm.tobytes()
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            if self.short:
                best = {(d, item): (0, p, p + len(self.texts[item])) for d, item, p in self.words(norm, at)}
            if len(doc):
                kept = self.possible(item, lo, hi, _grams(sums, _SHORT))
                doc, item, lo, hi = doc[kept], item[kept], lo[kept], hi[kept]
            for d, item, lo, hi in zip(doc.tolist(), item.tolist(), lo.tolist(), hi.tolist(), strict=True):
                k, pattern, window = self.budgets[item], self.texts[item], raw[lo:hi]
                errors, end = (0, p + len(pattern)) if (p := window.find(pattern)) >= 0 else distance(pattern, window)
                if errors > k or best.get((d, item), (errors + 1,))[0] <= errors:
                    continue
                back = distance(pattern[::-1], window[:end][::-1], anchored=True)[1] if errors else len(pattern)
                best[d, item] = errors, lo + end - back, lo + end
            for (d, item), (errors, a, b) in sorted(best.items()):
                base = int(offsets[i]) - int(offsets[i + d])
                yield i + d, item, errors, base + int(source[a]), base + int(source[b - 1]) + 1

    def _windows(self, doc: np.ndarray, item: np.ndarray, start: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, item, begin and end of the windows in which an item may stand: suggested starts that are near each other
        make one."""
        order = np.lexsort((start, item, doc))
        doc, item, start = doc[order], item[order], start[order]
        budget = np.array(self.budgets, np.int64)[item]
        new = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + 2 * budget[1:] + 1)
        first = np.flatnonzero(np.append(True, new)) if len(doc) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
        doc, item, budget, size = doc[first], item[first], budget[first], np.array([len(t) for t in self.texts], np.int64)
        return doc, item, np.maximum(start[first] - budget, offsets[doc]), np.minimum(start[last] + size[item] + budget, offsets[doc + 1])


def _batches(benchmark: DataFrame, error_rate: float, shortest: int, short_items: bool = False) -> Iterator[Items]:
    """The items in parts of bounded size; one part unless the table holds more than ITEM_BYTES."""
    rows = typed(benchmark, item_id="long", text="string").where("text is not null").withColumn("k", row_key("item_id", "text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-2 * total // ITEM_BYTES) if total > ITEM_BYTES else 1
    for p in range(parts):
        yield Items.build([(r.item_id, r.text) for r in rows.where(F.pmod("k", F.lit(parts)) == p).distinct().collect()], error_rate, shortest, short_items)


def contamination(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06, shortest: int = 16, short_items: bool = False) -> DataFrame:
    """The test items that documents hold: doc_id, item_id, distance, start, end; one row for each document and item.

    Takes doc_id and text of docs, item_id and text of benchmark. Both are lower-cased, and whatever lies between words
    counts as one space. A document holds an item if some substring is within floor(error_rate * bytes of the item) byte
    edits; the leftmost of the best is reported, in code points of the source, end exclusive. Items under `shortest`
    normalised bytes match with short_items only, where they stand without error between word bounds. Null items and those
    without words never match; null and empty texts hold nothing. Repeated rows are reported each.
    """
    sc = docs.sparkSession.sparkContext
    docs = typed(docs, doc_id="long", text="string")
    out = None
    for items in _batches(benchmark, error_rate, shortest, short_items):
        shared = sc.broadcast(items)

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                text = batch.column("text")
                rows = list(items.matches(text))
                raw = [text[r].as_py().encode() for r, *_ in rows]
                point = [(len(t[:a].decode("utf-8", "ignore")), len(t[:b].decode("utf-8", "ignore"))) for t, (*_, a, b) in zip(raw, rows, strict=True)]
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([items.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([a for a, _ in point], pa.int64()), pa.array([b for _, b in point], pa.int64())],
                    ["doc_id", "item_id", "distance", "start", "end"],
                )

        part = docs.mapInArrow(found, "doc_id long, item_id long, distance int, start long, end long")
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06, shortest: int = 16) -> DataFrame:
    """The rows of docs, all columns, that hold no test item (see contamination) but short ones, which chance brings."""
    sc = docs.sparkSession.sparkContext
    for items in _batches(benchmark, error_rate, shortest):
        docs = docs.where(_clean(sc.broadcast(items))("text"))
    return docs


def _clean(shared: Broadcast):
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            ok = np.ones(len(texts), bool)
            ok[[r for r, *_ in shared.value.matches(texts)]] = False
            yield pa.array(ok)

    return F.arrow_udf(clean, "boolean")
