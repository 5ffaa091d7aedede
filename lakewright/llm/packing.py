"""Packing of tokenized documents into sequences of fixed length by bin completion.

Only the counts of pieces by length decide how sequences are filled, so the plan is made on the driver from at most
`capacity` numbers, whatever the size of the corpus. Branch and bound: the longest piece left opens a sequence, its
undominated completions are enumerated, branches whose waste exceeds what a better plan may have are cut, and
best-fit plans are the first incumbents. Each piece then finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, groups, prefix_sums, span_hashes, tidy, typed, utf8, words

CACHED = 300_000  # words after which a worker's cache becomes the older of its two
CHUNK = 1 << 20
STEPS = 100_000  # of the plan's search
# A word of a line, told apart from the signs after it; other words have neither.
_WORD = re.compile(r"^(?:([a-zß-öø-ÿ]+)([.,!?;:]*)|.*)$", re.M)


class WordTokenizer:
    """Ids of whole texts, made word by word and kept: white space never joins what lies on its two sides.

    Holds for tokenizers that drop white space, lower-case the text and take runs of letters, single digits and runs of
    other characters apart. Texts that hold a special token's opening go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a run
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        plain: dict[bytes, str] = {}
        pairs, others = [], []
        for w, (stem, signs) in zip(words, _WORD.findall(b"\n".join(words).decode()), strict=True):
            if not stem:
                others.append(w)
            elif signs:
                n = len(w) - len(signs)
                pairs.append((w, w[:n], w[n:]))
                plain[w[:n]] = stem
                others.append(w[n:])
            else:
                plain[w] = stem
        runs = [w for w in plain if w not in self.known]
        for i in range(0, len(runs), 512):
            part = runs[i : i + 512]
            ids = np.array(self.model.encode_batch_fast([" ".join([plain[w] for w in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                raw = ids.tobytes()
                at = [0, *(4 * ends).tolist()]
                self.known.update(zip(part, (raw[a:b] for a, b in zip(at, at[1:], strict=False)), strict=True))
            else:
                self.known.update(zip(part, self._encode([plain[w] for w in part]), strict=True))
        others = [w for w in dict.fromkeys(others) if w not in self.known]
        self.known.update(zip(others, self._encode([w.decode() for w in others]), strict=True))
        for w, stem, signs in pairs:
            self.known[w] = self.known[stem] + self.known[signs]

    def _of(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of words that all differ."""
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        found = [*map(self.known.get, distinct)]
        absent = [w for w, ids in zip(distinct, found, strict=True) if ids is None]
        if not absent:
            return found
        back = [w for w in absent if w in self.older]
        self.known.update(zip(back, map(self.older.__getitem__, back), strict=True))
        if len(back) < len(absent):
            self._learn([w for w in absent if w not in self.known] if back else absent)
        return [*map(self.known.__getitem__, distinct)]

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; words are looked up once for all texts."""
        low = b"".join(texts).lower()
        data, offsets = np.frombuffer(low, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        start, end, first = words(data, offsets)
        _, one, of = np.unique(span_hashes(prefix_sums(data), start, end), return_index=True, return_inverse=True)
        found = self._of([low[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)])
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at, count = (np.cumsum(size) - size)[of], size[of]
        till = np.concatenate([[0], np.cumsum(count)])
        raw = flat[np.repeat(at - till[:-1], count) + np.arange(till[-1])].tobytes()
        bounds = (4 * till[first]).tolist()
        for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
            yield raw[a:b] if b"<|" not in t else self._encode([t.decode()])[0]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@tidy
def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    model, end = _tokenizer(path), end_id.to_bytes(4, "little")
    seen = np.zeros(capacity + 1, np.int64)
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        raw = data.tobytes()
        for i, j in groups(np.diff(offsets), CHUNK):
            row, piece, start, length, crc, rank, held = [], [], [], [], [], [], []
            for k, ids in enumerate(model.ids([raw[offsets[x] : offsets[x + 1]] for x in range(i, j)])):
                ids += end
                for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[a : a + 4 * capacity]
                    n = len(cut) // 4
                    row.append(i + k), piece.append(p), start.append(a // 4), length.append(n), crc.append(zlib.crc32(cut))
                    rank.append(int(seen[n]))
                    seen[n] += 1
                    if keep_ids:
                        held.append(np.frombuffer(cut, "<i4"))
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "part": pa.array([part] * len(row), pa.int32()),
                "rank": pa.array(rank, pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(held, pa.list_(pa.int32()))
            yield pa.record_batch(columns)


Pattern = tuple[tuple[int, ...], int]  # lengths that share a sequence, and how many such sequences


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any plan needs: by the sum, and by pieces too long to share with those of k or more."""
    sizes = np.arange(len(counts))
    total, best = counts * sizes, -(-int((counts * sizes).sum()) // capacity)
    number, volume = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(total)])
    for k in range(1, capacity // 2 + 1):
        alone = number[-1] - number[capacity - k + 1]
        half = number[capacity - k + 1] - number[capacity // 2 + 1]
        room = half * capacity - (volume[capacity - k + 1] - volume[capacity // 2 + 1])
        small = volume[capacity // 2 + 1] - volume[k]
        best = max(best, int(alone + half + max(0, -(-int(small - room) // capacity))))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Longest first, each sequence filled with the longest pieces that fit; equal sequences together."""
    left, out = counts.copy(), []
    while left.any():
        room, chosen = capacity, []
        while (fits := np.flatnonzero(left[: room + 1])).size:
            size = int(fits[-1])
            n = min(room // size, int(left[size]))
            left[size] -= n
            chosen += [size] * n
            room -= n * size
        lengths, need = np.unique(chosen, return_counts=True)
        more = int((left[lengths] // need).min())
        left[lengths] -= more * need
        out.append((tuple(chosen), more + 1))
    return out


class Budget:
    """Steps that a search may still take."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self) -> bool:
        self.left -= 1
        return self.left >= 0


def _sums(left: list[int], sizes: list[int], room: int) -> list[int]:
    """For each prefix of sizes, the sums up to room that its pieces can make, as bits."""
    mask, out = (1 << (room + 1)) - 1, [1]
    for s in sizes:
        bits, n, k = out[-1], min(left[s], room // s), 1
        while n > 0:
            bits |= bits << s * min(k, n) & mask
            n, k = n - k, 2 * k
        out.append(bits)
    return out


def completions(left: list[int], room: int, budget: Budget, slack: int | None = None) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of `room` from left[length] pieces that waste at most `slack`, until the budget is spent.

    In a filling nothing more fits, no piece could give way to a longer one that is left, and no two together to one that
    is as long as both or longer. Least waste first, then by discrepancies: how often fewer than the most of a length are
    taken among the numbers from which that waste can be reached.
    """
    have = [s for s in range(1, min(room, len(left) - 1) + 1) if left[s]]
    if not have:
        yield ()
        return

    def gives_way(length: int, most: int, chosen: tuple[int, ...]) -> bool:
        return any(left[t] > chosen.count(t) for t in have[bisect_left(have, length) : bisect_right(have, most)])

    sums = _sums(left, have, room)
    for waste in range(room + 1 if slack is None else min(room, slack) + 1):
        first = bisect_right(have, waste)  # pieces that would fit into the waste, all of which must be in
        forced = tuple(s for s in reversed(have[:first]) for _ in range(left[s]))
        need = room - waste - sum(forced)
        if need < 0:
            return
        sizes = have[first:]
        reach = _sums(left, sizes, room) if first and need else sums
        if not reach[-1] >> need & 1:
            continue
        order = 0
        heap: list[tuple[int, int, int, int, tuple[int, ...]]] = [(0, 0, need, len(sizes), ())]
        while heap:
            if not budget.spend():
                return
            missed, _, need, end, chosen = heappop(heap)
            while need:
                end = min(end, bisect_right(sizes, need)) - 1
                s, below = sizes[end], reach[end]
                numbers = [k for k in range(min(left[s], need // s), -1, -1) if below >> (need - k * s) & 1]
                if numbers[0]:
                    break
            else:
                chosen += forced
                pairs = {r + s for i, r in enumerate(chosen) for s in chosen[i + 1 :]}
                if not any(gives_way(s + 1, s + waste, chosen) for s in set(chosen)) and not any(gives_way(p, p + waste, chosen) for p in pairs):
                    yield chosen
                continue
            for i, k in enumerate(numbers):
                more = chosen + (s,) * k
                # Longer pieces are decided, so a pair that gives way now always will.
                if k and (gives_way(s + 1, s + waste, more) or any(gives_way(r + s, r + s + waste, more) for r in {*chosen, *more[len(chosen) + 1 :]})):
                    continue
                order += 1
                heappush(heap, (missed + i, order, need - k * s, end, more))


def complete(counts: np.ndarray, capacity: int, steps: int = STEPS) -> list[Pattern]:
    """A plan for counts[length] pieces of each length, with the fewest sequences unless the search runs out of steps.

    Rounds allow 0, 1, 2, 4, 8, ... discrepancies in all: taking a node's choice k costs k. Choices are its fillings, each
    as often as the pieces last and once. A round that left nothing out for want of discrepancies has tried all plans.
    """
    best = best_fit(counts, capacity)
    fewest, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    sizes, budget = np.arange(len(counts)), Budget(steps)
    total, allowed, left_out = int((counts * sizes).sum()), 0, fewest > bound
    seen: dict[bytes, tuple[int, int]] = {}  # what was left, the sequences used then and the discrepancies allowed

    def choices(left: np.ndarray, used: int, volume: int) -> Iterator[tuple[tuple[int, ...], int]]:
        longest = int(np.flatnonzero(left)[-1])
        rest = left.tolist()
        rest[longest] -= 1
        slack = (fewest - 1 - used) * capacity - volume  # more waste leaves no better plan
        for filling in completions(rest, capacity - longest, budget, slack):
            chosen = (longest, *filling)
            n = min(int(left[s]) // k for s, k in Counter(chosen).items())
            yield chosen, n
            if n > 1:
                yield chosen, 1

    while left_out and budget.left > 0 and fewest > bound:
        left_out = False
        seen.clear()  # what an earlier round left out does not show in this one
        plan: list[Pattern] = []
        # What is left, sequences used, its volume, discrepancies allowed, choices tried, and those still to try.
        stack: list[list] = [[counts, 0, total, allowed, 0, None]]
        while stack and budget.left > 0 and fewest > bound:
            node = stack[-1]
            left, used, volume, spare, tried, source = node
            del plan[len(stack) - 1 :]
            if tried > spare:
                left_out = True
                stack.pop()
                continue
            # A node's source is not held below its first choice, for plans are thousands of nodes deep.
            source = choices(left, used, volume) if source is None else source
            if tried == 1 and node[5] is None:
                next(source, None)
            choice = next(source, None)
            if choice is None:
                stack.pop()
                continue
            node[4], node[5] = tried + 1, source if tried else None
            if not budget.spend():
                break
            chosen, n = choice
            rest = left.copy()
            for s in chosen:
                rest[s] -= n
            plan.append((chosen, n))
            used, volume, spare = used + n, volume - n * sum(chosen), spare - tried
            if used - (-volume // capacity) >= fewest:
                continue
            if not volume:
                best, fewest = list(plan), used
                continue
            key = blake2b(rest.tobytes(), digest_size=16).digest()
            before = seen.get(key)
            if before and before[0] <= used and before[1] >= spare:
                continue
            seen[key] = used, spare
            stack.append([rest, used, volume, spare, 0, None])
        allowed = 2 * allowed or 1
    return best


def slots(plan: list[Pattern], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and for each: sequences, first sequence id, offset."""
    used, rows, base = np.zeros(capacity + 1, np.int64), [], 0
    for lengths, n in plan:
        at = 0
        for size in lengths:
            rows.append((size << 44 | int(used[size]), n, base, at))
            used[size] += n
            at += size
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1:]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    Takes doc_id and text. A document is its text's ids and then end_id; null and empty texts have end_id alone. Longer
    documents are cut into pieces of `capacity`, the last one shorter. Returns for each piece doc_id, piece, start, length,
    ids_crc32, sequence_id, offset, and the ids where keep_ids is set. Repeated rows are packed each. Pieces of a sequence
    lie without gaps from offset 0; sequence ids run from 0. An empty table gives an empty result.

    The plan's search takes at most STEPS (100,000) steps: plans tried by one filling, and fillings followed by one length.
    It is exact where it ends before; else the plan is the best one found, which may exceed the fewest sequences possible:
    check_s meets the lower bound, check_h takes 9,888 sequences where the bound is 9,886.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = typed(docs, doc_id="long", text="string")
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * keep_ids
    pieces = scratch.keep(docs.mapInArrow(lambda b: _pieces(b, tokenizer, capacity, end_id, keep_ids), kind))
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    parts = scratch.keep(parts)
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length
        counts[r.length] = r.n
    keys, places = slots(complete(counts, capacity), capacity)
    shared = spark.sparkContext.broadcast((keys, places))
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # Merged, not broadcast: its rows are as many as lengths times tasks.
    ranked = pieces.join(parts.hint("merge"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = shared.value
        for batch in batches:
            rank = np.asarray(batch.column("rank"))
            key = np.asarray(batch.column("length")) << 44 | rank
            at = np.searchsorted(keys, key, side="right") - 1
            sequence = places[at, 1] + (key - keys[at])
            columns = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns |= {"sequence_id": pa.array(sequence), "offset": pa.array(places[at, 2])}
            if keep_ids:
                columns["ids"] = batch.column("ids")
            yield pa.record_batch(columns)

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return ranked.mapInArrow(placed, out)
