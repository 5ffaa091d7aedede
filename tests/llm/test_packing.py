import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations, combinations_with_replacement  # noqa: F401

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakewright.llm.packing import Budget, WordTokenizer, best_fit, complete, completions, lower_bound, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"
ODD = [
    "", " ", "Hello, world", "don't stop 's 'll 12345 a1b2", "É è ÇA straße ñ", "á é", "İ ΣΣ ẞ",
    "<|endoftext|> x <|startoftext|>y <|STARTOFTEXT|>", "foo<|endoftext|>bar", "x y z​w", "\x1c\x1d a\x85b", "日本語 テキスト 한국어", "😀😀 !!! ... a,,b", "tab\tnew\nline\r\x0b\x0c end.", "́ alone", "\x00 \x01", "ﬁ ﬂ ŉ ǅ",
]


def test_word_by_word_ids_equal_the_tokenizers():
    model, words = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    r = random.Random(1)
    texts = ODD + [" ".join(r.choice(ODD + ["the", "Lying", "estiones.", "ouer,", "naïve!?"]) for _ in range(40)) for _ in range(60)]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in words.ids([t.encode() for t in texts])]
        assert got == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_the_older_cache_come_back(monkeypatch):
    from lakewright.llm import packing

    monkeypatch.setattr(packing, "CACHED", 5)
    model, words = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    r = random.Random(2)
    for _ in range(60):
        texts = [" ".join(r.choice(["the", "estiones.", "ouer,", "naïve!?", "a1", "x", "Lying", "é", "###", "one,"]) for _ in range(r.randint(0, 5))) for _ in range(3)]
        got = [np.frombuffer(x, "<u4").tolist() for x in words.ids([t.encode() for t in texts])]
        assert got == [model.encode(t, add_special_tokens=False).ids for t in texts]


def fewest(items, capacity):
    """Exact number of bins, for small cases."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def used(plan, counts, capacity):
    placed = np.zeros_like(counts)
    for lengths, n in plan:
        assert n > 0 and sum(lengths) <= capacity
        for size in lengths:
            placed[size] += n
    assert (placed == counts).all()
    return sum(n for _, n in plan)


@pytest.mark.parametrize("seed", range(12))
def test_plans_against_exact_search(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 20, 30])
    items = [r.randint(1, capacity) for _ in range(r.randint(1, 11))]
    counts = np.bincount(items, minlength=capacity + 1).astype(np.int64)
    n = used(complete(counts, capacity), counts, capacity)
    assert lower_bound(counts, capacity) <= fewest(items, capacity) <= n <= used(best_fit(counts, capacity), counts, capacity)
    assert n == fewest(items, capacity)


def test_search_improves_on_best_fit():
    counts = np.zeros(101, np.int64)
    for size in (44, 24, 24, 22, 21, 17, 8, 8, 6, 6):
        counts[size] += 1
    counts *= 1
    items = [s for s in range(101) for _ in range(counts[s])]
    assert used(complete(counts, 61), counts, 61) == fewest(items, 61)


def test_search_goes_on_beside_a_filling_without_waste():
    items = [18, 15, 13, 12, 12, 11, 11, 11, 8, 7]
    counts = np.bincount(items, minlength=41).astype(np.int64)
    assert used(complete(counts, 40), counts, 40) == fewest(items, 40) == 3


@pytest.mark.parametrize("seed", range(8))
def test_completions_are_all_the_undominated_fillings(seed):
    r = random.Random(seed)
    room = r.randint(10, 40)
    left = [0] * (room + 1)
    for _ in range(r.randint(1, 9)):
        left[r.randint(1, room)] += 1
    have = [s for s in range(room + 1) for _ in range(left[s])]
    subsets = {tuple(sorted(c, reverse=True)) for n in range(len(have) + 1) for c in combinations(have, n) if sum(c) <= room}

    def dominated(c):
        waste, spare = room - sum(c), Counter(have) - Counter(c)
        pairs = {a + b for a, b in combinations(c, 2)}
        return any(t <= waste or any(s < t <= s + waste for s in c) or any(p <= t <= p + waste for p in pairs) for t in spare)

    want = {c for c in subsets if not dominated(c)}
    got = list(completions(left, room, Budget(1_000_000)))
    assert len(got) == len(set(got)) and set(got) == want
    assert [sum(c) for c in got] == sorted(map(sum, got), reverse=True)


@pytest.mark.parametrize("keep_ids", [False, True])
def test_pack(spark, keep_ids):
    r = random.Random(2)
    texts = [*ODD, None, *(" ".join(r.choice(["the", "lying", "ouer,", "tion"]) for _ in range(r.choice([3, 20, 90, 300]))) for _ in range(80))]
    data = [(None if i == 3 else min(i, 90), t) for i, t in enumerate(texts)] + [(7, "same row")] * 3
    model, capacity = Tokenizer.from_file(PATH), 64
    out = pack(spark.createDataFrame(data, SCHEMA).repartition(3), PATH, capacity, keep_ids=keep_ids).collect()
    want = Counter()
    for d, t in data:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(ids), capacity)):
            cut = ids[a : a + capacity]
            want[(d, p, a, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out) == want
    rows = defaultdict(list)
    for x in out:
        rows[x.sequence_id].append((x.offset, x.length))
        if keep_ids:
            assert zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32
    for places in rows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(x.length for x in out)
    assert len(rows) <= -(-total // capacity) * 1.03 + 1
    assert sorted(rows) == list(range(len(rows)))


def test_nothing_to_pack(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
