import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lakewright.llm.suffix_array import common_prefixes, repeated, two_stage
from lakewright.llm.suffix_dedup import segments, suffix_dedup

SCHEMA = "doc_id long, text string"


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows(spark, data, **options):
    out = suffix_dedup(spark.createDataFrame(data, SCHEMA), **options).collect()
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out)


def want(data, length):
    return Counter((i, *x) for (i, _), x in zip(data, brute([t for _, t in data], length), strict=True))


def some_texts(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 5)))
    phrases = [" ".join(word() for _ in range(r.randint(3, 30))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [r.choice(phrases) if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(1, 25))) for _ in range(r.randint(0, 5))]
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_two_stage_sorts_all_suffixes(seed):
    r = np.random.default_rng(seed)
    strings = [bytes(r.integers(0, [2, 4, 256][seed - 1], r.integers(0, 40), dtype=np.uint8)) for _ in range(30)]
    strings += [b"", b"aaaaaaaaaa", b"abababab", b"\x00\x00\x00"]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    order = two_stage(data, offsets, 64)
    assert sorted(order.tolist()) == list(range(len(data)))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    suffix = lambda i: data[i : ends[i]].tobytes()
    got = [suffix(i) for i in order]
    assert got == sorted(got)
    room = ends - np.arange(len(data))
    lcp = common_prefixes(data, order, room, 64)
    for a, b, n in zip(got, got[1:], lcp[1:], strict=False):
        same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert n == same


def test_repeated_numbers_equal_windows_alike():
    data = np.frombuffer(b"abcdefgabcdxabcd", np.uint8)
    at, number = repeated(data, np.array([0, 11, 16]), 4)
    assert {tuple(sorted(at[number == k].tolist())) for k in number if (number == k).sum() > 1} == {(0, 7, 12)}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("length,gram", [(20, 8), (40, 32)])
def test_against_brute_force(spark, seed, length, gram):
    data = list(enumerate(some_texts(seed)))
    assert rows(spark, data, length=length, gram=gram) == want(data, length)


def test_many_kinds_of_one_anchor_are_sorted_in_parts(spark, monkeypatch):
    from lakewright.llm import suffix_dedup as module

    monkeypatch.setattr(module, "KINDS", 3)
    data = list(enumerate(some_texts(9, 80)))
    assert rows(spark, data, length=20, gram=8) == want(data, 20)


def test_edges(spark):
    long = "".join(random.Random(5).choice("abcdefgh ") for _ in range(700))
    data = [(1, None), (2, ""), (3, "short"), (None, long), (None, long), (4, "x" * 450), (5, "ab" * 300), (6, "é" * 150 + long[:250]), (6, "é" * 150 + long[:250])]
    assert rows(spark, data) == want(data, 200)
    assert rows(spark, []) == Counter()


@pytest.mark.parametrize("chunk", [50, 300, 1 << 18])
def test_segments_hold_every_window_once_and_equal_windows_share_an_anchor(chunk):
    texts = [*some_texts(4, 25), "", "x" * 400, "".join(some_texts(4, 12))]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    seen, anchor = Counter(), {}
    for of, start, n, h in segments(data, offsets, 40, 16, chunk):
        for i, a, k, x in zip(of.tolist(), start.tolist(), n.tolist(), h.tolist(), strict=True):
            assert k <= 25
            for w in range(a, a + k):
                seen[w] += 1
                assert offsets[i] <= w and w + 40 <= offsets[i + 1]
                assert anchor.setdefault(data[w : w + 40].tobytes(), x) == x
    assert set(seen.values()) <= {1} and len(seen) == sum(max(0, len(b) - 39) for b in raw)


def test_other_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "a" * 300, 7, "x", 2)], "doc_id long, text string, key int, anchor string, n int")
    assert suffix_dedup(df).count() == 1
