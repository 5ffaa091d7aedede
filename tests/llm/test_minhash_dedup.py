import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lakewright.llm.common import Scratch
from lakewright.llm.graph import components
from lakewright.llm.minhash_dedup import estimated, margin, may_link, minhash_dedup, odd_sketch, one_of_each_group, shingle_sets

SCHEMA = "doc_id long, text string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(data, size, per_cent=80):
    sets = [shingles(t, size) for _, t in data]
    up = list(range(len(data)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= per_cent * len(a | b):
                up[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(data):
        if d is not None:
            ids[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(data):
        c = min(ids[root(i)], default=None)
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return Counter(out)


def rows(spark, data, size):
    out = minhash_dedup(spark.createDataFrame(data, SCHEMA), words_per_shingle=size)
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect())


def copies(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 6)))
    base = [[word() for _ in range(r.randint(3, 120))] for _ in range(8)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 9])):
            w[r.randrange(len(w))] = word()
        out.append((i, r.choice([" ", "\n", " \t "]).join(x.upper() if r.random() < 0.2 else x for x in w)))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed,size", [(1, 4), (2, 5), (3, 4)])
def test_against_brute_force(spark, seed, size):
    data = copies(seed)
    assert rows(spark, data, size) == brute(data, size)


def test_edges(spark):
    same = "one two three four five six"
    data = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One TWO"), (6, "two one"), (None, same), (None, same), (9, same), (9, same), (8, same + " É"), (7, "é é é é"), (10, "É É É É")]
    assert rows(spark, data, 4) == brute(data, 4)
    assert rows(spark, [], 4) == Counter()
    assert rows(spark, [(None, "a b c d e")] * 3, 4) == Counter({(None, 2, None, False): 3})


def test_a_member_far_from_the_pivot_is_found_through_another(spark):
    w = [f"w{i}" for i in range(200)]
    chain = [(k, " ".join(w[: 4 * k] + [f"x{i}" for i in range(4 * k, 200)])) for k in range(12)]
    data = [(i, t) for i, t in chain]
    assert rows(spark, data, 4) == brute(data, 4)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    got = {x.vertex: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(len(edges)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if all(label[a] == label[b] for a, b in edges):
            break
    assert all(got.get(x, x) == c for x, c in label.items())
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


@pytest.mark.parametrize("size", [90, 1000, 20000])
def test_odd_sketch_estimates_similarity(size):
    r = np.random.default_rng(size)
    for share in (0.77, 0.8, 0.83):
        same = round(2 * size * share / (1 + share))
        errors = []
        for _ in range(20):
            x = r.integers(0, 2**63, 2 * size - same, dtype=np.uint64) << np.uint64(1)
            a, b = np.unique(x[:size]), np.unique(x[size - same :])
            (sa, ka), (sb, kb) = odd_sketch(a), odd_sketch(b)
            flips = np.bitwise_count(sa ^ sb).sum()
            errors.append(float(estimated(flips, len(a), len(b), ka, kb)) - same / (2 * size - same))
        assert abs(np.mean(errors)) + 3 * np.std(errors) < float(margin(size, size)) or share != 0.8
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.006


def test_full_bitmaps_never_rule_out_a_pair():
    r = np.random.default_rng(4)
    x = r.integers(0, 2**63, 330_000, dtype=np.uint64) << np.uint64(1)
    a, b = np.unique(x[:300_000]), np.unique(x[30_000:])
    (sa, ka), (sb, kb) = odd_sketch(a), odd_sketch(b)
    assert may_link(np.bitwise_count(sa ^ sb).sum(), len(a), len(b), ka, kb, 0.8)


def test_shingle_sets_follow_the_definition():
    texts = [None, "", "a b c", "A b\tc d", "a b c d e d c b a b c d", "é b c d"]
    got = [len(s) for s in shingle_sets(pa.array(texts), 4)]
    assert got == [len(shingles(t, 4)) for t in texts]


def test_all_rows_without_words_are_kept(spark):
    rows = [(None, None, "a"), (None, None, "b"), (None, " \t", "c"), (None, " \t", "d"), (4, "", "e"), (4, "", "f"), (5, "\x0b\x0c\r\n", "g"), (5, "one two", "h"), (5, "one two", "h"), (6, "one  two", "i"), (7, "\u00a0", "j")]
    got = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.source for r in got) == list("abcdefghj")


def test_of_equal_rows_one_is_chosen_by_its_other_columns(spark):
    text = "one two three four five six"
    rows = [(1, text, s, {"a": 1}) for s in ("x", "y", "z")] + [(2, text, "w", None), (None, "seven eight nine", "v", None)]
    kept = set()
    for parts in (1, 3):
        df = spark.createDataFrame(rows[::-1] if parts == 3 else rows, "doc_id long, text string, `a.b` string, m map<string,int>").repartition(parts)
        got = one_of_each_group(df).collect()
        assert len(got) == 2 and {r.doc_id for r in got} == {1, None}
        kept |= {(r.doc_id, r["a.b"]) for r in got}
    assert len(kept) == 2


@pytest.mark.parametrize("most,passing", [(48, 8), (2, 1)])
def test_blocks_and_parts_of_a_bucket_lose_no_link(spark, monkeypatch, most, passing):
    from lakewright.llm import minhash_dedup as module

    monkeypatch.setattr(module, "BLOCK", 3)
    monkeypatch.setattr(module, "MOST", most)
    monkeypatch.setattr(module, "PASSING", passing)
    r = random.Random(11)
    core = [f"w{i}" for i in range(70)]
    data = []
    for i in range(60):
        own = [f"x{i % 25}_{k}" for k in range(30)]
        w = core + own
        w[r.randrange(100)] = f"y{i}"
        data.append((i, " ".join(w)))
    assert rows(spark, data, 4) == brute(data, 4)
