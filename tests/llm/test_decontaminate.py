import random
import time

import numpy as np
import pyarrow as pa
import pytest

from lakewright.llm.decontaminate import Items, _common_grams, contamination, cut, decontaminate, distance

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def table(pattern, text):
    """Least edit distance of the pattern to any substring, by dynamic programming."""
    row = np.arange(len(pattern) + 1)
    best = row[-1]
    for c in text:
        new = np.empty_like(row)
        new[0] = 0
        for i, p in enumerate(pattern):
            new[i + 1] = min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1)
        row = new
        best = min(best, row[-1])
    return int(best)


def norm(text):
    out = []
    for c in (text or "").lower().encode():
        out.append(chr(c) if c >= 0x80 or chr(c).isalnum() else " ")
    return " ".join("".join(out).split(" ")).encode("latin-1")


def words(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(n))


def edited(r, text, n):
    for _ in range(n):
        i = r.randrange(len(text))
        text = r.choice([text[:i] + text[i + 1 :], text[:i] + "x" + text[i:], text[:i] + "z" + text[i + 1 :]])
    return text


@pytest.mark.parametrize("seed", range(4))
def test_myers_against_dynamic_programming(seed):
    r = random.Random(seed)
    for _ in range(60):
        p = bytes(r.choice(b"abc") for _ in range(r.randint(1, 80)))
        t = bytes(r.choice(b"abc") for _ in range(r.randint(0, 90)))
        if r.random() < 0.5:
            t += p[: r.randint(0, len(p))] + p[3:]
        best, end = distance(p, t)
        assert best == table(p, t)
        if best < len(p):
            assert distance(p[::-1], t[:end][::-1], anchored=True)[0] == best


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    items = [(i, words(r, r.randint(3, 40))) for i in range(12)]
    docs = []
    for i in range(60):
        parts = [words(r, r.randint(0, 40))]
        if r.random() < 0.7:
            leak = r.choice(items)[1]
            parts += [r.choice([str.upper, str.title, str])(edited(r, leak, r.choice([0, 0, 1, 3, 8, 20]))), words(r, 9)]
        docs.append((i, r.choice([" ", "\n", ", "]).join(parts)))
    got = {(x.doc_id, x.item_id): x for x in contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    want = {}
    for d, t in docs:
        for i, p in items:
            q = norm(p).strip()
            q = b" ".join(q.split())
            e = table(q, b" ".join(norm(t).split()))
            if len(q) >= 16 and e <= int(len(q) * 0.06):
                want[d, i] = e
    assert {k: v.distance for k, v in got.items()} == want and len(want) > 10
    texts, item = dict(docs), dict(items)
    for (d, i), x in got.items():
        cut = b" ".join(norm(texts[d][x.start : x.end]).split())
        assert abs(len(cut) - len(b" ".join(norm(item[i]).split()))) <= x.distance + 1
    kept = {x.doc_id for x in decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_edges(spark):
    item = "the quick brown fox jumps over the lazy dog"
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, "é " * 50 + item.upper() + "!"), (4, item[:30]), (5, (item + " ") * 400)]
    items = [(7, item), (7, item), (8, None), (9, ""), (None, "dog"), (10, "lazy dog")]
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    rows = contamination(make(docs, DOCS), make(items, ITEMS)).collect()
    assert sorted((x.doc_id or 0, x.item_id, x.distance) for x in rows) == [(0, 7, 0), (3, 7, 0), (3, 7, 0), (5, 7, 0)]
    assert next((x.start, x.end) for x in rows if x.doc_id is None) == (100, 100 + len(item))
    assert contamination(make([], DOCS), make(items, ITEMS)).count() == 0
    assert contamination(make(docs, DOCS), make([], ITEMS)).count() == 0
    assert decontaminate(make(docs, DOCS), make([], ITEMS)).count() == len(docs)
    extra = make([(1, item, "x", 5)], "doc_id long, text string, item_id string, start int")
    assert contamination(extra, make(items, ITEMS)).count() == 1 and decontaminate(extra, make(items, ITEMS)).columns == extra.columns


def test_many_items_take_several_passes(spark, monkeypatch):
    from lakewright.llm import decontaminate as module

    r = random.Random(8)
    items = [(i, words(r, 12)) for i in range(30)]
    docs = [(i, words(r, 5) + " " + t + " " + words(r, 5)) for i, t in items]
    monkeypatch.setattr(module, "ITEM_BYTES", 400)
    got = {(x.doc_id, x.item_id) for x in contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert {(i, i) for i, _ in items} <= got


@pytest.mark.parametrize("seed,own", [(1, 3), (2, 8), (3, 14)])
def test_items_of_one_template_against_brute_force(seed, own):
    r = random.Random(seed)
    template = "choose the best answer and say why "
    items = [(i, template + words(r, own)) for i in range(24)] + [(24, words(r, 2) + "abcdefgh"), (25, words(r, 60))]
    texts = []
    for _ in range(14):
        leak = edited(r, r.choice(items)[1], r.choice([0, 1, 2, 4, 6]))
        texts.append(words(r, 4) + " " + r.choice([leak, template + words(r, 5), leak + " " + leak]) + " " + words(r, 3))
    built = Items.build(items, 0.06, 16)
    got = {(d, i): e for d, i, e, *_ in built.matches(pa.array(texts))}
    want = {}
    for d, t in enumerate(texts):
        for i, p in items:
            q = b" ".join(norm(p).split())
            e = table(q, b" ".join(norm(t).split()))
            if len(q) >= 16 and e <= int(len(q) * 0.06):
                want[d, i] = e
    assert got == want and want


def test_pieces_are_even_or_hold_what_is_rare():
    r = random.Random(5)
    template = "choose the best answer and say why "
    texts = [norm(template + words(r, 12)).strip() for _ in range(30)]
    common = _common_grams(texts)
    for t in texts:
        got = cut(t, 5, common)
        assert len(got) == 5 and all(a + n <= b for (a, n), (b, _) in zip(got, got[1:], strict=False)) and got[-1][0] + got[-1][1] <= len(t)
        assert all(n >= 8 and t[a : a + n] not in template.encode() for a, n in got)
        assert cut(t, 5, np.zeros(0, np.uint64)) == [(len(t) * i // 5, len(t) * (i + 1) // 5 - len(t) * i // 5) for i in range(5)]
    assert len(cut(texts[0], 1, common)) == 1 and sum(n for _, n in cut(template.encode().strip(), 4, common)) == len(template) - 1


def test_templates_do_not_bring_every_document_to_every_item():
    r = random.Random(6)
    template = "question: choose the best answer to the question below and explain why. "
    items = Items.build([(i, template + words(r, 8)) for i in range(800)], 0.06, 16)
    texts = pa.array([words(r, 80) + " " + template + words(r, 60) for _ in range(40)])
    started = time.process_time()
    assert list(items.matches(texts)) == [] and time.process_time() - started < 3


def test_a_short_item_leaves_the_pieces_of_others_long():
    r = random.Random(7)
    items = Items.build([(0, "abcdefghijklmnopq")] + [(i, words(r, 30)) for i in range(1, 9)], 0.06, 16)
    assert len(items.indexes) == 2 and max(x.gram for x in items.indexes) > 14 and min(x.gram for x in items.indexes) == 8


def test_no_items():
    assert list(Items.build([], 0.1, 4).matches(pa.array(["abc", None]))) == []


def test_short_items_match_exactly_at_word_bounds(spark):
    docs = [(1, "Dog"), (2, "a hot-dog, and a dog"), (3, "dogma bulldog"), (4, "\u00e9 lazy  DOG!"), (5, "lazy"), (6, None), (7, "  dog"), (8, "la"), (8, ""), (9, "zy dog")]
    items = [(1, "dog"), (1, "dog"), (2, "Lazy dog."), (3, "dog"), (4, " ?! "), (5, None), (6, "the quick brown fox jumps over")]
    df, bench = spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(items, ITEMS)
    got = sorted((x.doc_id, x.item_id, x.distance, x.start, x.end) for x in contamination(df, bench, short_items=True).collect())
    want = [(1, 1, 0, 0, 3), (1, 3, 0, 0, 3), (2, 1, 0, 6, 9), (2, 3, 0, 6, 9), (4, 1, 0, 8, 11), (4, 2, 0, 2, 11), (4, 3, 0, 8, 11), (7, 1, 0, 2, 5), (7, 3, 0, 2, 5), (9, 1, 0, 3, 6), (9, 3, 0, 3, 6)]
    assert got == want
    assert contamination(df, bench).count() == 0 and decontaminate(df, bench).count() == len(docs)
