import random
import re

import numpy as np
import pytest

import corpus_pipeline
from lakewright.llm.minhash_dedup import one_of_each_group
from lakewright.llm.pii import find, masked

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with toxic words, near copies, leaked test items and personal data."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(30)) for i in range(4)]
    docs, kind = [], {}

    def put(text, what):
        kind[len(docs)] = what
        docs.append((len(docs), text, "en", f"s{len(docs) % 3}", len(text or "")))

    for i in range(150):
        put(prose(r.randint(20, 90)), "clean")
    for i in range(90):
        w = prose(r.randint(20, 90)).split()
        for _ in range(2):
            w.insert(r.randrange(len(w)), r.choice(["grumph", "blarzig", "snorkish"]))
        put(" ".join(w), "toxic")
    for i in range(8):
        text = docs[i][1]
        put(text, "copy"), put(text + " last", "copy")
    for i, t in items:
        put(f"{prose(20)} {t} {prose(20)}", "leak")
    put(f"{prose(30)} write to jo@ex.org or jo [at] ex [dot] org", "pii")
    put(None, "empty"), put("", "empty")
    folder = str(tmp_path_factory.mktemp("sf"))
    labels = [(d, 1, int(k == "toxic")) for d, k in kind.items() if k in ("toxic", "clean")]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, kind


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages_against_plain_versions(spark, corpus):
    folder, docs, kind = corpus
    now = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    text = {d[0]: d[1] for d in docs}
    kept = {r.doc_id for r in seen["toxicity"]}
    toxic = {d for d, k in kind.items() if k == "toxic"}
    assert len(toxic - kept) > 0.9 * len(toxic) and len({d for d, k in kind.items() if k != "toxic"} - kept) <= 3
    # Near copies: the least id of each group stays.
    left, groups = sorted(kept), {}
    for d in left:
        s = shingles(text[d])
        mine = [g for g, sets in groups.items() if s and any(5 * len(s & t) >= 4 * len(s | t) for t in sets)]
        merged = [s] + [t for g in mine for t in groups.pop(g)]
        groups[min([d, *mine])] = merged
    assert {r.doc_id for r in seen["minhash_dedup"]} == set(groups)
    leaks = {d for d, k in kind.items() if k == "leak"}
    assert {r.doc_id for r in seen["decontamination"]} == set(groups) - leaks
    for r in seen["pii"]:
        t = text[r.doc_id]
        assert r.text == (masked(t, find(t)) if t else t) and r.n_chars == (None if t is None else len(r.text))
    packed = seen["packing"]
    assert {r.doc_id for r in packed} == {r.doc_id for r in seen["pii"]}
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == np.concatenate([[0], np.cumsum([n for _, n in sorted(p)])[:-1]]).tolist() and sum(n for _, n in p) <= 2048


def test_run_is_the_last_stage(spark, corpus):
    folder, docs, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:2] == ["doc_id", "piece"] and 0 < out.count() <= len(docs)


def test_no_documents(spark, corpus, tmp_path):
    folder, _, _ = corpus
    now = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
    assert now.count() == 0


def test_one_of_each_group_keeps_whole_rows(spark):
    same = "one two three four five six seven"
    rows = [(3, same, "c", 1), (2, same, "b", 2), (2, same, "b", 2), (None, same, "n", 0), (5, None, "e", 5), (6, "", "f", 6), (7, "", "g", 7)]
    out = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, cls string, key int"))
    assert out.columns == ["doc_id", "text", "cls", "key"]
    assert sorted((r.doc_id, r.cls, r.key) for r in out.collect()) == [(2, "b", 2), (5, "e", 5), (6, "f", 6), (7, "g", 7)]
