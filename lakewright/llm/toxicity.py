"""Toxicity by subword-bag embeddings: n-gram vectors averaged over a few words, then a linear softmax.

The n-grams of a word, with marks at its ends, are hashed to rows of one embedding table, so a misspelt word shares
most of its vectors with the right one. A passage is `span` consecutive words; its vector is the
mean of its n-grams' vectors. A text scores as its worst passage does, whatever its length. Table and softmax are
trained together in numpy on the driver, on a bounded sample of labelled rows. As softmax is linear in the
mean, scoring needs one number for each row of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import ship
from .common import LOWER, groups, mixed, prefix_sums, span_hashes, tidy, typed, utf8

GRAMS = (3, 4, 5)
CHUNK = 1 << 18
_MARK = 0x20
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Words:
    """The words of some texts laid end to end, and their n-grams: row of the table, and word, of each."""

    first: np.ndarray  # of each text, and one past the last
    gram: np.ndarray
    word: np.ndarray
    sizes: np.ndarray  # n-grams of each word


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case in ASCII and in the Latin-1 letters of two bytes; anything between words becomes a mark."""
    out = LOWER[data]
    if len(out) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 0x20
    out[~_WORD[data]] = _MARK
    return out


def subwords(data: np.ndarray, offsets: np.ndarray, bits: int) -> Words:
    texts = len(offsets) - 1
    padded = np.full(len(data) + texts + 1, _MARK, np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(1, texts + 1), np.diff(offsets))] = lowered(data)
    inside = padded != _MARK
    edge = np.diff(inside.view(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    of = np.cumsum(edge == 1)  # at i: words that begin up to i + 1
    sums, shift = prefix_sums(padded), np.uint64(64 - bits)
    marks = np.concatenate([[0], np.cumsum(~inside)])
    rows, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(marks[n - 1 : -1] == marks[1 : len(marks) - n + 1]) if len(padded) >= n else np.zeros(0, np.int64)
        rows.append((span_hashes(sums, at, at + n) * np.uint64(2 * n + 1) >> shift).astype(np.int32))
        owners.append((of[at] - 1).astype(np.int32))
    gram, word = np.concatenate(rows), np.concatenate(owners)
    first = np.searchsorted(start, np.append(offsets[:-1] + np.arange(texts), len(padded)))
    return Words(first, gram, word, np.bincount(word, minlength=len(start)))


def passages(w: Words, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of every passage, and each text's first passage; a short text is one passage."""
    counts = np.diff(w.first)
    n = np.where(counts > 0, np.maximum(counts - span + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(n)])
    begin = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(w.first[:-1], n)
    return begin, np.minimum(begin + span, np.repeat(w.first[1:], n)), at


@dataclass
class Model:
    weights: np.ndarray  # what each row of the table adds to the logit
    bias: float
    span: int
    bits: int

    def logits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Of each passage, and each text's first passage."""
        begin, end, at = passages(w, self.span)
        value = np.concatenate([[0.0], np.cumsum(np.bincount(w.word, self.weights[w.gram], len(w.sizes)))])
        size = np.concatenate([[0], np.cumsum(w.sizes)])
        return (value[end] - value[begin]) / np.maximum(size[end] - size[begin], 1) + self.bias, at

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, offsets = utf8(texts)
        out = []
        for i, j in groups(np.diff(offsets), CHUNK):
            w = subwords(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], self.bits)
            z, at = self.logits(w)
            top = np.full(j - i, self.bias)
            full = np.diff(at) > 0
            if full.any():
                top[full] = np.maximum.reduceat(z, at[:-1][full])
            out.append(1 / (1 + np.exp(-np.clip(top, -40, 40))))
        return np.concatenate(out) if out else np.zeros(0)


def train(texts: list[str], labels: np.ndarray, span: int = 4, bits: int = 17, dim: int = 8, epochs: int = 8, batch: int = 64, seed: int = 7) -> Model:
    """Adam on the embedding table and the softmax together. The first epochs use whole texts, the others the worst passage."""
    r = np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1 << bits), (20.0 if len(labels) and labels[0] else -20.0), span, bits)
    table, soft = r.normal(0, 0.05, (1 << bits, dim)), r.normal(0, 0.5, (dim, 2))
    bias = np.zeros(2)
    held = []
    for i in range(0, len(texts), batch):
        data, offsets = utf8(pa.array(texts[i : i + batch], pa.string()))
        w = subwords(data, offsets, bits)
        if len(w.gram):
            held.append((w, labels[i : i + batch]))
    table, soft, bias = (x.astype(np.float32) for x in (table, soft, bias))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, soft, bias)]
    step = 0
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    for epoch in range(epochs):
        for k in r.permutation(len(held)):
            w, y = held[k]
            model = Model(table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]), span, bits)
            z, at = model.logits(w)
            begin, end, _ = passages(w, span)
            chosen = []
            for d in np.flatnonzero(np.diff(at) > 0):
                a, b = at[d], at[d + 1]
                if epoch < 2:
                    chosen.append((d, w.first[d], w.first[d + 1]))
                    continue
                p = a + int(z[a:b].argmax())
                chosen.append((d, begin[p], end[p]))
                if not y[d]:
                    chosen += [(d, begin[q], end[q]) for q in r.integers(a, b, 2)]
            if not chosen:
                continue
            doc, lo, hi = (np.array(x) for x in zip(*chosen, strict=True))
            value = np.concatenate([[0.0], np.cumsum(np.bincount(w.word, model.weights[w.gram], len(w.sizes)))])
            size = np.concatenate([[0], np.cumsum(w.sizes)])
            n = np.maximum(size[hi] - size[lo], 1)
            p = 1 / (1 + np.exp(-np.clip((value[hi] - value[lo]) / n + model.bias, -40, 40)))
            miss = (p - y[doc]) * np.where(y[doc] == 1, 0.5 / share, 0.5 / (1 - share)) / len(held[k][1])
            each = np.zeros(len(w.sizes) + 1)  # what each word's n-grams pass back
            np.add.at(each, lo, miss / n)
            np.add.at(each, hi, -miss / n)
            back = np.bincount(w.gram, np.cumsum(each)[:-1][w.word], 1 << bits)
            turn = soft[:, 1] - soft[:, 0]
            pull = table.T @ back
            grads = (np.outer(back, turn), np.stack([-pull, pull], 1), np.array([-miss.sum(), miss.sum()]))
            step += 1
            for x, g, m, rate in zip((table, soft, bias), grads, moments, (0.1, 0.05, 0.05), strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), span, bits)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that are kept out of training: crc32 of the id's text leaves 1 modulo 3. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 800, longest: int = 20_000) -> Model:
    """Trains on at most `per_label` texts of each label, those whose ids hash lowest.

    Takes doc_id and text of docs, doc_id and toxic (0 or 1) of labels. Rows held out, with null ids, labels or texts, or
    with more than `longest` characters are not used in training. Without both labels the model is constant.
    """
    labels = typed(labels, doc_id="long", toxic="int").where(F.col("doc_id").isNotNull() & ~held_out() & F.col("toxic").isin(0, 1))
    docs = typed(docs, doc_id="long", text="string").where(F.col("text").isNotNull() & (F.length("text") <= longest))
    sizes = docs.select("doc_id")
    labels = labels.join(sizes, "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = labels.where("toxic = 1").orderBy(*order).limit(per_label).union(labels.where("toxic = 0").orderBy(*order).limit(per_label))
    wanted = {r.doc_id: r.toxic for r in ids.collect()}  # bounded by per_label
    if not wanted:
        return train([], np.zeros(0))
    keys = docs.sparkSession.createDataFrame([(i,) for i in wanted], "doc_id long")
    rows = docs.join(F.broadcast(keys), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    order = np.random.default_rng(3).permutation(len(rows))
    return train([rows[i].text for i in order], np.array([wanted[rows[i].doc_id] for i in order]))


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of docs, and score (0 to 1), predicted (1 if score >= threshold) after them.

    Takes text. A null or empty text, or one without words, gets the score of the bias alone. Earlier columns named
    score or predicted are replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array(shared.value.scores(texts))

    score = F.arrow_udf(scored, "double")
    return docs.withColumn("score", score(F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
