"""Languages of a text as a mixture: EM over words with n-gram likelihoods, and a penalised choice of languages.

Each language has a smoothed distribution of hashed byte n-grams. A word's likelihood in a language is that of its
n-grams, marks at its ends included. A text is a mixture of languages with one proportion each; expectation-maximisation
estimates them for growing sets of languages, and the set with the best likelihood less a price for each
language is chosen. Sets grow in the order of the languages' shares in a mixture of all; other sets are not tried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import ship
from .common import groups, prefix_sums, span_hashes, tidy, typed, utf8
from .toxicity import _MARK, lowered

BITS = 16
GRAM = 3
CHUNK = 1 << 18
_DIGITS = np.zeros(256, bool)
_DIGITS[0x30:0x3A] = True


@dataclass
class WordGrams:
    first: np.ndarray  # of each text, and one past the last
    row: np.ndarray  # of the table, for each n-gram, in the order of words
    start: np.ndarray  # of each word's n-grams


def word_grams(data: np.ndarray, offsets: np.ndarray) -> WordGrams:
    """Words are runs of letters: ASCII letters and all bytes of other characters."""
    texts = len(offsets) - 1
    padded = np.full(len(data) + texts + 1, _MARK, np.uint8)
    low = lowered(data)
    low[_DIGITS[low]] = _MARK
    padded[np.arange(len(data)) + np.repeat(np.arange(1, texts + 1), np.diff(offsets))] = low
    inside = padded != _MARK
    begin = np.flatnonzero(np.diff(inside.view(np.int8)) == 1) + 1
    middle = np.flatnonzero(inside)  # the n-gram around each byte of a word, so every word has one
    sums = prefix_sums(padded)
    at = middle - 1
    rows = (span_hashes(sums, at, at + GRAM) >> np.uint64(64 - BITS)).astype(np.int32)
    first = np.searchsorted(begin, np.append(offsets[:-1] + np.arange(texts), len(padded)))
    return WordGrams(first, rows, np.searchsorted(middle, begin))


def mixtures(like: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each text by EM, and the log likelihood of its words.

    like: log likelihood of each word in each language, words of a text together; first: each text's first word.
    No text is without words.
    """
    counts = np.diff(first)
    top = like.max(axis=1, keepdims=True)
    p = np.exp(like - top)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        part = p * np.repeat(share, counts, axis=0)
        total = part.sum(axis=1, keepdims=True) + 1e-300
        part /= total
        share = np.add.reduceat(part, first[:-1], axis=0) / counts[:, None]
    total = (p * np.repeat(share, counts, axis=0)).sum(axis=1) + 1e-300
    return share, np.add.reduceat(np.log(total) + top[:, 0], first[:-1])


@dataclass
class LanguageModel:
    languages: list[str]
    logs: np.ndarray  # row of the table, language
    price: float = 3.0  # of each language beyond the first, times the logarithm of the number of words
    rounds: int = 8

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, list[list[tuple[str, float]]]]:
        data, offsets = utf8(texts)
        names: list[str] = []
        scores, sets = [], []
        for i, j in groups(np.diff(offsets), CHUNK):
            a, b, c = self._group(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            names += a
            scores.append(b)
            sets += c
        return names, np.concatenate(scores) if scores else np.zeros(0), sets

    def _group(self, data: np.ndarray, offsets: np.ndarray):
        w = word_grams(data, offsets)
        n = len(offsets) - 1
        names, scores, sets = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
        counts = np.diff(w.first)
        full = np.flatnonzero(counts)
        if not len(full) or not self.languages:
            return names, scores, sets
        # What a word says is damped for its n-grams overlap.
        like = np.add.reduceat(self.logs[w.row], w.start, axis=0) / GRAM
        first = np.append(w.first[full], len(w.start))
        k = len(self.languages)
        share, _ = mixtures(like, first, np.ones((len(full), k)), self.rounds)
        order = np.argsort(-share, axis=1, kind="stable")
        best, worth = np.zeros((len(full), k)), np.full(len(full), -np.inf)
        number, price = counts[full], self.price * np.log(counts[full] + 1)
        # No mixture says more than each word's best language, so a text is done when no larger set can be worth more.
        most = np.add.reduceat(like.max(axis=1), first[:-1])
        for size in range(1, k + 1):
            open_ = np.flatnonzero(most - price * (size - 1) > worth)
            if not len(open_):
                break
            allowed = np.zeros((len(open_), k))
            np.put_along_axis(allowed, order[open_, :size], 1.0, axis=1)
            words = np.repeat(np.isin(np.arange(len(full)), open_), number)
            got, log = mixtures(like[words], np.append(0, np.cumsum(number[open_])), allowed, self.rounds if size > 1 else 1)
            value = log - price[open_] * (size - 1)
            better = value > worth[open_]
            best[open_[better]], worth[open_[better]] = got[better], value[better]
        chosen = best.argmax(axis=1)
        for r, d in enumerate(full.tolist()):
            names[d] = self.languages[chosen[r]]
            scores[d] = min(1.0, best[r, chosen[r]])
            sets[d] = [(self.languages[x], float(best[r, x])) for x in np.flatnonzero(best[r] > 0)]
        return names, scores, sets


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that are kept out of training: crc32 of the id's text divides by 5. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for i, j in groups(np.diff(offsets), CHUNK):
            w = word_grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            doc = np.repeat(np.arange(i, j), np.diff(np.append(w.start, len(w.row))[w.first]))
            names, number = np.unique(langs[i:j].astype(str), return_inverse=True)
            for k, name in enumerate(names):
                n = np.bincount(w.row[number[doc - i] == k], minlength=1 << BITS)
                totals[name] = totals.get(name, 0) + n
    for name, n in totals.items():
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "row", "n"])


def train_language_id(docs: DataFrame, most_languages: int = 512, smoothing: float = 0.5) -> LanguageModel:
    """Counts n-grams of all rows that are not held out and have text, lang and doc_id. The driver receives one number for
    each language and row of the table; more than `most_languages` values of lang are an error."""
    rows = typed(docs, doc_id="long", text="string", lang="string").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    counts = rows.select("text", "lang").mapInArrow(_counted, "lang string, row int, n long").groupBy("lang", "row").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("row", "n")).alias("c"))  # at most 2 ** BITS each
    found = packed.orderBy("lang").limit(most_languages + 1).toLocalIterator()
    names, logs = [], []
    for r in found:
        n = np.full(1 << BITS, smoothing)
        n[[x.row for x in r.c]] += [x.n for x in r.c]
        names.append(r.lang)
        logs.append(np.log(n / n.sum()).astype(np.float32))
    if len(names) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    return LanguageModel(names, np.stack(logs, 1) if logs else np.zeros((1 << BITS, 0), np.float32))


def language_id(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of docs, then lang_pred, score (the proportion of lang_pred) and languages (all that were chosen).

    Takes text. Null texts and texts without letters, and all texts if the model knows no language, get `und` and 0.
    Words in letters of any script count. Earlier columns of these names are replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])

    def predicted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            names, scores, sets = shared.value.predict(texts)
            yield pa.array([{"lang_pred": n, "score": s, "languages": [{"lang": a, "share": b} for a, b in x]} for n, s, x in zip(names, scores.tolist(), sets, strict=True)], kind)

    guess = F.arrow_udf(predicted, "lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    out = docs.withColumn("languages", guess(F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))))
    return out.withColumns({"lang_pred": F.col("languages.lang_pred"), "score": F.col("languages.score"), "languages": F.col("languages.languages")})
