"""Personal data in texts, disguised or not, by source offsets.

Plain identifiers are matched in the text as it is. Then transducers rewrite disguises: look-alike letters and digits of
other scripts, invisible characters, `at` and `dot` in brackets or between words, spelled digits, also among plain ones,
and letters within numbers. Every character of the normalised text keeps the source span it came from, so what is found
there maps back to source characters. All patterns take linear time.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import ship
from .common import tidy

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield Span("email", start, done)
        at = text.find("@", at + 1)


def plain(text: str) -> list[Span]:
    """Identifiers as they stand, leftmost and without overlap within a kind; failed matches are not retried."""
    out = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            out.append(Span("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(Span("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(Span("phone", *m.span()))
    return out


# Letters of other scripts, each followed by the Latin one it looks like (fixed values).
_PAIRS = """
аa еe оo рp сc уy хx іi јj ѕs һh ԁd ѵv ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS
αa οo оo рp ιi κk νv ρp τt υu χx ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX
"""
_LOOKALIKES = {p[0]: p[1] for p in _PAIRS.split()}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_WIDE = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
_DECIMALS = {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x20000) if chr(c).isdecimal()}
_SIGNS = {"\u2024": ".", "\u3002": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u00a0": " ", "\u202f": " "}
_SWAP = _LOOKALIKES | _DECIMALS | _WIDE | _SIGNS
# All that letters() changes, and what re.I takes for s and i, as in number words.
_STRANGE = frozenset([*_SWAP, *_INVISIBLE, *"\u017f\u0131\u0130"])
_NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_DIGIT = {w: str(i) for i, w in enumerate(_NUMBERS)} | {"oh": "0"}
_ONE = rf"(?:{'|'.join(_DIGIT)})"
# Digits in words or figures, with at most one sign, dot or point between two of them. Every part has one way to match.
_GAP = r"[ ]*+(?:[-,.][ ]*+|(?<=[ ])(?:dot|point)[ ]++)?+"
_SPELLED = re.compile(rf"(?:\bplus[ ]++|\+[ ]?+|\b)(?:{_ONE}|[0-9])(?:{_GAP}(?:{_ONE}|[0-9]))*+", re.I)
_WORDS = re.compile("|".join(_DIGIT))
_BETWEEN = re.compile(r"(?:[ ,.0-9-]|dot|point)*+")
_PART = re.compile(rf"plus|\+|dot|point|{_ONE}|[0-9]|\.", re.I)
_LEAST, _LEAST_WORDS = 4, 3  # digits of a run that is rewritten, and those in words among them
_BRACKETED = re.compile(r"[\[({<]\s*+(at|dot|@|\.)\s*+[\])}>]", re.I)
_AFTER = re.compile(r"\s*+")
# Endings that make words joined by `at` and `dot` an address (fixed values).
_ENDINGS = "com|org|net|edu|gov|info|biz|io|co|ai|app|dev|me|eu|uk|us|ca|au|de|fr|es|it|nl|ch|at|be|br|in|jp|cn|ru|pl|se"
_WORDY = re.compile(rf"(?<![\w.%+-])[\w.%+-]++([ ]++at[ ]++)[\w-]++(?:[ ]++dot[ ]++[\w-]++)*[ ]++dot[ ]++(?:{_ENDINGS})(?![\w-])", re.I)
_DOT = re.compile(r"[ ]++dot[ ]++", re.I)
# Figures with letters that pass for 0 and 1 among them.
_INEXACT = re.compile(r"(?<!\w)[0-9OoIl]++(?!\w)")
_PASSES_FOR = {"O": "0", "o": "0", "I": "1", "l": "1"}
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in "0123456789"]] = 1
_CLASS[[ord(c) for c in _PASSES_FOR]] = 2


class Traced:
    """A text and the source span of each of its characters; no spans: it is the source."""

    def __init__(self, text: str, spans: list[tuple[int, int]] | None = None):
        self.text, self.spans = text, spans

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.spans is None else (self.spans[start][0], self.spans[end - 1][1])

    def rewritten(self, changes: list[tuple[int, int, str]]) -> Traced:
        """With the ranges of a sorted list replaced; all characters of a replacement stem from its whole range."""
        if not changes:
            return self
        known = self.spans if self.spans is not None else [(i, i + 1) for i in range(len(self.text))]
        text, spans, at = [], [], 0
        for a, b, new in changes:
            text += [self.text[at:a], new]
            spans += known[at:a]
            spans += [(known[a][0], known[b - 1][1])] * len(new)
            at = b
        return Traced("".join([*text, self.text[at:]]), spans + known[at:])


def letters(t: Traced) -> Traced:
    if t.text.isascii() or _STRANGE.isdisjoint(set(t.text)):
        return t
    return t.rewritten([(i, i + 1, _SWAP.get(c, "")) for i, c in enumerate(t.text) if c in _SWAP or c in _INVISIBLE])


def _bracketed(text: str) -> Iterator[tuple[int, int, str]]:
    """Signs in brackets with the white space around them."""
    done = 0
    for m in _BRACKETED.finditer(text):
        start = m.start()
        while start > done and text[start - 1].isspace():
            start -= 1
        done = _AFTER.match(text, m.end()).end()
        yield start, done, "@" if m[1].lower() in ("at", "@") else "."


def signs(t: Traced) -> Traced:
    if "[" in t.text or "(" in t.text or "{" in t.text or "<" in t.text:
        t = t.rewritten(list(_bracketed(t.text)))
    if " dot " not in t.text.lower():
        return t
    changes = []
    for m in _WORDY.finditer(t.text):
        changes.append((*m.span(1), "@"))
        changes += [(*d.span(), ".") for d in _DOT.finditer(t.text, m.end(1) - 1, m.end())]
    return t.rewritten(changes)


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _SPELLED.finditer(text):
        if m.end() - m.start() < _LEAST + _LEAST_WORDS or m[0].isdigit():
            continue
        parts = [(*p.span(), p[0].lower()) for p in _PART.finditer(text, *m.span())]
        while parts and (parts[-1][2] == "." or (e := parts[-1][1]) < len(text) and (text[e].isalnum() or text[e] == "_")):
            parts.pop()  # the run ends at the last whole word
            while parts and parts[-1][2] in (".", "dot", "point"):
                parts.pop()
        if sum(w in _DIGIT for *_, w in parts) < _LEAST_WORDS or sum(w in _DIGIT or w.isdigit() for *_, w in parts) < _LEAST:
            continue
        at = m.start()
        for a, b, word in parts:
            if a > at:
                yield at, a, ""  # between the digits
            yield a, b, "+" if word in ("plus", "+") else _DIGIT.get(word, word if word.isdigit() else ".")
            at = b


def _may_spell(text: str) -> bool:
    """Whether as many number words as a run needs follow each other with nothing else between them."""
    if not text.isascii() and any(c in text for c in "\u017f\u0131\u0130"):
        return True
    chain, last, low = 0, -1, text.lower()
    for m in _WORDS.finditer(low):
        chain = chain + 1 if last >= 0 and _BETWEEN.match(low, last).end() >= m.start() else 1
        if chain == _LEAST_WORDS:
            return True
        last = m.end()
    return False


def numbers(t: Traced) -> Traced:
    if _may_spell(t.text):
        t = t.rewritten(list(_spelled(t.text)))
    kinds = _CLASS[np.frombuffer(t.text.encode(), np.uint8)]
    if not (kinds[1:] + kinds[:-1] == 3).any():
        return t
    runs = [m for m in _INEXACT.finditer(t.text) if any(c in _PASSES_FOR for c in m[0]) and any(c not in _PASSES_FOR for c in m[0])]
    return t.rewritten([(i, i + 1, _PASSES_FOR[c]) for m in runs for i, c in enumerate(m[0], m.start()) if c in _PASSES_FOR])


def suspicious(text: str) -> bool:
    """Whether a transducer changes the text."""
    return numbers(signs(letters(Traced(text)))).spans is not None


def disguised(text: str, known: list[Span]) -> list[Span]:
    """Identifiers that only the normalised text shows: those that lie within no known one of their kind."""
    t = numbers(signs(letters(Traced(text))))
    if t.spans is None:
        return []
    out = []
    starts, ends = ({kind: [k[at] for k in known if k.kind == kind] for kind in KINDS} for at in (1, 2))
    for s in plain(t.text):
        span = Span(s.kind, *t.span(s.start, s.end))
        if text[span.start : span.end] == t.text[s.start : s.end]:
            continue
        before = bisect_right(starts[s.kind], span.start)
        if not before or ends[s.kind][before - 1] < span.end:
            out.append(span)
    return out


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """All spans by kind, then start, then end: kind, start, end, whether it was disguised. Spans of one kind may overlap
    where a disguised identifier holds a plain one as a part."""
    if not text:
        return []
    base = plain(text)
    rows = [(*s, False) for s in base] + [(*s, True) for s in disguised(text, base)]
    return sorted(rows, key=lambda r: (KINDS.index(r[0]), *r[1:3]))


_SPANS = "array<struct<kind:string,start:int,end:int,disguised:boolean>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())]))


def pii_spans(text: Column) -> Column:
    """The spans of a text column: code points, end exclusive; by kind (email, ip, card, phone), then start."""

    @tidy
    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([[dict(zip(("kind", "start", "end", "disguised"), r, strict=True)) for r in find(t)] for t in texts.to_pylist()], _TYPE)

    return F.arrow_udf(found, _SPANS)(text)


def find_pii(docs: DataFrame) -> DataFrame:
    """All columns of docs and `pii`, the spans found in text; null and empty texts have none. Replaces an earlier pii."""
    ship(docs.sparkSession)
    return docs.withColumn("pii", pii_spans(F.col("text")))


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda r: (r[1], -r[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; of overlapping spans the first names the whole."""

    @tidy
    def done(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([masked(t, s) if (s := find(t)) else t for t in texts.to_pylist()], pa.string())

    ship(docs.sparkSession)
    return docs.withColumn("text", F.arrow_udf(done, "string")(F.col("text")))
