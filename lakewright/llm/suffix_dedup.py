"""Removal of long byte strings that occur more than once in a corpus, by suffix arrays.

Every window of `length` bytes belongs to its anchor, the least hash of the k-byte substrings within it, so equal
windows have equal anchors wherever they lie. Consecutive windows of one anchor form a segment of fewer than
2 * length bytes. Equal segments are counted by digest. Where an anchor has segments that differ, one of each kind
is sorted in suffix arrays (two-stage sorting), whose adjacent common prefixes tell which windows recur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gram_hashes, groups, row_key, tidy, typed, utf8, window_min

GRAM = 32
CHUNK = 1 << 18  # bytes that are hashed at a time; also the longest run of windows of one text
BLOCK = 1 << 18  # bytes in one suffix array
KINDS = 2048  # segments of one anchor that are sorted together
_POS = np.uint64((1 << 20) - 1)


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, chunk: int = CHUNK):
    """For texts laid end to end: text, start within data, number of windows, anchor hash of each segment."""
    width = length - gram + 1
    sizes = np.diff(offsets)
    for i, j in groups(sizes, chunk):
        lo, hi = int(offsets[i]), int(offsets[j])
        for base in range(lo, max(hi - length + 1, lo + 1), chunk):
            part = data[base : min(base + chunk + length - 1, hi)] if hi - lo > chunk else data[lo:hi]
            if len(part) < length:
                continue
            h = gram_hashes(part, gram)
            tagged = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
            least = (window_min(tagged, width) & _POS).astype(np.int64)  # leftmost position of the anchor
            if hi - lo > chunk:
                begin, end, owner = np.array([0]), np.array([len(part) - length + 1]), np.array([i])
            else:
                owner = np.arange(i, j)[sizes[i:j] >= length]
                begin, end = offsets[owner] - lo, offsets[owner] - lo + sizes[owner] - length + 1
            if not len(begin):
                continue
            breaks = np.zeros(len(least) + 1, bool)
            breaks[1:-1] = least[1:] != least[:-1]
            breaks[begin] = True
            at = np.flatnonzero(breaks[:-1])
            of = np.searchsorted(begin, at, side="right") - 1
            ok = (of >= 0) & (at < end[of])
            at, of = at[ok], of[ok]
            stop = np.minimum(np.append(at[1:], len(least)), end[of])
            yield owner[of], at + (base if hi - lo > chunk else lo), stop - at, h[least[at]]


@tidy
def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        found = [h for *_, h in segments(data, offsets, length, gram)]
        if found:
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["anchor", "n"])


@tidy
def _occurrences(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        view, digest = memoryview(data), xxhash.xxh3_64_intdigest
        ids, keys = batch.column("doc_id"), batch.column("key")
        for of, start, n, h in segments(data, offsets, length, gram):
            d = np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)), np.uint64, len(start))
            take = pa.array(of)
            yield pa.record_batch(
                [pa.array(h.view(np.int64)), pa.array(d.view(np.int64)), ids.take(take), keys.take(take), pa.array(start - offsets[of]), pa.array(n.astype(np.int32))],
                ["anchor", "digest", "doc_id", "key", "start", "windows"],
            )


@tidy
def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        want = batch.column("want")
        rows = want.flatten()
        of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(want.offsets)))
        start = np.asarray(rows.field("start")) + offsets[of]
        end = start + np.asarray(rows.field("windows")) + length - 1
        raw = data.tobytes()
        yield pa.record_batch(
            [rows.field("anchor"), rows.field("digest"), rows.field("part"), rows.field("parts"), pa.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())],
            ["anchor", "digest", "part", "parts", "bytes"],
        )


_FLAGS = "anchor long, digest long, at int, window binary, found boolean"


@tidy
def _sorted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows that recur among the segments of an anchor; of an anchor in several parts, each part's windows."""

    def blocks() -> Iterator[list[tuple]]:
        held, size, key = [], 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "digest", "part", "parts", "bytes")], strict=True):
                if row[0:3:2] != key and size >= BLOCK:
                    yield held
                    held, size = [], 0
                key = row[0:3:2]
                held.append(row)
                size += len(row[4])
        if held:
            yield held

    for rows in blocks():
        offsets = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])]).astype(np.int64)
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        at, equal = repeated_windows(data, offsets, length)
        of = np.searchsorted(offsets, at, side="right") - 1
        _, where, count = np.unique(equal, return_inverse=True, return_counts=True)
        again = count[where] > 1
        many = np.array([r[3] > 1 for r in rows])[of]
        keep = again | many
        at, of, again, many = at[keep], of[keep], again[keep], many[keep]
        raw, digest = data.tobytes(), xxhash.xxh3_128_digest
        windows = [digest(raw[i : i + length]) if m else None for i, m in zip(at.tolist(), many.tolist(), strict=True)]
        a, d = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        yield pa.record_batch([pa.array(a[of]), pa.array(d[of]), pa.array((at - offsets[of]).astype(np.int32)), pa.array(windows, pa.binary()), pa.array(again)], ["anchor", "digest", "at", "window", "found"])


def repeated_windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    from .suffix_array import repeated

    return repeated(data, offsets, length)


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of byte ranges as maximal runs."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


@tidy
def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        spans = batch.column("spans")
        rows, at = spans.flatten(), np.asarray(spans.offsets) - spans.offsets[0].as_py()
        if spans.null_count:
            held = np.where(np.asarray(spans.is_valid()), np.diff(at), 0)
            at = np.concatenate([[0], np.cumsum(held)])
        lo, hi = np.asarray(rows.field("start")), np.asarray(rows.field("end"))
        size, gone, runs, kept, ranges = [], [], [], [], []
        raw = memoryview(data)
        for i in range(batch.num_rows):
            a, b = _merged(lo[at[i] : at[i + 1]], hi[at[i] : at[i + 1]])
            n, base = int(offsets[i + 1] - offsets[i]), int(offsets[i])
            edges = [0, *np.stack([a, b], 1).ravel().tolist(), n]
            left = b"".join(raw[base + x : base + y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            size.append(n)
            gone.append(n - len(left))
            runs.append(len(a))
            kept.append(left)
            ranges.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(ranges, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def suffix_dedup(docs: DataFrame, length: int = 200, gram: int = GRAM) -> DataFrame:
    """Removes every byte covered by a string of `length` bytes that also starts elsewhere, in any row of docs.

    Takes columns doc_id and text; others are ignored. Returns for each row of docs: doc_id, n_bytes, n_removed,
    n_spans, spans (the maximal removed byte ranges) and kept (the remaining bytes, binary: a cut may split a
    character). Null and empty texts, and texts shorter than `length`, lose nothing. Repeated rows count as different
    places: all of them lose what they share. doc_id may be null or repeated. An empty table gives an empty result.
    """
    if not 0 < gram < length:
        raise ValueError("gram must be at least 1 and less than length")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = typed(docs, doc_id="long", text="string").withColumn("key", row_key("doc_id", "text"))
    counted = docs.select("text").mapInArrow(lambda b: _anchors(b, length, gram), "anchor long, n long")
    # Written first, so that both sides of the join are plain exchanges and hot anchors can be split at run time.
    shared = scratch.keep(counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    places = docs.mapInArrow(lambda b: _occurrences(b, length, gram), "anchor long, digest long, doc_id long, key long, start long, windows int")
    places = scratch.keep(places.join(shared, "anchor"))
    scratch.drop(shared)
    kinds = places.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "start", "windows")).alias("one"))
    kinds = scratch.keep(kinds)
    unlike = kinds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor", F.ceil(F.col("k") / KINDS).cast("int").alias("parts"))
    chosen = kinds.join(unlike, "anchor").select("one.*", "anchor", "digest", "parts", F.pmod("digest", F.col("parts")).cast("int").alias("part"))
    wanted = chosen.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "digest", "part", "parts", "start", "windows")).alias("want"))
    same = lambda a, b: (a["key"] == b["key"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    held = docs.join(wanted, same(docs, wanted)).select("text", "want")
    cut = held.mapInArrow(lambda b: _cut(b, length), "anchor long, digest long, part int, parts int, bytes binary")
    cut = cut.dropDuplicates(["anchor", "digest"])  # repeated rows of docs give the same segments
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut.repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(lambda b: _sorted(b, length), _FLAGS)
    found = scratch.keep(found)
    across = found.where("window is not null")
    common = across.select("anchor", "window", F.xxhash64("digest", "at").alias("x")).groupBy("anchor", "window").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a <> b").select("anchor", "window")
    flags = found.where("found").select("anchor", "digest", "at").union(across.join(common, ["anchor", "window"]).select("anchor", "digest", "at"))
    flags = flags.groupBy("anchor", "digest").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    hits = kinds.select("anchor", "digest", "n").join(flags, ["anchor", "digest"], "left").where("n > 1 or ats is not null")
    # Written first, like `shared`: the rows of a hot segment are then split, or meet a small table without a shuffle.
    hits = scratch.keep(hits)
    scratch.drop(kinds, found)
    spans = places.join(hits, ["anchor", "digest"])
    whole = F.array(F.struct(F.col("start"), (F.col("start") + F.col("windows") + (length - 1)).alias("end")))
    parts = F.transform("ats", lambda x: F.struct((F.col("start") + x).alias("start"), (F.col("start") + x + length).alias("end")))
    spans = spans.select("doc_id", "key", F.when(F.col("n") > 1, whole).otherwise(parts).alias("s"))
    spans = spans.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("s")).alias("spans"))
    out = docs.join(spans, same(docs, spans), "left").select(docs["doc_id"], docs["text"], spans["spans"])
    return out.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
