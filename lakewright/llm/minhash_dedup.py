"""Near-duplicate documents: MinHash bands propose pairs, odd sketches estimate them, full sets of shingles decide.

Texts with equal sets form one class. Classes that share a band of MinHash values meet in a bucket. Each member of a
bucket is compared with the bucket's pivot; after that only members of buckets that still hold several components are
compared with each other, in tiles, and only where they lie in different components. So no group is expanded into all
its pairs, and no link that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, groups, mixed, prefix_sums, row_digest, span_hashes, tidy, tile_side, typed, utf8, words
from .graph import components

ROWS, BANDS = 5, 32  # a pair of similarity 0.8 shares no band with probability 3e-6
SKETCH, BINS = 8192, 1 << 17  # bits of a sketch; bins that its samples are taken from
BLOCK = 1024  # members of a bucket that are held by a task, at least; rows that pass by at a time
MOST = 16 * BLOCK  # members that are held at most, 1.3 KB each
PASSING = 8  # rows that pass by a task for each member it holds
CHUNK = 1 << 18

_rng = np.random.default_rng(19970529)
_MUL = (_rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)
_FOLD = _rng.integers(0, 2**63, (8, ROWS * BANDS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct word shingles; of a shorter text, its words as one."""
    data, offsets = utf8(texts)
    factors = np.random.default_rng(size).integers(0, 2**63, size + 1, dtype=np.uint64) | np.uint64(1)
    for i, j in groups(np.diff(offsets), CHUNK):
        at = offsets[i : j + 1] - offsets[i]
        part = LOWER[data[offsets[i] : offsets[j]]]
        start, end, first = words(part, at)
        w = span_hashes(prefix_sums(part), start, end)
        n = max(0, len(w) - size + 1)
        joined = np.zeros(n, np.uint64)
        for k in range(size):
            joined += w[k : k + n] * factors[k]
        joined = mixed(joined)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                s = np.sort(joined[a : b - size + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif b > a:
                yield mixed((w[a:b] * factors[: b - a]).sum(keepdims=True) * factors[size] + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def minhashes(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(len(_MUL), 2**32 - 1, np.uint32)
    for i in range(0, len(x), 256):
        h = x[i : i + 256] * _MUL
        h += _ADD
        h ^= h >> np.uint32(15)
        np.minimum(least, h.min(axis=0), out=least)
    return least


def odd_sketch(s: np.ndarray, bits: int = SKETCH, bins: int = BINS) -> tuple[np.ndarray, int]:
    """Parity bitmap of one-permutation MinHash samples, and their number.

    The leading bits of a hash choose one of the bins, and a bin's sample is its least hash; so of a sorted set the
    samples are the first hashes of each bin. Each sample flips the bit that its own hash chooses.
    """
    of = s >> np.uint64(65 - bins.bit_length())
    samples = s[np.append(True, of[1:] != of[:-1])]
    at = mixed(samples * _FOLD[5, 0]) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1), len(samples)


def estimated(flips, size_a, size_b, samples_a, samples_b, near: float = 0.8, bits: int = SKETCH, bins: int = BINS) -> np.ndarray:
    """Similarity from the population count of two sketches' XOR, most exact about `near`.

    The count tells how many samples differ. Bins that either set reaches follow from the sizes.
    """
    differ = -bits / 2 * np.log1p(-2 * np.minimum(np.asarray(flips) / bits, 0.4999))
    union = (np.asarray(size_a) + size_b) / (1 + near)
    reached = bins * -np.expm1(union * np.log1p(-1 / bins))
    return (np.asarray(samples_a) + samples_b - differ) / 2 / reached


def margin(size_a, size_b, near: float = 0.8) -> np.ndarray:
    """More than four standard deviations of the estimate below; fuller bitmaps tell less, and very small sets come in steps."""
    union = (np.asarray(size_a) + size_b) / (1 + near)
    return 0.014 + 0.4 / union + 0.006 * -np.expm1(-union / 8000)


def may_link(flips, size_a, size_b, samples_a, samples_b, near: float) -> np.ndarray:
    """Whether a pair's similarity may reach `near`. Nearly full bitmaps, of very large sets, tell nothing and pass."""
    size_a, size_b = np.asarray(size_a), np.asarray(size_b)
    guess = estimated(flips, size_a, size_b, samples_a, samples_b, near)
    near_sizes = np.minimum(size_a, size_b) >= near * np.maximum(size_a, size_b) - 1e-9
    return near_sizes & ((guess >= near - margin(size_a, size_b, near)) | (np.asarray(flips) > 0.45 * SKETCH))


def _bands(least: np.ndarray) -> np.ndarray:
    parts = least.astype(np.uint64).reshape(BANDS, ROWS) + np.uint64(1)
    return mixed((parts * _FOLD[:ROWS, :BANDS].T).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * _FOLD[6, 0])


@tidy
def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, cls, bands, sketch, samples = [], [], [], [], []
        for s in shingle_sets(batch.column("text"), size):
            n.append(len(s))
            if not len(s):
                cls.append(None), bands.append(None), sketch.append(None), samples.append(0)
                continue
            least = minhashes(s)
            cls.append(xxhash.xxh3_128_digest(s))
            bands.append(_bands(least).view(np.int64))
            flipped, count = odd_sketch(s)
            sketch.append(flipped.tobytes()), samples.append(count)
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(samples, pa.int32()), pa.array([b if b is None else b.tobytes() for b in bands], pa.binary())],
            ["doc_id", "key", "n_shingles", "cls", "bands", "sketch", "samples", "all_bands"],
        )


def _flips(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


@tidy
def _likely(batches: Iterator[pa.RecordBatch], near: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            na, nb, ka, kb = (np.asarray(batch.column(c)) for c in ("na", "nb", "ka", "kb"))
            ok = may_link(_flips(_stack(batch.column("sa")), _stack(batch.column("sb"))), na, nb, ka, kb, near)
            yield batch.select(["a", "b"]).filter(pa.array(ok))


@tidy
def _verified(batches: Iterator[pa.RecordBatch], size: int, per_cent: int) -> Iterator[pa.RecordBatch]:
    last, kept = None, None
    for batch in batches:
        ok = []
        sets = shingle_sets(batch.column("ta"), size)
        for x, b, text in zip(sets, batch.column("b"), batch.column("tb"), strict=True):
            if b != last:
                last, kept = b, next(shingle_sets(pa.array([text.as_py()], pa.string()), size))
            if min(len(x), len(kept)) * 100 < per_cent * max(len(x), len(kept)):
                ok.append(False)
                continue
            both = len(np.intersect1d(x, kept, assume_unique=True))
            ok.append(100 * both >= per_cent * (len(x) + len(kept) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


@tidy
def _across(batches: Iterator[pa.RecordBatch], near: float) -> Iterator[pa.RecordBatch]:
    """Likely pairs of different components within a tile of a bucket: its members, which come first and are held,
    against a part of the bucket's minority, BLOCK rows at a time."""

    def out(members: list[tuple], minority: list[tuple]) -> pa.RecordBatch:
        rows, a, b = members + minority, [], []
        if members and minority:
            sketches = np.frombuffer(b"".join(r[3] for r in members), np.uint64).reshape(len(members), -1)
            number = {c: k for k, c in enumerate({r[2] for r in rows})}
            of, size, samples = (np.array(x) for x in zip(*((number[r[2]], r[4], r[5]) for r in members), strict=True))
            bands = np.frombuffer(b"".join(r[7] for r in members), np.int64).reshape(len(members), -1)
            for r in minority:
                ok = (of != number[r[2]]) & (np.minimum(size, r[4]) >= near * np.maximum(size, r[4]) - 1e-9)
                at = np.flatnonzero(ok)
                shared = bands[at] == np.frombuffer(r[7], np.int64)  # a pair counts where it meets first
                at = at[bands[at, shared.argmax(axis=1)] == r[0][0]]
                flips = _flips(sketches[at], np.frombuffer(r[3], np.uint64))
                for k in at[may_link(flips, size[at], r[4], samples[at], r[5], near)]:
                    a.append(max(r[1], members[k][1]))
                    b.append(min(r[1], members[k][1]))
        return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    members, minority, key = [], [], None
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("band", "block", "part", "cls", "root", "sketch", "size", "samples", "lone", "all_bands")], strict=True):
            if row[:3] != key or len(minority) >= BLOCK:
                yield out(members, minority)
                minority = []
                if row[:3] != key:
                    members, key = [], row[:3]
            (minority if row[8] else members).append((key, *row[3:]))
    yield out(members, minority)


def one_of_each_group(docs: DataFrame, words_per_shingle: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that stand for their group of near copies (see minhash_dedup).

    Rows without words are groups of their own, and all kept. A group's row is one with its least doc_id. Of rows equal in
    doc_id and text that with the least hash of all its columns (but maps) is taken.
    """
    found = minhash_dedup(docs, words_per_shingle, per_cent)
    marks = found.where("key = head").select(F.col("key").alias("_lakewright_key")).distinct()
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    words = F.coalesce(text.rlike(r"[^ \t-\r]"), F.lit(False))
    named = docs.where(words).withColumn("_lakewright_key", row_digest(doc_id, text)).join(marks, "_lakewright_key", "left_semi")
    columns = [named[f"`{c}`"] for c in docs.columns]
    order = F.xxhash64(*[c for c, f in zip(columns, docs.schema, strict=True) if "map<" not in f.dataType.simpleString()])
    heads = named.groupBy("_lakewright_key").agg(F.min_by(F.struct(*columns), order).alias("row"))
    return heads.select("row.*").union(docs.where(~words))


def minhash_dedup(docs: DataFrame, words_per_shingle: int = 5, per_cent: int = 80) -> DataFrame:
    """Groups of near copies. Takes doc_id and text; returns doc_id, n_shingles, component_id and kept, and key.

    Texts are lower-cased in A-Z and split at space and \\t..\\r. Two rows are linked if their sets of word shingles have
    a Jaccard similarity of per_cent / 100 or more, counted on full sets. component_id is the least doc_id that links
    reach; of several rows with that id in a group, those with the least key are kept. Null, empty and blank texts have no
    shingles and are linked with nothing. A null doc_id is passed over when the least is taken; a group of nulls alone
    has a null component_id. Pairs are taken up if the odd sketches' estimate comes within its margin of error.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = typed(docs, doc_id="long", text="string").withColumn("key", row_digest(F.col("doc_id"), F.col("text")))
    near = per_cent / 100
    base = docs.mapInArrow(lambda b: _signed(b, words_per_shingle), "doc_id long, key binary, n_shingles long, cls binary, bands array<long>, sketch binary, samples int, all_bands binary")
    base = scratch.keep(base)
    alike = base.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("one"))
    first = base.select("cls", "bands", "all_bands", "sketch", "samples", F.col("n_shingles").alias("size"), F.col("key").alias("one")).where("cls is not null")
    classes = scratch.keep(alike.join(first, ["cls", "one"]).dropDuplicates(["cls"]))
    members = classes.select(F.explode("bands").alias("band"), "cls")
    pivots = members.groupBy("band").agg(F.min("cls").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = scratch.keep(members.join(pivots, "band").select("band", "cls", "pivot"))
    sketches = classes.select("cls", "sketch", "size", "samples")
    every_band = classes.select("cls", "all_bands")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs a, b that are similar enough."""
        needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        needed = classes.select("cls", "one").join(needed, "cls")
        # Written, so that the joins below read plain exchanges and a frequent pivot can be split at run time.
        text = scratch.keep(docs.join(needed, F.col("key") == F.col("one")).select("cls", "text").dropDuplicates(["cls"]))
        ta, tb = text.toDF("a", "ta"), text.toDF("b", "tb")
        both = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
        return both.mapInArrow(lambda x: _verified(x, words_per_shingle, per_cent), "a binary, b binary")

    pairs = members.where("cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = pairs.join(sketches.toDF("a", "sa", "na", "ka"), "a").join(sketches.toDF("b", "sb", "nb", "kb"), "b")
    likely = scratch.keep(pairs.mapInArrow(lambda x: _likely(x, near), "a binary, b binary"))
    links = scratch.keep(linked(likely))
    roots = components(links, scratch)

    # Buckets that hold several components: the largest one's members against all others.
    placed = members.join(roots, F.col("cls") == F.col("vertex"), "left").select("band", "cls", F.coalesce("root", "cls").alias("root"))
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed_bands = sizes.groupBy("band").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("k")).where("k > 1")
    side = tile_side(F.col("all"), BLOCK, MOST)
    blocks, parts = F.ceil(F.col("all") / side), F.ceil((F.col("all") - F.col("top.n")) / (side * PASSING))
    mixed_bands = mixed_bands.select("band", F.col("top.root").alias("major"), blocks.cast("int").alias("blocks"), parts.cast("int").alias("parts"))
    left = placed.join(mixed_bands, "band").join(sketches, "cls").join(every_band, "cls")
    one_of = lambda n, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(n)).cast("int")
    each_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    common = ["band", "cls", "root", "sketch", "size", "samples", "all_bands"]
    minority = left.where("root <> major").select(*common, each_of("blocks").alias("block"), one_of("parts", 1).alias("part"), F.lit(True).alias("lone"))
    rest = left.select(*common, one_of("blocks", 0).alias("block"), each_of("parts").alias("part"), F.lit(False).alias("lone")).union(minority)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = rest.repartition(n, "band", "block", "part").sortWithinPartitions("band", "block", "part", "lone").mapInArrow(lambda x: _across(x, near), "a binary, b binary").distinct()
    rest = scratch.keep(rest.join(likely, ["a", "b"], "left_anti"))
    if rest.take(1):
        more = scratch.keep(linked(rest))
        if more.take(1):
            roots = components(links.union(more), scratch)

    ids = classes.join(roots, F.col("cls") == F.col("vertex"), "left").select("cls", "least_id", "one", F.coalesce("root", "cls").alias("root"))
    ids = scratch.keep(ids)
    scratch.drop_others(base, ids)
    heads = ids.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min_by("one", F.struct(F.col("least_id").isNull(), "least_id", "one")).alias("head"))
    ids = ids.join(heads, "root").select("cls", "component_id", "head")
    found = base.select("doc_id", "key", "n_shingles", "cls").join(ids, "cls", "left")
    component: Column = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), "key", "head").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
