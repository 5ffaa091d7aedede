"""Near-duplicate embeddings by lattice hashing: random projections to eight dimensions, decoded to E8 points.

In each of several tables a vector lies in the cell of its nearest lattice point and probes neighbouring cells. Two
vectors meet in a table if one probes or shares the cell of the other; their cosine then decides. Equal vectors are one
class. Large cells are split into tiles, a block of targets that a part of the cell's sources passes by, so no task holds
or reads a whole cell. A pair that meets more than once is counted at its first meeting only, which both vectors' codes tell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mixed, tidy, tile_side
from .graph import components
from .lattice import probes

TABLES, PROBES, SCALE = 6, 3, 3.0
BLOCK = 512  # targets of a tile at least
TILE = 1 << 24  # bytes of its targets' vectors at most, unless BLOCK targets have more
PASSING = 8  # sources of a tile for each of its targets
PAIRS = 1 << 21  # cosines that are held at a time
CODED = 2048  # vectors that are decoded at a time
_FOLD = np.random.default_rng(8).integers(0, 2**63, 10, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=16)
def _projections(dim: int, tables: int, scale: float) -> np.ndarray:
    """For each table eight orthonormal rows (fewer for dim < 8, filled with zeros), scaled to keep lengths."""
    out = np.zeros((tables, dim, 8))
    for t in range(tables):
        q, _ = np.linalg.qr(np.random.default_rng([dim, t]).normal(size=(dim, min(8, dim))))
        out[t, :, : q.shape[1]] = q * scale * np.sqrt(max(1.0, dim / 8))
    return out


def codes(unit: np.ndarray, tables: int, count: int, scale: float) -> np.ndarray:
    """Hashes of the cells of unit vectors: vector, table, own cell and then the probed ones."""
    out = np.empty((len(unit), tables, count), np.uint64)
    for i in range(0, len(unit), CODED):
        part = unit[i : i + CODED]
        for t, p in enumerate(_projections(unit.shape[1], tables, scale)):
            points = (2 * probes(part @ p, count)).astype(np.int64).view(np.uint64)
            out[i : i + CODED, t] = mixed((points * _FOLD[:8]).sum(axis=-1) + np.uint64(t + 1) * _FOLD[8])
    return out


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@tidy
def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls, raw = [], []
        column = batch.column("embedding")
        values = column.flatten()
        flat = np.asarray(values.fill_null(float("nan")), np.float64) if values.null_count else np.asarray(values, np.float64)
        at = np.asarray(column.offsets) - column.offsets[0].as_py()
        for i, label in enumerate(batch.column("label").to_pylist()):
            v = flat[at[i] : at[i + 1]] if column[i].is_valid else flat[:0]
            if label is None or not len(v) or not np.isfinite(v).all() or not v.any():
                cls.append(None), raw.append(None)
            else:
                b = (v + 0.0).tobytes()
                cls.append(xxhash.xxh3_128_digest(b + str(label).encode())), raw.append(b)
        yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(cls, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "label", "cls", "vec"])


@tidy
def _celled(batches: Iterator[pa.RecordBatch], tables: int, count: int, scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("vec").to_pylist()
        labels = batch.column("label").to_pylist()
        size = np.array([len(r) for r in raw])
        for dim in np.unique(size):
            rows = np.flatnonzero(size == dim)
            code = codes(_units([raw[i] for i in rows]), tables, count, scale)
            of = mixed(np.array([hash_label(labels[i], dim) for i in rows], np.uint64))
            flat = (code ^ of[:, None, None]).reshape(-1).view(np.int64)
            n = tables * count
            yield pa.record_batch(
                [pa.array(flat), pa.array(np.tile(np.arange(n) % count == 0, len(rows))), pa.array(np.tile(np.repeat(np.arange(tables), count), len(rows)).astype(np.int32)), batch.column("cls").take(pa.array(np.repeat(rows, n))), pa.array(np.full(len(flat), dim))],
                ["cell", "own", "tab", "cls", "size"],
            )


def hash_label(label, dim) -> int:
    return xxhash.xxh3_64_intdigest(f"{label}/{dim}".encode())


def _first_meeting(a: np.ndarray, b: np.ndarray, tab: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Whether table `tab` is the first in which the codes a and b of each pair meet, and this side is to count it."""
    forth = (a == b[:, :, :1]).any(axis=2)  # a shares or probes b's cell
    back = (b == a[:, :, :1]).any(axis=2)
    met = forth | back
    first = met.argmax(axis=1) == tab
    row = np.arange(len(tab))
    return first & (smaller | ~back[row, tab])


def _numbers(cls: list[bytes]) -> np.ndarray:
    """Digests as two numbers each, in the same order."""
    return np.frombuffer(b"".join(cls), ">u8").astype(np.uint64).reshape(-1, 2)


class _Targets:
    """The targets of a tile; what is derived from them is made once, when the first source asks."""

    def __init__(self, cls: list[bytes], n: np.ndarray, vec: list[bytes]):
        self.cls, self.n, self.vec = cls, n, vec

    def with_more(self, cls: list[bytes], n: np.ndarray, vec: list[bytes]) -> _Targets:
        return _Targets(self.cls + cls, np.concatenate([self.n, n]), self.vec + vec)

    @cached_property
    def units(self) -> np.ndarray:
        return _units(self.vec)

    @cached_property
    def numbers(self) -> np.ndarray:
        return _numbers(self.cls)

    def codes(self, *options) -> np.ndarray:
        if "_codes" not in vars(self):
            self._codes = codes(self.units, *options)
        return self._codes


@tidy
def _linked(batches: Iterator[pa.RecordBatch], least: float, tables: int, count: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Within each tile, sources against targets: what a link adds to the count of each class, and links that span."""
    key, kept = None, None
    for batch in batches:
        tile = np.stack([np.asarray(batch.column(c), np.int64) for c in ("cell", "block", "part", "role")], axis=1)
        edges = np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1
        edges = np.concatenate([[0], edges, [batch.num_rows]]) if batch.num_rows else np.zeros(1, np.int64)
        cls, n, vec, tab = (batch.column(c).to_pylist() for c in ("cls", "n", "vec", "tab"))
        added: dict[bytes, int] = {}
        pairs: list[tuple[bytes, bytes]] = []
        for lo, hi in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            *here, role = tile[lo].tolist()
            if role == 0:
                part = (cls[lo:hi], np.array(n[lo:hi], np.int64), vec[lo:hi])
                kept = kept.with_more(*part) if here == key else _Targets(*part)
                key = here
                continue
            if here != key or (len(kept.cls) == 1 and hi - lo == 1 and kept.cls[0] == cls[lo]):
                continue
            step = max(1, PAIRS // len(kept.cls))
            for at in range(lo, hi, step):
                to = min(at + step, hi)
                sources = _units(vec[at:to])
                s, t = np.nonzero(sources @ kept.units.T >= least)
                a, b = _numbers(cls[at:to])[s], kept.numbers[t]
                other = (a != b).any(axis=1)
                s, t, a, b = s[other], t[other], a[other], b[other]
                if not len(s):
                    continue
                smaller = (a[:, 0] < b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] < b[:, 1]))
                met, of = np.unique(s, return_inverse=True)
                sc, tc = codes(sources[met], tables, count, scale), kept.codes(tables, count, scale)
                first = np.zeros(len(s), bool)
                for i in range(0, len(s), 1 << 16):
                    x = slice(i, i + (1 << 16))
                    first[x] = _first_meeting(sc[of[x]], tc[t[x]], np.full(len(s[x]), tab[lo]), smaller[x])
                s, t = s[first], t[first]
                here_n = np.array(n[at:to], np.int64)
                to_source = np.bincount(s, kept.n[t], to - at).astype(np.int64)
                to_target = np.bincount(t, here_n[s], len(kept.cls)).astype(np.int64)
                for i in np.flatnonzero(to_source):
                    added[cls[at + i]] = added.get(cls[at + i], 0) + int(to_source[i])
                for j in np.flatnonzero(to_target):
                    added[kept.cls[j]] = added.get(kept.cls[j], 0) + int(to_target[j])
                pairs += _spanning(s, t, cls[at:to], kept.cls)
        names = list(added)
        yield pa.record_batch([pa.array(names, pa.binary()), pa.array([added[x] for x in names], pa.int64()), pa.nulls(len(names), pa.binary())], ["a", "n", "b"])
        yield pa.record_batch([pa.array([a for a, _ in pairs], pa.binary()), pa.array([0] * len(pairs), pa.int64()), pa.array([b for _, b in pairs], pa.binary())], ["a", "n", "b"])


def _spanning(s: np.ndarray, t: np.ndarray, sources: list[bytes], targets: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Links that connect what all links s, t connect."""
    label = np.arange(len(sources) + len(targets))
    t = t + len(sources)
    while True:
        low = np.minimum(label[s], label[t])
        new = label.copy()
        np.minimum.at(new, s, low)
        np.minimum.at(new, t, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    names = sources + targets
    return [(names[i], names[label[i]]) for i in np.flatnonzero(label != np.arange(len(label)))]


def embedding_dedup(vectors: DataFrame, cosine: float = 0.98, tables: int = TABLES, count: int = PROBES, scale: float = SCALE) -> DataFrame:
    """Links vectors of one label whose cosine is at least `cosine`, as far as the lattice tables bring them together.

    Takes vec_id, embedding and label. Returns vec_id, n_links (other rows linked directly), component_id (the least
    vec_id that links reach) and kept (vec_id = component_id). Vectors with a null label, and vectors that are null, empty,
    zero or hold nulls, NaN or infinities, link with nothing; vectors of different dimensions do not link. Equal vectors
    of one label always link; repeated rows count each. A null vec_id is passed over for component_id and not kept.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = scratch.keep(rows.mapInArrow(_classes, "vec_id long, label string, cls binary, vec binary"))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"), F.min("label").alias("label"), F.min("vec").alias("vec"))
    classes = scratch.keep(classes)
    cells = scratch.keep(classes.select("cls", "label", "vec").mapInArrow(lambda b: _celled(b, tables, count, scale), "cell long, own boolean, tab int, cls binary, size long"))
    full = cells.groupBy("cell").agg(F.count_if("own").alias("owners"), F.count("*").alias("all"), F.max("size").alias("size")).where("owners > 0 and all > 1")
    side = tile_side(F.col("owners"), BLOCK, F.greatest(F.lit(BLOCK), F.floor(F.lit(TILE) / F.col("size"))))
    full = full.select("cell", F.ceil(F.col("owners") / side).cast("int").alias("blocks"), F.ceil(F.col("all") / (side * PASSING)).cast("int").alias("parts"))
    full = scratch.keep(full)
    placed = cells.join(full, "cell")
    one_of = lambda n, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(n)).cast("int")
    each_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    common = ["cell", "tab", "cls"]
    targets = placed.where("own").select(*common, one_of("blocks", 0).alias("block"), each_of("parts").alias("part"), F.lit(0).alias("role"))
    sources = placed.select(*common, each_of("blocks").alias("block"), one_of("parts", 1).alias("part"), F.lit(1).alias("role"))
    dealt = targets.union(sources).join(classes.select("cls", "n", "vec"), "cls")
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(shuffle, "cell", "block", "part").sortWithinPartitions("cell", "block", "part", "role")
    found = scratch.keep(dealt.mapInArrow(lambda b: _linked(b, cosine, tables, count, scale), "a binary, n long, b binary"))
    links = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b"), scratch)
    ids = classes.join(roots, F.col("cls") == F.col("vertex"), "left").select("cls", "n", "least_id", F.coalesce("root", "cls").alias("root"))
    ids = scratch.keep(ids.join(links, "cls", "left"))
    scratch.drop_others(rows, ids)
    heads = ids.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = ids.join(heads, "root").select("cls", "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "cls").join(ids, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
