"""What the operators of this subpackage share: scratch tables and byte-level helpers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ship

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one in local mode (tests)."""
    global _own_dir
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="lakewright-")
        atexit.register(__import__("shutil").rmtree, _own_dir[7:], ignore_errors=True)
    return _own_dir


def _delete(spark: SparkSession, path: str) -> None:
    jvm, sc = spark._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder to cut lineage; readers survive the loss of executors.

    drop() removes a table that nothing reads any more, drop_others() all but those that a returned DataFrame still reads;
    these are removed when the session's JVM or the driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: set[str] = set()
        ship(spark)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/lakewright-{uuid.uuid4().hex}"
        df.write.parquet(path)
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).deleteOnExit(p)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.paths.discard(t._scratch_path)
            _delete(self.spark, t._scratch_path)

    def drop_others(self, *tables: DataFrame) -> None:
        """Removes all tables of this Scratch but these, which it also forgets."""
        for path in self.paths - {t._scratch_path for t in tables}:
            _delete(self.spark, path)
        self.paths.clear()


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on with other tasks and operators."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over a task's batches that gives freed memory back when it ends."""

    @functools.wraps(run)
    def tidied(*args, **options):
        try:
            yield from run(*args, **options)
        finally:
            give_back()

    return tidied


def typed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; columns of other names, whatever they are, do not disturb an operator."""
    ship(df.sparkSession)
    return df.select(*[df[f"`{c}`"].cast(kind).alias(c) for c, kind in columns.items()])


def row_key(*columns: str) -> Column:
    """64 bits of all columns of a row; nulls count."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def row_digest(doc_id: Column, text: Column) -> Column:
    """128 bits of a row's id and text; nulls count."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("="), text), F.lit("null")))))


def tile_side(rows: Column, least: int, most: Column | int) -> Column:
    """Rows to a side of the tiles in which the rows of a hot group meet: as the square root of their number grows, from
    `least` to `most`, so that n rows are copied n * sqrt(n / least) times at first and n * n / most times at worst."""
    grown = F.lit(least) * F.ceil(F.sqrt(rows / least))
    return F.least(grown, most if isinstance(most, Column) else F.lit(most))


def utf8(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes and its n + 1 offsets; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()) if not pa.types.is_large_string(arr.type) else arr
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    if arr.null_count:
        held = np.where(np.asarray(arr.is_valid()), np.diff(at), 0)
        if (held != np.diff(at)).any():
            return utf8(arr.fill_null(""))
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about `most` bytes; a larger row stands alone."""
    i, n, total = 0, len(sizes), 0
    for j in range(n):
        if j > i and total + sizes[j] > most:
            yield i, j
            i, total = j, 0
        total += int(sizes[j])
    if i < n:
        yield i, n


_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 2**64)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they were asked for."""

    def __init__(self, odd: int = int(_STEP)):
        self.odd, self.up, self.down = odd, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            with np.errstate(over="ignore"):
                for name, base in (("up", self.odd), ("down", _inverse(self.odd))):
                    x = np.full(size, base, np.uint64)
                    x[0] = 1
                    setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit; in place."""
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 sums of byte codes times rising powers; differences of them are polynomial hashes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * POWERS.reach(len(data))[0], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans start..end, independent of where they lie."""
    down = POWERS.reach(len(sums))[1]
    return mixed((sums[end] - sums[start]) * down[start])


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte substrings, by their start."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    n = len(data) - k + 1
    return mixed((sums[k:] - sums[:n]) * POWERS.reach(n)[1])


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    m, span = x, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (width - span)], m[width - span :]) if span < width else m


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs outside space and \\t..\\r, and for each text the index of its first word."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[offsets > 0] - 1
    last[edges] = inside[edges]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)
