"""Z-order keys: the bits of each column's rank, interleaved."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema as S

EXACT = 4096  # distinct values up to which ranks are exact; beyond that, as many quantiles are told apart
BITS = 32


def _orderable(c: Column, kind: T.DataType) -> Column:
    """A column as a number or a string of the same order."""
    match kind:
        case T.TimestampType():
            return F.unix_micros(c)
        case T.TimestampNTZType():
            return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), "UTC"))
        case T.DateType():
            return F.unix_date(c).cast("long")
        case T.BooleanType():
            return c.cast("long")
        case T.BinaryType():
            return F.hex(c)
        case T.StringType():
            return F.hex(F.encode(c, "UTF-8"))
        case T.DecimalType():
            return c.cast("double")
        case T.FloatType() | T.DoubleType():
            return c.cast("double")
    return c.cast("long")


def boundaries(df: DataFrame, column: str) -> list:
    """Sorted values between which ranks differ: all distinct ones, or quantiles; at most EXACT either way."""
    c = _orderable(S.name(column), df.schema[column].dataType)
    values = df.select(c.alias("v")).where("v is not null")
    distinct = [r.v for r in values.distinct().limit(EXACT + 1).collect()]
    if len(distinct) <= EXACT:
        return sorted(distinct)
    if isinstance(distinct[0], str):
        # Strings have no percentiles: a uniform hash sample of bounded size stands in.
        sample = values.groupBy("v").agg(F.count("*").alias("n")).orderBy(F.xxhash64("v")).limit(EXACT).collect()
        return sorted(r.v for r in sample)
    points = [i / EXACT for i in range(1, EXACT)]
    return sorted(set(values.agg(F.percentile_approx("v", points, 20_000)).first()[0]))


def interleaved(ranks: Sequence[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Big-endian keys: bit b of the first column is above bit b of the second, and so on."""
    n, dims = len(ranks[0]), len(ranks)
    out = np.zeros((n, bits * dims), np.uint8)
    for d, r in enumerate(ranks):
        for b in range(bits):
            out[:, b * dims + d] = (r >> np.uint64(bits - 1 - b)) & np.uint64(1)
    return np.packbits(out, axis=1)


def scaled(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Ranks among the edges, spread over 32 bits."""
    rank = np.maximum(np.searchsorted(edges, values, side="right") - 1, 0).astype(np.uint64)
    return rank * np.uint64(0xFFFFFFFF) // np.uint64(max(1, len(edges) - 1))


def z_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """A binary column that sorts rows along the Z curve; nulls have the lowest rank."""
    edges = df.sparkSession.sparkContext.broadcast([np.array(boundaries(df, c)) for c in columns])

    def keys(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in parts:
            arrays = (arrays,) if isinstance(arrays, pa.Array) else arrays  # a single column comes by itself
            ranks = []
            for a, e in zip(arrays, edges.value, strict=True):
                valid = np.asarray(a.is_valid())
                r = np.zeros(len(a), np.uint64)
                if len(e) and valid.any():
                    held = a.filter(pa.array(valid))
                    r[valid] = scaled(np.array(held.to_pylist()) if e.dtype.kind == "U" else held.to_numpy(zero_copy_only=False), e)
                ranks.append(r)
            packed = interleaved(ranks)
            kind = pa.binary(packed.shape[1])
            yield pa.Array.from_buffers(kind, len(packed), [None, pa.py_buffer(np.ascontiguousarray(packed))]).cast(pa.binary())

    return F.arrow_udf(keys, "binary")(*[_orderable(S.name(c), df.schema[c].dataType) for c in columns])


def z_sorted(df: DataFrame, columns: Sequence[str], parts: int) -> DataFrame:
    """df in `parts` partitions along the Z curve, whose boundaries come from a sample."""
    z = "_lakewright_z"
    return df.withColumn(z, z_key(df, columns)).repartitionByRange(parts, z).sortWithinPartitions(z).drop(z)
