"""Writing rows to new data files, with statistics; nothing here touches the log."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import schema as S
from ..plans.actions import AddFile, ColumnStats, FileStats
from .storage import Storage

_SHADOW = "_p_"
STATS_COLUMNS = 64
_LONGEST = 256  # characters or bytes of a bound


def _bounds(field: T.StructField) -> list[Column]:
    c = S.name(field.name)
    nulls = F.count_if(c.isNull())
    if not isinstance(field.dataType, S.ORDERED):
        return [F.lit(None), F.lit(None), nulls]
    if isinstance(field.dataType, T.TimestampType):
        c = F.unix_micros(c)
    return [F.min(c), F.max(c), nulls]


def _column_stats(low, high, nulls: int) -> ColumnStats:
    """Bounds that are safe to compare with: NaN is above everything, long values are cut below and unknown above."""
    if isinstance(low, (bytearray, str)):
        low, high = (bytes(x) if isinstance(x, bytearray) else x for x in (low, high))
        low, high = low[:_LONGEST], high if len(high) <= _LONGEST else None
    elif isinstance(low, float):
        low, high = None if math.isnan(low) else low, None if math.isnan(high) else high
    return ColumnStats(low, high, nulls)


def stage(spark: SparkSession, storage: Storage, df: DataFrame, schema: T.StructType, partition_columns: Sequence[str] = (), data_change: bool = True, rows_per_file: int = 0, spread: bool = True) -> list[AddFile]:
    """Writes df (already in the schema) to files that no commit names yet.

    Partition columns stay in the files; directories are named by copies of them. spread: rows of a partition are brought
    together first, in as many tasks as their size asks for, so that a partition does not get a file from every task.
    """
    directory = f"data/{uuid.uuid4().hex}"
    shadows = [f"{_SHADOW}{c}" for c in partition_columns]
    out = df.withColumns({s: S.name(c).cast("string") for s, c in zip(shadows, partition_columns, strict=True)}) if shadows else df
    if shadows and spread:
        out = out.hint("rebalance", *[S.name(s) for s in shadows])
    writer = out.write
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if shadows:
        writer = writer.partitionBy(*shadows)
    try:
        writer.parquet(storage.uri(directory))
        found = {f.key: f for f in storage.files(directory) if f.key.endswith(".parquet")}
        if not found:
            return []
        return _described(spark, storage, directory, found, schema, partition_columns, data_change)
    except Exception:
        storage.delete(directory)
        raise


def _described(spark, storage, directory, found, schema, partition_columns, data_change) -> list[AddFile]:
    """One aggregation over the new files gives rows, bounds and null counts of each."""
    fields = list(schema)[:STATS_COLUMNS]
    fields += [f for f in schema if f.name in partition_columns and f not in fields]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        low, high, nulls = _bounds(f)
        aggregates += [low.alias(f"l{i}"), high.alias(f"h{i}"), nulls.alias(f"n{i}")]
    plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    rows = spark.read.schema(plain).option("recursiveFileLookup", "true").parquet(storage.uri(directory)).groupBy(F.col("_metadata.file_path").alias("file")).agg(*aggregates).collect()
    out = []
    for r in sorted(rows, key=lambda r: r.file):
        status = found[storage.key_of(r.file)]
        columns = {f.name: _column_stats(r[f"l{i}"], r[f"h{i}"], r[f"n{i}"]) for i, f in enumerate(fields)}
        partition = {c: _partition_value(r[f"l{[f.name for f in fields].index(c)}"]) for c in partition_columns}
        out.append(AddFile(status.key, status.size, status.modified, data_change, S.key(schema), FileStats(r.rows, columns), partition))
    return out


def _partition_value(value):
    return bytes(value) if isinstance(value, bytearray) else value


def discard(storage: Storage, files: Sequence[AddFile]) -> None:
    """Removes staged files that were not committed."""
    for top in {"/".join(f.path.split("/")[:2]) for f in files}:
        storage.delete(top)
