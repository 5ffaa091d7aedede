"""Reading the files of a snapshot as one DataFrame."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import schema as S
from ..plans.actions import AddFile
from ..plans.log import Snapshot
from .storage import Storage

FILE = "_lakewright_file"


def schema_of(snapshot: Snapshot) -> T.StructType:
    return S.from_json(snapshot.metadata.schema)


def physical_schemas(snapshot: Snapshot) -> dict[str, T.StructType]:
    """Layouts of the snapshot's files, by schema_key."""
    current = schema_of(snapshot)
    return {k: S.from_json(v) for k, v in snapshot.metadata.schemas.items()} | {S.key(current): current}


def _directory(path: str) -> str:
    """The folder of the write that made a file."""
    return "/".join(path.split("/")[:2])


def paths_of(storage: Storage, snapshot: Snapshot, files: list[AddFile]) -> list[str]:
    """What Spark is to list: a write's whole folder where all its files are wanted, else single files.

    A folder holds the files of one commit. It is whole as long as the snapshot has no tombstone in it.
    """
    active, wanted = Counter(_directory(p) for p in snapshot.files), Counter(_directory(f.path) for f in files)
    broken = {_directory(p) for p in snapshot.tombstones}
    whole = {d for d, n in wanted.items() if n == active[d] and n > 1 and d not in broken}
    return [storage.uri(d) for d in whole] + [storage.uri(f.path) for f in files if _directory(f.path) not in whole]


def read_files(spark: SparkSession, storage: Storage, snapshot: Snapshot, files: Iterable[AddFile], with_path: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Rows of the files in the snapshot's schema; files of one layout are one scan, so pruning and pushdown reach Parquet."""
    target, physical = schema or schema_of(snapshot), physical_schemas(snapshot)
    groups: dict[str, list[AddFile]] = defaultdict(list)
    for f in files:
        groups[f.schema_key].append(f)
    parts = []
    for key, group in groups.items():
        layout, paths = physical[key], paths_of(storage, snapshot, group)
        plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in layout])
        df = spark.read.schema(plain).option("recursiveFileLookup", "true").parquet(*paths)
        extra = [F.col("_metadata.file_path").alias(FILE)] if with_path else []
        parts.append(df.select(*S.projection(layout, target), *extra))
    if not parts:
        empty = spark.createDataFrame([], target)
        return empty.withColumn(FILE, F.lit("")) if with_path else empty
    return reduce(DataFrame.unionAll, parts)
