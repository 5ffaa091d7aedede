"""A streaming source: each version of a table is an offset."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions import schema as S
from ..plans.actions import AddFile
from ..plans.log import LOG

NAME = "lakewright"


# Hadoop's names of stores, and Arrow's (fixed values).
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def opened(root: str):
    """Arrow's file system of a URI (None: a plain path), and the path within it: sources run in Python processes without a
    session."""
    scheme, there, rest = root.partition("://")
    if not there:
        return None, root
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


class _Log:
    """The log as files that Python opens."""

    def __init__(self, root: str):
        self.fs, self.path = opened(root)

    def _names(self) -> list[str]:
        if self.fs is None:
            import os

            return os.listdir(f"{self.path}/{LOG}")
        from pyarrow import fs

        return [i.base_name for i in self.fs.get_file_info(fs.FileSelector(f"{self.path}/{LOG}"))]

    def open(self, key: str):
        return open(f"{self.path}/{key}", "rb") if self.fs is None else self.fs.open_input_file(f"{self.path}/{key}")  # noqa: SIM115 closed by readers

    def latest(self) -> int:
        names = self._names()
        return max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=-1)

    def added(self, after: int, until: int) -> list[tuple[int, AddFile]]:
        from ..plans.actions import decode_all

        out = []
        for v in range(after + 1, until + 1):
            with self.open(f"{LOG}/{v:020d}.json") as f:
                out += [(v, a) for a in decode_all(f.read()) if isinstance(a, AddFile) and a.data_change]
        return out


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class VersionReader(DataSourceStreamReader):
    def __init__(self, path: str, schema, after: int):
        self.path, self.schema, self.after = path, schema, after

    def initialOffset(self) -> dict:
        return {"version": self.after}

    def latestOffset(self) -> dict:
        return {"version": _Log(self.path).latest()}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(a.path) for _, a in _Log(self.path).added(start["version"], end["version"])]

    def read(self, partition: _File) -> Iterator:
        """Batches of a file, its columns by name or alias; what it lacks is the column's default or null."""
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        with _Log(self.path).open(partition.path) as held:
            for batch in pq.ParquetFile(held).iter_batches():
                columns = []
                for f, kind in zip(self.schema, target.types, strict=True):
                    name = S.source_of(f, batch.schema.names)
                    if name:
                        columns.append(batch.column(name).cast(kind))
                    else:
                        columns.append(pa.array([S.default(f)] * batch.num_rows, kind))
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    def commit(self, end: dict) -> None:
        pass


class VersionSource(DataSource):
    """spark.readStream.format("lakewright"): options path (or URI), after, schema (JSON)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return S.from_json(self.options["schema"])

    def streamReader(self, schema) -> VersionReader:
        return VersionReader(self.options["path"], self.schema(), int(self.options.get("after", -1)))


def read_stream(spark: SparkSession, table, after: int = -1) -> DataFrame:
    """Rows that versions after `after` add, as a stream. Executors open the table's path or URI through Arrow."""
    path = table.storage.local or table.storage.root
    try:
        opened(path)
    except Exception as e:
        raise ValueError(f"Arrow has no file system for {path}; poll table.consumer() instead") from e
    from ..sources.scan import schema_of

    snapshot = table.snapshot()
    spark.dataSource.register(VersionSource)
    options = {"path": path, "after": str(after), "schema": snapshot.metadata.schema}
    return spark.readStream.format(NAME).options(**options).schema(schema_of(snapshot)).load()
