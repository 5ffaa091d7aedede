"""Typed rows of three columns (id, name, age) over a versioned table, for small data that lives in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.schema import column
from .operators.mutate import MergeSpec
from .plans.pruning import Ranges
from .table import T, VersionedTable


@dataclass(frozen=True)
class Record:
    id: int
    name: str
    age: int

    def __post_init__(self):
        if not self.name or not self.name.strip():
            raise ValueError("name must not be blank")
        if self.age < 0:
            raise ValueError("age must not be negative")


SCHEMA = T.StructType([column("id", "long", nullable=False), column("name", "string", nullable=False), column("age", "int", nullable=False)])


class RecordTable:
    """Records in, records out; whatever is read here comes to the driver."""

    def __init__(self, table: VersionedTable):
        self.table = table

    def _df(self, records: Iterable[Record]) -> DataFrame:
        return self.table.spark.createDataFrame([astuple(r) for r in records], SCHEMA)

    def _records(self, df: DataFrame) -> list[Record]:
        if missing := [c for c in SCHEMA.names if c not in df.columns]:
            raise TypeError(f"the table has no columns {missing}")
        return [Record(*r) for r in df.select(*SCHEMA.names).collect()]

    def append(self, records: Iterable[Record], app_id: str | None = None, txn_version: int | None = None) -> int:
        return self.table.append(self._df(records), app_id, txn_version, schema=SCHEMA)

    def read_all(self) -> list[Record]:
        return self._records(self.table.read())

    def read(self, version: int) -> list[Record]:
        return self._records(self.table.read(version))

    def query(self, wanted: Ranges | Column | str | Callable[[Record], bool]) -> list[Record]:
        """Records within ranges, of a condition, or that a Python function accepts (which reads all)."""
        if isinstance(wanted, (Column, str)):
            return self._records(self.table.read(filter=wanted))
        if callable(wanted):
            return [r for r in self.read_all() if wanted(r)]
        return self._records(self.table.read(where=wanted))

    def query_id_range(self, low: int, high: int) -> list[Record]:
        return self.query({"id": (low, high)})

    def delete(self, predicate: Column | str) -> int:
        return self.table.delete(predicate)

    def upsert(self, records: Iterable[Record]) -> int:
        return self.table.upsert(self._df(records), "id") if self.table.exists() else self.append(records)

    def merge(self, records: Iterable[Record], spec: MergeSpec | None = None) -> int:
        return self.table.merge(self._df(records), "id", spec)

    def count(self) -> int:
        return self.table.read().select(F.count(F.lit(1))).first()[0]
