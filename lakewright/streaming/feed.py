"""Changes of a table in the order of versions, and exactly-once writes from streams.

Only files added by changes of data are in the feed. Removed rows are never told, and rows that a delete or merge copied
to a new file come again: at least once for each row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.actions import AddFile
from ..sources import scan

if TYPE_CHECKING:
    from ..table import VersionedTable

VERSION = "_commit_version"


def incremental_files(table: VersionedTable, after: int) -> list[tuple[int, AddFile]]:
    """Files added by versions after `after` (-1: all)."""
    return [(v, a) for v, actions in table.log.tail(after, threads=8) for a in actions if isinstance(a, AddFile) and a.data_change]


def incremental(table: VersionedTable, after: int, until: int | None = None) -> DataFrame:
    """Rows of those files in the schema of the latest version (or `until`), with _commit_version."""
    snapshot = table.snapshot(until)
    found: dict[int, list[AddFile]] = {}
    for v, f in incremental_files(table, after):
        if v <= snapshot.version:
            found.setdefault(v, []).append(f)
    parts = []
    for v, files in found.items():
        # Older layouts may no longer be in the latest metadata: each version's own describes its files.
        own = table.snapshot(v)
        parts.append(scan.read_files(table.spark, table.storage, own, files, schema=scan.schema_of(snapshot)).withColumn(VERSION, F.lit(v).cast("long")))
    if not parts:
        return scan.read_files(table.spark, table.storage, snapshot, []).withColumn(VERSION, F.lit(None).cast("long"))
    return reduce(DataFrame.unionAll, parts)


class Consumer:
    """Polls a table; each poll gives what came since the last one. Its offset lives in memory."""

    def __init__(self, table: VersionedTable, after: int = -1):
        self.table, self.offset = table, after

    def poll_files(self) -> list[tuple[int, AddFile]]:
        latest = self.table.version
        if latest <= self.offset:
            return []
        out = [(v, f) for v, f in incremental_files(self.table, self.offset) if v <= latest]
        self.offset = latest
        return out

    def poll(self) -> DataFrame | None:
        """New rows, or None."""
        latest = self.table.version
        if latest <= self.offset:
            return None
        before, self.offset = self.offset, latest
        return incremental(self.table, before, latest)


def exactly_once(table: VersionedTable, app_id: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends every micro-batch once, however often the stream repeats it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            table.append(batch, app_id=app_id, txn_version=batch_id)

    return write
