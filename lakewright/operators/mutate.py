"""Delete, upsert and merge: copy on write of the files that hold a changed row."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConflictError, SchemaError
from ..functions import schema as S
from ..plans import pruning
from ..plans.actions import AddFile, RemoveFile
from ..plans.transaction import ATTEMPTS, OptimisticTransaction, backoff
from ..sources import scan, writer

if TYPE_CHECKING:
    from ..table import VersionedTable

KEYS_HELD = 10_000  # source keys that the driver may hold for pruning; beyond that their least and greatest


def _column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def _touched(df: DataFrame, condition: Column) -> list[str]:
    return [r[0] for r in df.where(condition).select(scan.FILE).distinct().collect()]


def _removes(table: VersionedTable, current: int, files: list[AddFile], data_change: bool = True) -> list[RemoveFile]:
    now = table._now(current)
    return [RemoveFile(f.path, now, data_change) for f in files]


def delete(table: VersionedTable, predicate: Column | str, where: pruning.Ranges | None, user_metadata: str | None) -> int:
    for attempt in range(ATTEMPTS):
        base = table.snapshot()
        table.require_protocol(base)
        candidates = table.candidates(where, base.version) if where else list(base.files.values())
        if not candidates:
            return base.version
        doomed = F.coalesce(_column(predicate), F.lit(False))
        if where:
            doomed = doomed & F.coalesce(pruning.condition(where), F.lit(False))
        rows = scan.read_files(table.spark, table.storage, base, candidates, with_path=True)
        hit = {table.storage.key_of(p) for p in _touched(rows, doomed)}
        if not hit:
            return base.version
        files = [f for f in candidates if f.path in hit]
        schema = scan.schema_of(base)
        left = scan.read_files(table.spark, table.storage, base, files).where(~doomed)
        staged = writer.stage(table.spark, table.storage, left, schema, base.metadata.partition_columns)
        # Rows that others add meanwhile stay, as if they came after the delete.
        txn = OptimisticTransaction(table.log, base).read_paths(f.path for f in candidates).fail_on_metadata_changes()
        info = table.info(table.version, "DELETE", {"files": len(files)}, user_metadata)
        version = txn.commit([info, *_removes(table, base.version, files), *staged])
        if version is not None:
            return table.after_commit(version)
        writer.discard(table.storage, staged)
        backoff(attempt)
    raise ConflictError("files of this delete were changed by others each time")


@dataclass(frozen=True)
class _Clause:
    action: str
    condition: Column | str | None = None
    values: Mapping[str, Column | str] | None = None


@dataclass(frozen=True)
class MergeSpec:
    """Ordered clauses. Conditions and values are Columns or SQL over `t` (target row) and `s` (source row).

    The first matched clause whose condition is true decides; a matched row that all decline is kept, and its source row is
    not inserted. An update without values replaces the whole row by the source's: columns that the source lacks become
    their default or null. An update with values changes only those. Expressions must be deterministic.
    """

    matched: tuple[_Clause, ...] = field(default=())
    unmatched: tuple[_Clause, ...] = field(default=())

    def when_matched_update(self, values: Mapping[str, Column | str] | None = None, condition: Column | str | None = None) -> MergeSpec:
        return MergeSpec((*self.matched, _Clause("update", condition, values)), self.unmatched)

    def when_matched_delete(self, condition: Column | str | None = None) -> MergeSpec:
        return MergeSpec((*self.matched, _Clause("delete", condition)), self.unmatched)

    def when_not_matched_insert(self, values: Mapping[str, Column | str] | None = None, condition: Column | str | None = None) -> MergeSpec:
        return MergeSpec(self.matched, (*self.unmatched, _Clause("insert", condition, values)))


UPSERT = MergeSpec().when_matched_update().when_not_matched_insert()


def upsert(table: VersionedTable, source: DataFrame, key: str, user_metadata: str | None) -> int:
    return merge(table, source, key, UPSERT, user_metadata)


def _checked_source(source: DataFrame, key: str) -> int:
    """Rows of the source, whose keys must be unique and not null."""
    k = S.name(key)
    counts = source.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.max(F.col("k").isNull()).alias("null")).first()
    if counts.null:
        raise ValueError(f"null in the source's key {key}")
    if (counts.most or 0) > 1:
        raise ValueError(f"repeated values in the source's key {key}")
    return counts.rows or 0


def _code(clauses: tuple[_Clause, ...]) -> Column:
    """The position of the clause that decides, or null."""
    out = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(clauses))):
        holds = F.lit(True) if c.condition is None else F.coalesce(_column(c.condition), F.lit(False))
        out = F.when(holds, F.lit(i)).otherwise(out)
    return out


def _whole(source: T.StructType, f: T.StructField) -> Column:
    if f.name in source.names:
        if not S.widens(source[f.name].dataType, f.dataType) and not isinstance(source[f.name].dataType, T.NullType):
            raise SchemaError(f"{f.name}: {source[f.name].dataType.simpleString()} does not fit {f.dataType.simpleString()}")
        return F.col(f"s.`{f.name}`").cast(f.dataType)
    if not f.nullable and not S.has_default(f):
        raise SchemaError(f"required column {f.name} is missing from the source")
    return S.literal(f)


def _values(clause: _Clause, source: T.StructType, schema: T.StructType) -> list[Column]:
    """What the clause gives each column of the table."""
    if clause.values is None:
        if unknown := [c for c in source.names if c not in schema.names]:
            raise SchemaError(f"columns that the table does not have: {unknown}")
        return [_whole(source, f) for f in schema]
    if unknown := [c for c in clause.values if c not in schema.names]:
        raise SchemaError(f"columns that the table does not have: {unknown}")
    out = []
    for f in schema:
        if f.name in clause.values:
            out.append(_column(clause.values[f.name]).cast(f.dataType))
        else:
            out.append(F.col(f"t.`{f.name}`") if clause.action == "update" else S.literal(f))
    return out


def _chosen(clauses: tuple[_Clause, ...], source: T.StructType, schema: T.StructType, code: Column, kept: bool) -> list[Column]:
    """Each column of the table by the deciding clause."""
    given = {i: _values(c, source, schema) for i, c in enumerate(clauses) if c.action != "delete"}
    out = []
    for n, f in enumerate(schema):
        value = F.col(f"t.`{f.name}`") if kept else F.lit(None).cast(f.dataType)
        for i in reversed(given):
            value = F.when(code == i, given[i][n]).otherwise(value)
        if not f.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"null in required column {f.name}")).cast(f.dataType))
        out.append(value.alias(f.name))
    return out


def merge(table: VersionedTable, source: DataFrame, key: str, spec: MergeSpec, user_metadata: str | None) -> int:
    if not spec.matched and not spec.unmatched:
        raise ValueError("a merge needs a clause")
    if key not in source.columns:
        raise SchemaError(f"the source has no column {key}")
    with _written(table, source) as source:
        return _merged(table, source, key, spec, user_metadata)


@contextmanager
def _written(table: VersionedTable, df: DataFrame) -> Iterator[DataFrame]:
    """df, worked out once: written beside the table's data for as long as the block runs."""
    folder = f"_work/{uuid.uuid4().hex}"
    empty = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]  # which files cannot hold
    held = df.drop(*empty).withColumn("_lakewright_row", F.lit(True)) if empty else df
    try:
        held.write.parquet(table.storage.uri(folder))
        back = table.spark.read.schema(held.schema).parquet(table.storage.uri(folder))
        yield back.select(*[F.lit(None).alias(c) if c in empty else S.name(c) for c in df.columns])
    finally:
        table.storage.delete(folder)


def _merged(table: VersionedTable, source: DataFrame, key: str, spec: MergeSpec, user_metadata: str | None) -> int:
    count = _checked_source(source, key)
    if not table.exists():
        return _insert_all(table, source, spec, user_metadata)
    for attempt in range(ATTEMPTS):
        base = table.snapshot()
        table.require_protocol(base)
        schema = scan.schema_of(base)
        if key not in schema.names:
            raise SchemaError(f"the table has no column {key}")
        match = _matcher(source, key, schema, count)
        layouts = scan.physical_schemas(base)
        candidates = [f for f in base.files.values() if match(f, layouts[f.schema_key])]
        staged, files = _rewritten(table, base, schema, candidates, source, key, spec)
        if not staged and not files:
            return base.version
        txn = OptimisticTransaction(table.log, base).read_paths(f.path for f in candidates)
        txn.fail_on_metadata_changes().fail_if_new_file_matches(lambda f: match(f, layouts.get(f.schema_key, schema)))  # noqa: B023 used before the next turn
        numbers = {"matched clauses": len(spec.matched), "not matched clauses": len(spec.unmatched), "files": len(files)}
        info = table.info(table.version, "MERGE", numbers, user_metadata)
        version = txn.commit([info, *_removes(table, base.version, files), *staged])
        if version is not None:
            return table.after_commit(version)
        writer.discard(table.storage, staged)
        backoff(attempt)
    raise ConflictError("files of this merge were changed by others each time")


def _matcher(source: DataFrame, key: str, schema: T.StructType, count: int):
    """Whether a file may hold a source key. Few keys are compared one by one, many by their least and greatest."""
    kind = schema[key].dataType
    if not isinstance(kind, S.ORDERED) or isinstance(kind, T.TimestampType):
        return lambda f, physical: True
    k = S.name(key).cast(kind)
    plain = lambda x: bytes(x) if isinstance(x, bytearray) else x
    if count <= KEYS_HELD:
        keys = sorted(plain(r[0]) for r in source.select(k).collect() if r[0] is not None and r[0] == r[0])
        return lambda f, physical: pruning.may_hold_any(f, key, keys, True, schema, physical)
    low, high = (plain(x) for x in source.agg(F.min(k), F.max(k)).first())
    if high != high:
        return lambda f, physical: True
    return lambda f, physical: pruning.may_hold_any(f, key, (low, high), False, schema, physical)


def _insert_all(table: VersionedTable, source: DataFrame, spec: MergeSpec, user_metadata: str | None) -> int:
    """A merge into a table that does not exist yet inserts, if it may."""
    if not spec.unmatched:
        return -1
    rows = source.alias("s").withColumn("_code", _code(spec.unmatched)).where("_code is not null")
    if all(c.values is None for c in spec.unmatched):
        return table.append(rows.drop("_code"), user_metadata=user_metadata)
    if any(c.values is None or set(c.values) != set(spec.unmatched[0].values) for c in spec.unmatched):
        raise SchemaError("inserts into a new table must give the same columns")
    names = list(spec.unmatched[0].values)
    given = [reduce(lambda rest, ic: F.when(F.col("_code") == ic[0], _column(ic[1].values[n])).otherwise(rest), reversed(list(enumerate(spec.unmatched))), F.lit(None)).alias(n) for n in names]  # noqa: B023
    return table.append(rows.select(*given), user_metadata=user_metadata)


def _rewritten(table: VersionedTable, base, schema: T.StructType, candidates: list[AddFile], source: DataFrame, key: str, spec: MergeSpec) -> tuple[list[AddFile], list[AddFile]]:
    """New files, and those that they replace."""
    spark, storage = table.spark, table.storage
    kind = schema[key].dataType
    s = source.withColumn("_source_key", S.name(key).cast(kind)).alias("s")
    same = F.col(f"t.`{key}`") == F.col("s._source_key")
    t = scan.read_files(spark, storage, base, candidates, with_path=True).alias("t")
    code = F.when(F.col("s._source_key").isNotNull(), _code(spec.matched))
    # One narrow join tells which files hold a row to change, and which source rows are not new.
    met = t.join(s, same, "inner").select(scan.FILE, F.col("s._source_key").alias("_met"), code.isNotNull().alias("_hit"))
    with _written(table, met) as met:
        hit = {storage.key_of(p) for p in _touched(met, F.col("_hit"))} if spec.matched and candidates else set()
        files = [f for f in candidates if f.path in hit]
        parts = []
        if files:
            t = scan.read_files(spark, storage, base, files).alias("t")
            both = t.join(s, same, "left").withColumn("_code", code)
            gone = [i for i, c in enumerate(spec.matched) if c.action == "delete"]
            if gone:
                both = both.where(F.coalesce(~F.col("_code").isin(gone), F.lit(True)))
            parts.append(both.select(*_chosen(spec.matched, source.schema, schema, F.col("_code"), kept=True)))
        if spec.unmatched:
            new = s.join(met, F.col("s._source_key") == F.col("_met"), "left_anti").alias("s").withColumn("_code", _code(spec.unmatched)).where("_code is not null")
            parts.append(new.select(*_chosen(spec.unmatched, source.schema, schema, F.col("_code"), kept=False)))
        if not parts:
            return [], []
        return writer.stage(spark, storage, reduce(DataFrame.unionAll, parts), schema, base.metadata.partition_columns), files
