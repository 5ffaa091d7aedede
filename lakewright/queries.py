"""One query for each operator of versioned tables, and the same in SQL over the plain tables.

Every query builds its own table from whole inputs in a folder that all executors share, works on it, and returns rows.
"""

from __future__ import annotations

import atexit
import datetime as dt
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ProtocolError, SchemaError
from .functions.schema import column
from .operators.mutate import MergeSpec
from .plans.actions import AddFile, RemoveFile
from .records import SCHEMA as RECORDS
from .records import Record, RecordTable
from .streaming.source import read_stream
from .table import VersionedTable

_own: list[str] = []
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir; in a temporary folder where that is unset in local mode (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="lakewright-tables-"))
            atexit.register(shutil.rmtree, _own[0][7:], ignore_errors=True)
        base = _own[0]
    path = f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).deleteOnExit(p)
    return path


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new(spark: SparkSession, *appends: DataFrame, **options) -> VersionedTable:
    table = VersionedTable(spark, workspace(spark), **options)
    for df in appends:
        table.append(df)
    return table


def halves(df: DataFrame, key: str, n: int = 2) -> list[DataFrame]:
    return [df.where(F.col(key) % n == i) for i in range(n)]


ALL_ORDERS = "SELECT * FROM orders"


@query(ALL_ORDERS)
def scan_current(spark, sf_dir):
    return new(spark, *halves(source(spark, sf_dir, "orders"), "o_orderkey")).read()


@query(ALL_ORDERS)
def append_basic(spark, sf_dir):
    return new(spark, *halves(source(spark, sf_dir, "orders"), "o_orderkey", 3)).read()


@query(ALL_ORDERS)
def append_parallel(spark, sf_dir):
    table = VersionedTable(spark, workspace(spark))
    table.append_parallel(halves(source(spark, sf_dir, "orders"), "o_orderkey", 8), threads=4)
    return table.read()


@query(ALL_ORDERS)
def append_idempotent(spark, sf_dir):
    table = VersionedTable(spark, workspace(spark))
    one, two = halves(source(spark, sf_dir, "orders"), "o_orderkey")
    table.append(one, app_id="loader", txn_version=1)
    table.append(two, app_id="loader", txn_version=1)
    table.append(two, app_id="loader", txn_version=2)
    table.append(one, app_id="loader", txn_version=2)
    return table.read()


@query("SELECT * FROM orders WHERE o_orderstatus BETWEEN 'F' AND 'F'")
def partitioned_write(spark, sf_dir):
    table = new(spark, source(spark, sf_dir, "orders"), partition_columns=["o_orderstatus"])
    return table.read(where={"o_orderstatus": ("F", "F")})


@query("SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderpriority <> '1-URGENT'")
def filter_predicate(spark, sf_dir):
    table = new(spark, source(spark, sf_dir, "orders"))
    return table.read(filter="o_totalprice > 100000 AND o_orderpriority <> '1-URGENT'")


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def filter_range(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    table = new(spark, orders.where("o_orderkey < 500"), orders.where("o_orderkey >= 500"))
    return table.read(where={"o_orderkey": (100, 900)})


@query("SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND l_returnflag BETWEEN 'A' AND 'N'")
def filter_range_multi(spark, sf_dir):
    table = new(spark, source(spark, sf_dir, "lineitem"), partition_columns=["l_returnflag"])
    return table.read(where={"l_quantity": (10, 20), "l_shipdate": (dt.datetime(1995, 1, 1), dt.datetime(1996, 12, 31)), "l_returnflag": ("A", "N")})


@query("SELECT o_orderkey, o_totalprice FROM orders")
def projection(spark, sf_dir):
    return new(spark, source(spark, sf_dir, "orders")).read().select("o_orderkey", "o_totalprice")


@query("SELECT * FROM orders WHERE o_orderkey % 3 = 0")
def time_travel_version(spark, sf_dir):
    return new(spark, *halves(source(spark, sf_dir, "orders"), "o_orderkey", 3)).read(version=0)


@query("SELECT * FROM orders WHERE o_orderkey % 3 <> 2")
def time_travel_timestamp(spark, sf_dir):
    first, second, third = halves(source(spark, sf_dir, "orders"), "o_orderkey", 3)
    table = new(spark, first, second)
    at = table.log.history()[0][1].timestamp
    while table._now(1) <= at:
        pass
    table.append(third)
    return table.read(timestamp=at)


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 1")
def version_diff(spark, sf_dir):
    table = new(spark, *halves(source(spark, sf_dir, "orders"), "o_orderkey"))
    return table.read(version=1).exceptAll(table.read(version=0))


@query("SELECT * FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)")
def delete_where(spark, sf_dir):
    table = new(spark, *halves(source(spark, sf_dir, "orders"), "o_orderkey"))
    table.delete("o_orderstatus = 'F'")
    return table.read()


@query("SELECT * FROM orders WHERE NOT (o_orderkey BETWEEN 200 AND 700 AND o_orderstatus = 'O')")
def delete_range(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    table = new(spark, orders.where("o_orderkey < 500"), orders.where("o_orderkey >= 500"))
    table.delete(F.col("o_orderstatus") == "O", where={"o_orderkey": (200, 700)})
    return table.read()


_CHANGES = "SELECT o_orderkey + 500 AS o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0"


def _changes(orders: DataFrame) -> DataFrame:
    even = orders.where("o_orderkey % 2 = 0")
    return even.withColumns({"o_orderkey": F.col("o_orderkey") + 500, "o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") * 2})


@query(f"WITH s AS ({_CHANGES}) SELECT * FROM s UNION ALL SELECT o.* FROM orders o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = o.o_orderkey)")
def upsert(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    table = new(spark, *halves(orders, "o_custkey"))
    table.upsert(_changes(orders), "o_orderkey")
    return table.read()


@query(f"WITH s AS ({_CHANGES}) SELECT coalesce(o.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN o.o_custkey WHEN o.o_orderkey IS NULL THEN s.o_custkey ELSE o.o_custkey END AS o_custkey, CASE WHEN o.o_orderkey IS NULL THEN 'N' ELSE o.o_orderstatus END AS o_orderstatus, CASE WHEN s.o_orderkey IS NULL THEN o.o_totalprice WHEN o.o_orderkey IS NULL THEN s.o_totalprice ELSE o.o_totalprice + s.o_totalprice END AS o_totalprice, CASE WHEN o.o_orderkey IS NULL THEN NULL ELSE o.o_orderdate END AS o_orderdate, CASE WHEN o.o_orderkey IS NULL THEN s.o_orderpriority ELSE o.o_orderpriority END AS o_orderpriority FROM orders o FULL JOIN s ON o.o_orderkey = s.o_orderkey")
def merge_update_insert(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    table = new(spark, *halves(orders, "o_custkey"))
    spec = MergeSpec().when_matched_update({"o_totalprice": "t.o_totalprice + s.o_totalprice"})
    spec = spec.when_not_matched_insert({"o_orderkey": "s.o_orderkey", "o_custkey": "s.o_custkey", "o_orderstatus": F.lit("N"), "o_totalprice": "s.o_totalprice", "o_orderpriority": "s.o_orderpriority"})
    table.merge(_changes(orders), "o_orderkey", spec)
    return table.read()


@query(
    f"WITH s AS ({_CHANGES}), j AS (SELECT o.o_orderkey AS tk, s.o_orderkey AS sk, o.*, s.o_custkey AS sc, s.o_orderstatus AS ss, s.o_totalprice AS sp, s.o_orderdate AS sd, s.o_orderpriority AS sq FROM orders o FULL JOIN s ON o.o_orderkey = s.o_orderkey) "
    "SELECT coalesce(tk, sk) AS o_orderkey, CASE WHEN tk IS NULL OR (sk IS NOT NULL AND o_totalprice < 150000 AND o_orderstatus <> 'F') THEN sc ELSE o_custkey END AS o_custkey, CASE WHEN tk IS NULL OR (sk IS NOT NULL AND o_totalprice < 150000 AND o_orderstatus <> 'F') THEN ss ELSE o_orderstatus END AS o_orderstatus, "
    "CASE WHEN tk IS NULL OR (sk IS NOT NULL AND o_totalprice < 150000 AND o_orderstatus <> 'F') THEN sp ELSE o_totalprice END AS o_totalprice, CASE WHEN tk IS NULL OR (sk IS NOT NULL AND o_totalprice < 150000 AND o_orderstatus <> 'F') THEN sd ELSE o_orderdate END AS o_orderdate, CASE WHEN tk IS NULL OR (sk IS NOT NULL AND o_totalprice < 150000 AND o_orderstatus <> 'F') THEN sq ELSE o_orderpriority END AS o_orderpriority "
    "FROM j WHERE NOT (tk IS NOT NULL AND sk IS NOT NULL AND o_orderstatus = 'F') AND NOT (tk IS NULL AND NOT coalesce(sp > 100000, false))"
)
def merge_conditional(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    table = new(spark, *halves(orders, "o_custkey"))
    spec = MergeSpec().when_matched_delete("t.o_orderstatus = 'F'").when_matched_update(condition="t.o_totalprice < 150000")
    table.merge(_changes(orders), "o_orderkey", spec.when_not_matched_insert(condition="s.o_totalprice > 100000"))
    return table.read()


@query(f"WITH s AS ({_CHANGES}) SELECT o.* FROM orders o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = o.o_orderkey)")
def merge_delete(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    table = new(spark, *halves(orders, "o_custkey"))
    table.merge(_changes(orders), "o_orderkey", MergeSpec().when_matched_delete())
    return table.read()


@query("SELECT * FROM lineitem")
def optimize_compact(spark, sf_dir):
    table = new(spark, *halves(source(spark, sf_dir, "lineitem"), "l_orderkey", 4), partition_columns=["l_returnflag"])
    table.optimize()
    return table.read()


@query(ALL_ORDERS)
def auto_optimize(spark, sf_dir):
    first, *rest = halves(source(spark, sf_dir, "orders"), "o_orderkey", 4)
    table = new(spark, first)
    table.set_auto_optimize(True)
    for df in rest:
        table.append(df)
    return table.read()


@query("SELECT * FROM lineitem")
def zorder_preserves_rows(spark, sf_dir):
    table = new(spark, *halves(source(spark, sf_dir, "lineitem"), "l_orderkey", 4))
    table.optimize_z_order("l_partkey", "l_shipdate", "l_returnflag")
    return table.read()


@query("SELECT * FROM orders")
def zorder_scoped(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    table = new(spark, orders.where("o_orderkey < 400"), orders.where("o_orderkey BETWEEN 400 AND 799"), orders.where("o_orderkey >= 800"))
    table.optimize_z_order("o_custkey", "o_totalprice", where={"o_orderkey": (100, 500)})
    return table.read()


@query("SELECT * FROM orders WHERE o_orderstatus <> 'P'")
def checkpoint_equivalence(spark, sf_dir):
    table = new(spark, *halves(source(spark, sf_dir, "orders"), "o_orderkey", 4), checkpoint_interval=2)
    table.delete("o_orderstatus = 'P'")
    table.checkpoint()
    return VersionedTable(spark, table.storage.root).read()


@query("SELECT * FROM orders WHERE o_orderstatus <> 'P'")
def vacuum_keeps_current(spark, sf_dir):
    table = new(spark, *halves(source(spark, sf_dir, "orders"), "o_orderkey", 4))
    table.delete("o_orderstatus = 'P'")
    table.optimize()
    table.vacuum(dt.timedelta(0))
    return table.read()


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0")
def rollback(spark, sf_dir):
    table = new(spark, *halves(source(spark, sf_dir, "orders"), "o_orderkey"))
    table.delete("o_orderstatus = 'F'")
    table.rollback(0)
    return table.read()


def _fields(df: DataFrame) -> dict[str, T.StructField]:
    return {f.name: f for f in df.schema}


@query("SELECT *, CAST(NULL AS VARCHAR) AS o_note, 7 AS o_level FROM orders")
def evolve_add_column(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    table = new(spark, orders)
    table.evolve_schema(T.StructType([*orders.schema, column("o_note", "string"), column("o_level", "int", default=7)]))
    return table.read()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS o_amount, o_orderdate, o_orderpriority FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000")
def evolve_rename(spark, sf_dir):
    first, second = halves(source(spark, sf_dir, "orders"), "o_orderkey")
    table = new(spark, first)
    table.evolve_schema(T.StructType([column("o_amount", "double", aliases=["o_totalprice"]) if f.name == "o_totalprice" else f for f in first.schema]))
    table.append(second.withColumnRenamed("o_totalprice", "o_amount"))
    return table.read(where={"o_amount": (1000, 200000)})


@query("SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def evolve_widen(spark, sf_dir):
    first, second = halves(source(spark, sf_dir, "part"), "p_partkey")
    table = new(spark, first)
    table.evolve_schema(T.StructType([column("p_size", "long") if f.name == "p_size" else f for f in first.schema]))
    table.append(second)
    return table.read()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def evolve_drop(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    table = new(spark, *halves(orders, "o_orderkey"))
    table.evolve_schema(T.StructType([f for f in orders.schema if f.name != "o_orderpriority"]))
    return table.read()


@query("SELECT *, CAST(1 AS BIGINT) AS _commit_version FROM orders WHERE o_orderkey % 2 = 1")
def incremental_append(spark, sf_dir):
    return new(spark, *halves(source(spark, sf_dir, "orders"), "o_orderkey")).incremental(after=0)


@query("SELECT *, CAST(1 AS BIGINT) AS _commit_version FROM orders WHERE o_orderkey % 2 = 1")
def incremental_skips_optimize(spark, sf_dir):
    table = new(spark, *halves(source(spark, sf_dir, "orders"), "o_orderkey"))
    table.optimize()
    table.optimize_z_order("o_custkey")
    return table.incremental(after=0)


@query("SELECT *, CAST(2 AS BIGINT) AS _commit_version FROM orders WHERE o_orderkey < 300 AND o_orderstatus <> 'F'")
def incremental_after_delete(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    table = new(spark, orders.where("o_orderkey < 300").coalesce(1), orders.where("o_orderkey >= 300").coalesce(1))
    table.delete("o_orderkey < 300 AND o_orderstatus = 'F'")
    return table.incremental(after=1)


@query("SELECT * FROM events")
def stream_available_now(spark, sf_dir):
    table = new(spark, *halves(source(spark, sf_dir, "events"), "event_id", 3))
    out = VersionedTable(spark, workspace(spark))
    stream = read_stream(spark, table).writeStream.foreachBatch(out.sink("copy")).option("checkpointLocation", workspace(spark)).trigger(availableNow=True).start()
    stream.awaitTermination()
    return out.read()


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'APPEND'), (1, 'APPEND'), (2, 'DELETE'), (3, 'OPTIMIZE'), (4, 'ROLLBACK')) AS h(version, operation)")
def history_ops(spark, sf_dir):
    table = new(spark, *halves(source(spark, sf_dir, "orders"), "o_orderkey"))
    table.delete("o_orderstatus = 'F'")
    table.optimize(1 << 16)
    table.rollback(1)
    return table.history().select("version", "operation")


@query("SELECT o_orderstatus AS status, count(*) AS rows, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) - count(o_orderdate) AS nulls FROM orders GROUP BY o_orderstatus")
def file_stats(spark, sf_dir):
    table = new(spark, source(spark, sf_dir, "orders"), partition_columns=["o_orderstatus"])
    table.optimize()
    s = table.file_stats()
    status = s.where("column = 'o_orderstatus'").select("path", F.col("min").alias("status"))
    key = s.where("column = 'o_orderkey'").select("path", "rows", F.col("min").cast("long").alias("low"), F.col("max").cast("long").alias("high"))
    date = s.where("column = 'o_orderdate'").select("path", "nulls")
    per_file = status.join(key, "path").join(date, "path")
    return per_file.groupBy("status").agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("nulls").alias("nulls"))


@query("SELECT count(*) AS files, CAST(sum(rows) AS BIGINT) AS rows FROM (SELECT o_orderkey % 4 AS k, count(*) AS rows FROM orders GROUP BY 1)")
def snapshot_files(spark, sf_dir):
    table = new(spark, *[d.coalesce(1) for d in halves(source(spark, sf_dir, "orders"), "o_orderkey", 4)])
    return table.snapshot().files_df(spark).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


def _raises(error: type[Exception], call: Callable) -> bool:
    try:
        call()
    except error:
        return True
    return False


@query("SELECT o.* FROM orders o WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1997-06-30' AND o_orderpriority BETWEEN '2' AND '4' AND o_totalprice BETWEEN 500.5 AND 250000")
def filter_range_types(spark, sf_dir):
    table = new(spark, *halves(source(spark, sf_dir, "orders"), "o_orderkey"))
    return table.read(where={"o_orderdate": (dt.datetime(1994, 1, 1), dt.datetime(1997, 6, 30)), "o_orderpriority": ("2", "4"), "o_totalprice": (500.5, 250000)})


@query("SELECT count(*) AS rows, true AS all_files_before, true AS fewer_after FROM lineitem WHERE l_partkey BETWEEN 5 AND 20")
def zorder_prunes(spark, sf_dir):
    table = new(spark, *[d.coalesce(1) for d in halves(source(spark, sf_dir, "lineitem"), "l_orderkey", 8)])
    wanted = {"l_partkey": (5, 20)}
    before = len(table.candidates(wanted)) == table.snapshot().file_count
    table.optimize_z_order("l_partkey", "l_shipdate")
    after = len(table.candidates(wanted)) < table.snapshot().file_count
    return table.read(where=wanted).agg(F.count("*").alias("rows"), F.lit(before).alias("all_files_before"), F.lit(after).alias("fewer_after"))


@query("SELECT * FROM orders")
def optimize_async(spark, sf_dir):
    table = new(spark, *halves(source(spark, sf_dir, "orders"), "o_orderkey", 4))
    table.optimize_async().join()
    return table.read(version=4)


@query("SELECT count(DISTINCT o_orderkey % 4) AS superseded, CAST(0 AS BIGINT) AS young, count(DISTINCT o_orderkey % 4) AS deleted, CAST(0 AS BIGINT) AS again, count(*) AS rows FROM orders")
def vacuum_deletes(spark, sf_dir):
    table = new(spark, *[d.coalesce(1) for d in halves(source(spark, sf_dir, "orders"), "o_orderkey", 4)])
    table.optimize()
    counts = {"superseded": len(table.snapshot().tombstones)}
    table.set_retention(dt.timedelta(days=1))
    counts["young"] = table.vacuum()
    table.set_retention(dt.timedelta(0))
    counts |= {"deleted": table.vacuum(), "again": table.vacuum()}
    return table.read().agg(F.count("*").alias("rows"), *[F.lit(n).cast("long").alias(c) for c, n in counts.items()])


@query(
    "SELECT threads, version, rows_added, files_removed FROM (SELECT CAST(0 AS BIGINT) AS version, count(*) AS rows_added, CAST(0 AS BIGINT) AS files_removed FROM orders WHERE o_orderkey % 2 = 0 "
    "UNION ALL SELECT 1, count(*), 0 FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 2, count(*), 2 FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)) CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (4)) AS t(threads)"
)
def tail_actions(spark, sf_dir):
    table = new(spark, *[d.coalesce(1) for d in halves(source(spark, sf_dir, "orders"), "o_orderkey")])
    table.delete("o_orderstatus = 'F'")
    rows = [(n, v, sum(a.stats.rows for a in actions if isinstance(a, AddFile)), sum(isinstance(a, RemoveFile) for a in actions)) for n in (1, 4) for v, actions in table.tail(-1, threads=n)]
    return spark.createDataFrame(rows, "threads long, version long, rows_added long, files_removed long")


@query("SELECT * FROM (VALUES ('append', true), ('delete', true), ('evolve', true), ('optimize', true), ('lower', true)) AS p(operation, refused)")
def protocol_refused(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    table = new(spark, orders)
    table.upgrade_protocol(1, 2)
    wider = T.StructType([*orders.schema, column("o_note", "string")])
    calls = {"append": lambda: table.append(orders), "delete": lambda: table.delete("true"), "evolve": lambda: table.evolve_schema(wider), "optimize": table.optimize}
    rows = [(name, _raises(ProtocolError, call)) for name, call in calls.items()]
    return spark.createDataFrame([*rows, ("lower", _raises(ValueError, lambda: table.upgrade_protocol(1, 1)))], "operation string, refused boolean")


@query("SELECT * FROM (VALUES ('required', true), ('narrowed', true), ('partition', true), ('two_from_one', true), ('not_null', true)) AS e(change, refused)")
def evolve_refused(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    table = new(spark, orders, partition_columns=["o_orderstatus"])

    def changed(*extra: T.StructField, **columns: T.StructField) -> T.StructType:
        return T.StructType([*[columns.get(f.name, f) for f in orders.schema], *extra])

    schemas = {
        "required": changed(column("o_note", "string", nullable=False)),
        "narrowed": changed(o_totalprice=column("o_totalprice", "int")),
        "partition": changed(o_orderstatus=column("o_state", "string", aliases=["o_orderstatus"])),
        "two_from_one": changed(column("o_b", "double", aliases=["o_totalprice"]), o_totalprice=column("o_a", "double", aliases=["o_totalprice"])),
        "not_null": changed(o_custkey=column("o_custkey", "long", nullable=False)),
    }
    rows = [(name, _raises(SchemaError, lambda schema=schema: table.evolve_schema(schema))) for name, schema in schemas.items()]
    return spark.createDataFrame(rows, "change string, refused boolean")


@query("SELECT * FROM (VALUES ('unrelated append', true), ('file read was removed', false), ('new file matches', false), ('metadata changed', false)) AS t(meanwhile, committed)")
def transaction_conflicts(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    rows = []

    def attempt(meanwhile: str, watch: Callable, change: Callable) -> None:
        table = new(spark, orders.coalesce(1))
        txn = watch(table.begin_transaction(), table)
        change(table)
        rows.append((meanwhile, txn.commit([table.info(table.version, "CHECK")]) is not None))

    attempt("unrelated append", lambda txn, t: txn.read_paths(t.snapshot().files), lambda t: t.append(orders))
    attempt("file read was removed", lambda txn, t: txn.read_path(next(iter(t.snapshot().files))), lambda t: t.delete("true"))
    attempt("new file matches", lambda txn, t: txn.fail_if_new_file_matches(lambda f: f.stats.rows > 0), lambda t: t.append(orders))
    attempt("metadata changed", lambda txn, t: txn.fail_on_metadata_changes(), lambda t: t.set_retention(dt.timedelta(1)))
    return spark.createDataFrame(rows, "meanwhile string, committed boolean")


@query("SELECT id, name, age FROM (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey + CASE WHEN n_nationkey >= 10 THEN 1 ELSE 0 END AS INTEGER) AS age FROM nation) WHERE age <> 0 AND id BETWEEN 3 AND 20")
def records(spark, sf_dir):
    nations = [Record(r.n_nationkey, r.n_name, r.n_regionkey) for r in source(spark, sf_dir, "nation").collect()]
    table = RecordTable(VersionedTable(spark, workspace(spark)))
    table.append([r for r in nations if r.id < 15])
    table.upsert([Record(r.id, r.name, r.age + 1) for r in nations if r.id >= 10])
    table.delete("age = 0")
    return spark.createDataFrame([(r.id, r.name, r.age) for r in table.query_id_range(3, 20)], RECORDS)


_JOIN = "SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
_AGG = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus"
_WINDOW = "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders"
_TOPK = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"


def _views(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The query over views of versioned tables instead of the plain ones."""
    for n in names:
        view = f"{n}_{uuid.uuid4().hex[:12]}"
        new(spark, source(spark, sf_dir, n)).create_or_replace_temp_view(view)
        sql = sql.replace(f"FROM {n}", f"FROM {view}").replace(f"JOIN {n} ", f"JOIN {view} ")
    return spark.sql(sql)


@query(_JOIN)
def sql_view_join(spark, sf_dir):
    return _views(spark, sf_dir, _JOIN, "orders", "customer", "nation")


@query(_AGG)
def sql_view_agg(spark, sf_dir):
    return _views(spark, sf_dir, _AGG, "lineitem")


@query(_WINDOW)
def sql_view_window(spark, sf_dir):
    return _views(spark, sf_dir, _WINDOW, "orders")


@query(_TOPK)
def sql_view_topk(spark, sf_dir):
    return _views(spark, sf_dir, _TOPK, "orders")


_APPROX = "SELECT abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS near FROM orders"


@query(_APPROX)
def sql_view_approx_distinct(spark, sf_dir):
    return _views(spark, sf_dir, _APPROX, "orders")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in two commits, counted by status through a view."""
    view = f"orders_{uuid.uuid4().hex[:12]}"
    new(spark, *halves(source(spark, sf_dir, "orders"), "o_orderkey")).create_or_replace_temp_view(view)
    return spark.sql(f"SELECT o_orderstatus, count(*) AS n FROM {view} GROUP BY o_orderstatus ORDER BY o_orderstatus")
