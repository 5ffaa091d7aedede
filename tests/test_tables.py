"""Tables end to end: versions, mutations, layout, evolution, feed."""

import datetime as dt
import threading
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright import ConflictError, LogCorrupted, MergeSpec, ProtocolError, SchemaError, TableError, TableNotFound, VersionedTable, VersionNotFound, column

PEOPLE = "id long, name string, age int"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def people(spark, ids, age=30, name="n"):
    return spark.createDataFrame([(i, f"{name}{i}", age) for i in ids], PEOPLE).coalesce(1)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def grown(spark, path, *ranges, **options):
    t = VersionedTable(spark, path, **options)
    for r in ranges:
        t.append(people(spark, r))
    return t


def test_life_of_a_table(spark, path):
    t = VersionedTable(spark, path)
    assert t.version == -1 and not t.exists() and t.checkpoint() is False and t.retention == dt.timedelta(days=7)
    for call in (t.snapshot, t.read, t.optimize, t.vacuum, t.history, lambda: t.delete("true"), lambda: t.rollback(0), lambda: t.evolve_schema(T.StructType())):
        with pytest.raises(TableNotFound):
            call()
    assert t.append(people(spark, [1, 2])) == 0 and t.append(people(spark, [3])) == 1
    again = VersionedTable(spark, path)
    assert ids(again.read()) == [1, 2, 3] and ids(again.read(version=0)) == [1, 2] and again.schema.simpleString() == "struct<id:bigint,name:string,age:int>"
    for bad in (-1, 2):
        with pytest.raises(VersionNotFound):
            t.read(version=bad)
    with pytest.raises(ValueError, match="no rows"):
        t.append(people(spark, []))
    assert t.version == 1 and [r.operation for r in t.history().collect()] == ["APPEND", "APPEND"]
    assert [v for v, _ in t.tail(-1)] == [0, 1] == [v for v, _ in t.tail(-1, threads=4)] and t.tail(1) == []
    with pytest.raises(VersionNotFound):
        t.tail(2)
    with pytest.raises(VersionNotFound):
        t.snapshot_as_of(0)
    assert t.snapshot_as_of(dt.datetime(2999, 1, 1)).version == 1
    with pytest.raises(ValueError):
        VersionedTable(spark, path, checkpoint_interval=0)
    for columns in ([""], ["a", "a"]):
        with pytest.raises(ValueError):
            VersionedTable(spark, path, partition_columns=columns)


def test_rows_must_fit(spark, path):
    t = grown(spark, path, [1])
    for bad in ("id long, name string, age int, more int", "id long, name string, age long", "id double, name string, age int"):
        with pytest.raises(SchemaError):
            t.append(spark.createDataFrame([], bad))
    t.append(spark.createDataFrame([(2, "b")], "id int, name string"))  # narrower, and a nullable column less
    assert [tuple(r) for r in t.read(where={"id": (2, 2)}).collect()] == [(2, "b", None)]
    strict = VersionedTable(spark, path + "2")
    strict.append(people(spark, [1]), schema=T.StructType([column("id", "long", nullable=False), column("name", "string"), column("age", "int")]))
    with pytest.raises(SchemaError):
        strict.append(spark.createDataFrame([("x",)], "name string"))
    with pytest.raises(Exception, match="null in required column id"):
        strict.append(spark.createDataFrame([(None, "x", 1)], PEOPLE))
    assert strict.version == 0
    with pytest.raises(SchemaError):
        VersionedTable(spark, path + "3").append(spark.sql("SELECT map(1, 'a') AS m"))


def test_every_type_survives(spark, path):
    df = spark.sql(
        "SELECT CAST(1 AS TINYINT) b, CAST(2 AS SMALLINT) s, 3 i, 4L l, CAST(0.5 AS FLOAT) f, CAST('NaN' AS DOUBLE) d, true t, 'ü' u, X'80FF' y, 12.34BD n, DATE'2020-02-29' e,"
        " TIMESTAMP'2020-01-01 00:00:00.123456' z, TIMESTAMP_NTZ'2020-01-01 00:00:00.123456' w, array(1, null) a, map('k', 1) m, named_struct('ok', true, 'x', 's') c"
    )
    t = VersionedTable(spark, path)
    t.append(df)
    t.checkpoint()
    fresh = VersionedTable(spark, path)
    assert fresh.read().collect()[0].asDict(True) | {"d": 0} == df.collect()[0].asDict(True) | {"d": 0}
    hits = {"b": (1, 1), "n": (Decimal("12.3"), Decimal("12.4")), "e": (dt.date(2020, 2, 29), dt.date(2020, 3, 1)), "z": (dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)), "w": (dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)), "y": (b"\x80", b"\x81"), "u": ("t", "ý"), "f": (0, 1)}
    for c, r in hits.items():
        assert fresh.read(where={c: r}).count() == 1, c
    for c, r in {"b": (2, 3), "e": (dt.date(2021, 1, 1), dt.date(2021, 1, 1)), "z": (dt.datetime(2021, 1, 1), dt.datetime(2022, 1, 1)), "y": (b"\x00", b"\x7f"), "u": ("a", "b")}.items():
        assert fresh.candidates({c: r}) == [] and fresh.read(where={c: r}).count() == 0


def test_application_versions(spark, path):
    t = VersionedTable(spark, path)
    assert t.append(people(spark, [1]), app_id="a", txn_version=5) == 0
    assert t.append(people(spark, [2]), app_id="a", txn_version=5) == 0 and t.append(people(spark, [3]), app_id="a", txn_version=4) == 0
    assert t.append(people(spark, [4]), app_id="b", txn_version=1) == 1 and t.append(people(spark, [5]), app_id="a", txn_version=6) == 2
    t.checkpoint()
    assert VersionedTable(spark, path).append(people(spark, [6]), app_id="a", txn_version=6) == 2
    assert ids(t.read()) == [1, 4, 5]
    assert len({f.key.split("/")[1] for f in t.storage.files("data")}) == 3
    with pytest.raises(ValueError):
        t.append(people(spark, [1]), app_id="a")


def test_parallel_append(spark, path):
    t = VersionedTable(spark, path)
    assert t.append_parallel([]) == -1
    assert t.append_parallel([people(spark, [1]), None, people(spark, [2]), people(spark, [3])], threads=3) == 0
    assert t.snapshot().file_count == 3 and ids(t.read()) == [1, 2, 3] and t.append_parallel([None]) == 0
    with pytest.raises(ValueError):
        t.append_parallel([people(spark, [1])], threads=0)


def test_pruning_by_statistics(spark, path):
    t = grown(spark, path, range(1, 11), range(101, 111), range(201, 211))
    assert len(t.candidates({"id": (105, 108)})) == 1 and ids(t.read(where={"id": (105, 108)})) == [105, 106, 107, 108]
    assert t.candidates({"id": (11, 100)}) == [] and t.read(where={"id": (11, 100)}).count() == 0
    assert len(t.read(where={"id": (105, 108)}).inputFiles()) == 1
    assert len(t.candidates({"id": (1, 300), "age": (31, 40)})) == 0 and len(t.candidates({"age": (30.0, Decimal("30"))})) == 3
    for bad in ({"x": (1, 2)}, {"id": (2, 1)}, {"id": (None, 1)}, {"id": ("a", "b")}, {"id": (float("nan"), 1)}):
        with pytest.raises((SchemaError, ValueError)):
            t.read(where=bad)
    stats = {r.column: r for r in t.file_stats(version=0).collect()}
    assert (stats["id"].rows, stats["id"].min, stats["id"].max, stats["id"].nulls) == (10, "1", "10", 0)


def test_nulls_nan_and_long_values_never_hide_rows(spark, path):
    t = VersionedTable(spark, path)
    df = spark.createDataFrame([(1, float("nan"), "x" * 1000), (2, 5.0, None), (3, None, "a")], "id long, v double, s string")
    t.append(df.coalesce(1))
    assert ids(t.read(where={"v": (4, 6)})) == [2] and ids(t.read(where={"s": ("w", "y")})) == [1] and ids(t.read(where={"s": ("x" * 999, "x" * 1001)})) == [1]
    t.append(spark.createDataFrame([(4, None, None)], "id long, v double, s string"))
    assert len(t.candidates({"v": (0, 1e300)})) == 1


def test_partitions(spark, path):
    rows = [(1, "CA"), (2, "A/B=C%25"), (3, None), (4, ""), (5, "CA"), (6, "ü x")]
    t = VersionedTable(spark, path, partition_columns=["country"])
    t.append(spark.createDataFrame(rows, "id long, country string"))
    assert sorted(map(tuple, t.read().collect())) == sorted(rows)
    for i, c in rows:
        if c is not None:
            files = t.candidates({"country": (c, c)})
            assert {f.partition["country"] for f in files} == {c} and i in ids(t.read(where={"country": (c, c)}))
    t.delete("id = 2")
    t.optimize()
    assert ids(t.read()) == [1, 3, 4, 5, 6] and VersionedTable(spark, path).partition_columns == ("country",)
    with pytest.raises(SchemaError):
        VersionedTable(spark, path + "x", partition_columns=["nope"]).append(people(spark, [1]))


def test_delete(spark, path):
    t = grown(spark, path, [1, 2, 3], [11, 12], [21])
    before = set(t.snapshot().files)
    assert t.delete("id = 99") == 2 and t.delete("cast(null as boolean)") == 2 and t.delete("true", where={"id": (50, 60)}) == 2
    assert t.delete(F.col("id").isin(2, 21)) == 3
    after = t.snapshot()
    assert ids(t.read()) == [1, 3, 11, 12] and len(before & set(after.files)) == 1 and after.file_count == 2
    assert t.delete("true", where={"id": (1, 3)}) == 4 and ids(t.read()) == [11, 12] and ids(t.read(version=2)) == [1, 2, 3, 11, 12, 21]
    assert t.delete("true") == 5 and t.read().count() == 0 and t.snapshot().file_count == 0 and t.delete("true") == 5


def test_upsert_and_merge(spark, path):
    t = grown(spark, path, [1, 2], [11, 12])
    untouched = next(p for p, f in t.snapshot().files.items() if f.stats.columns["id"].min == 11)
    assert t.upsert(people(spark, [2, 3], age=50), "id") == 2
    assert untouched in t.snapshot().files and {(r.id, r.age) for r in t.read().collect()} == {(1, 30), (2, 50), (3, 50), (11, 30), (12, 30)}
    source = spark.createDataFrame([(1, True), (2, False), (11, True), (77, True), (78, False)], "id int, enabled boolean")
    spec = MergeSpec().when_matched_delete("s.enabled AND t.id > 10").when_matched_update({"name": "concat(t.name, '!')"}, condition="s.enabled").when_not_matched_insert({"id": "s.id", "age": F.lit(9)}, condition="s.enabled")
    assert t.merge(source, "id", spec, user_metadata="m") == 3
    assert {tuple(r) for r in t.read().collect()} == {(1, "n1!", 30), (2, "n2", 50), (3, "n3", 50), (12, "n12", 30), (77, None, 9)}
    assert t.history().first().user_metadata == "m"
    assert t.merge(source.where("id = 999"), "id", spec) == 3
    assert t.merge(spark.createDataFrame([(5,)], "id long"), "id", MergeSpec().when_matched_delete()) == 3
    for bad, error in ((people(spark, [5, 5]), ValueError), (spark.createDataFrame([(None, "x", 1)], PEOPLE), ValueError), (people(spark, [5]).drop("id"), SchemaError), (people(spark, [5]).withColumn("more", F.lit(1)), SchemaError)):
        with pytest.raises(error):
            t.upsert(bad, "id")
    with pytest.raises(ValueError):
        t.merge(source, "id", MergeSpec())
    assert t.version == 3


def test_merge_with_null_and_repeated_target_keys(spark, path):
    t = VersionedTable(spark, path)
    t.append(spark.createDataFrame([(None, "null", 1), (7, "a", 1), (7, "b", 1)], PEOPLE))
    t.upsert(people(spark, [7], age=2), "id")
    assert sorted((r.id or 0, r.name) for r in t.read().collect()) == [(0, "null"), (7, "n7"), (7, "n7")]


def test_merge_creates_a_table(spark, path):
    t = VersionedTable(spark, path)
    assert t.merge(people(spark, [1]), "id", MergeSpec().when_matched_delete()) == -1
    assert t.upsert(people(spark, [1, 2]), "id") == 0 and ids(t.read()) == [1, 2]


def test_optimize(spark, path):
    t = grown(spark, path, *[[i] for i in range(5)])
    with pytest.raises(ValueError):
        t.optimize(0)
    assert t.optimize() == 5 and t.snapshot().file_count == 1 and ids(t.read()) == list(range(5)) and t.optimize() == 5
    assert not any(a.data_change for a in t.snapshot().files.values())
    t.optimize_async().join(60)
    assert t.version == 5


def test_auto_optimize(spark, path):
    t = grown(spark, path, [1])
    t.set_auto_optimize(True)
    for i in (2, 3, 4):
        t.append(people(spark, [i]))
    assert t.snapshot().file_count == 1 and ids(t.read()) == [1, 2, 3, 4]
    t.set_auto_optimize(False)
    for i in (5, 6, 7, 8):
        t.append(people(spark, [i]))
    assert t.snapshot().file_count == 5


def grid(spark, n):
    return [(x * n + y, x, y) for x in range(n) for y in range(n)]


def test_z_order_brings_neighbours_together(spark, path):
    t = VersionedTable(spark, path)
    for y in range(4):
        t.append(spark.createDataFrame([r for r in grid(spark, 4) if r[2] == y], "id long, x int, y int").coalesce(1))
    t.optimize_z_order("x", "y")
    assert t.snapshot().file_count == 4 and ids(t.read()) == list(range(16))
    for c in "xy":
        for v in range(4):
            assert len(t.candidates({c: (v, v)})) == 2
    for bad in ((), ("x", "x"), ("nope",)):
        with pytest.raises((ValueError, SchemaError)):
            t.optimize_z_order(*bad)


def test_z_order_of_a_scope(spark, path):
    t = grown(spark, path, *[range(10 * i, 10 * i + 10) for i in range(5)])
    before = set(t.snapshot().files)
    t.optimize_z_order("name", "age", where={"id": (5, 15)})
    assert len(before & set(t.snapshot().files)) == 3 and ids(t.read()) == list(range(50))
    assert t.optimize_z_order("age", where={"id": (900, 901)}) == t.version


def test_vacuum(spark, path):
    t = grown(spark, path, [1], [2], [3])
    t.optimize()
    assert t.vacuum() == 0
    with pytest.raises(ValueError):
        t.vacuum(dt.timedelta(-1))
    assert t.vacuum(dt.timedelta(0)) == 3 and t.vacuum(dt.timedelta(0)) == 0 and ids(t.read()) == [1, 2, 3] and len(t.snapshot().tombstones) == 3
    with pytest.raises(TableError):
        t.rollback(1)
    t.set_retention(dt.timedelta(0))
    t.checkpoint()
    assert VersionedTable(spark, path).retention == dt.timedelta(0) and VersionedTable(spark, path).snapshot().tombstones == {}


def test_rollback(spark, path):
    t = grown(spark, path, [1], [2])
    t.delete("id = 1")
    t.evolve_schema(T.StructType([*t.schema, column("city", "string")]))
    assert t.rollback(1) == 4 and ids(t.read()) == [1, 2] and t.schema.names == ["id", "name", "age"] and t.rollback(4) == 4
    with pytest.raises(VersionNotFound):
        t.rollback(9)


def test_checkpoints(spark, path):
    t = grown(spark, path, *[[i] for i in range(7)], checkpoint_interval=3)
    assert [n for n in t.storage.names("_log") if "checkpoint" in n and n.endswith("parquet")] == [f"{v:020d}.checkpoint.parquet" for v in (2, 5)]
    for v in (0, 1, 3):
        t.storage.delete(f"_log/{v:020d}.json")
    fresh = VersionedTable(spark, path)
    assert ids(fresh.read()) == list(range(7)) and ids(fresh.read(version=5)) == list(range(6))
    with pytest.raises(LogCorrupted):
        fresh.history()
    t.storage.write("_log/_last_checkpoint", b"not json")
    assert ids(VersionedTable(spark, path).read()) == list(range(7))
    t.storage.write("_log/_last_checkpoint", b'{"version": 4}')
    assert ids(VersionedTable(spark, path).read()) == list(range(7))


def test_evolution(spark, path):
    t = grown(spark, path, [1])
    idf, name, age = t.schema
    files = set(t.snapshot().files)
    assert t.evolve_schema(t.schema) == 0
    t.evolve_schema(T.StructType([idf, name, column("age", "long"), column("city", "string", default="?"), column("note", "string")]))
    t.append(spark.createDataFrame([(2, "b", 2**40, "Ulm", None)], "id long, name string, age long, city string, note string"))
    t.evolve_schema(T.StructType([idf, column("full_name", "string", aliases=["name"]), column("age", "double"), *t.schema[3:]]))
    assert {tuple(r) for r in t.read().collect()} == {(1, "n1", 30.0, "?", None), (2, "b", float(2**40), "Ulm", None)}
    assert files < set(t.snapshot().files)
    assert ids(t.read(where={"full_name": ("n", "o")})) == [1] and len(t.candidates({"full_name": ("n", "o")})) == 1
    assert ids(t.read(where={"city": ("?", "?")})) == [1] and len(t.candidates({"city": ("?", "?")})) == 1 and ids(t.read(where={"age": (1e9, 1e15)})) == [2]
    t.delete("full_name = 'b'")
    t.upsert(spark.createDataFrame([(1, "new", 1.5, "Bonn", "x")], t.schema), "id")
    assert [tuple(r) for r in t.read().collect()] == [(1, "new", 1.5, "Bonn", "x")]
    t.evolve_schema(T.StructType([t.schema["id"], t.schema["city"]]))
    assert [tuple(r) for r in t.read().collect()] == [(1, "Bonn")] and [tuple(r) for r in t.read(version=0).collect()] == [(1, "n1", 30)]
    assert t.incremental(-1).columns == ["id", "city", "_commit_version"]


@pytest.mark.parametrize(
    "fields",
    [
        [column("id", "int"), column("name", "string"), column("age", "int")],
        [column("id", "long"), column("name", "int"), column("age", "int")],
        [column("id", "long"), column("name", "string"), column("age", "int"), column("city", "string", nullable=False)],
        [column("id", "long"), column("a", "string", aliases=["name"]), column("b", "string", aliases=["name"]), column("age", "int")],
        [column("id", "long", nullable=False), column("name", "string"), column("age", "int")],
        [column("id", "long"), column("name", "string")],
        [column("id", "long"), column("m", "map<int,string>"), column("age", "int")],
    ],
)
def test_evolution_that_is_refused(spark, path, fields):
    t = grown(spark, path, [1], partition_columns=["age"])
    with pytest.raises(SchemaError):
        t.evolve_schema(T.StructType(fields))
    assert t.version == 0


def test_protocol(spark, path):
    t = grown(spark, path, [1])
    assert t.upgrade_protocol(1, 1) == 0
    with pytest.raises(ValueError):
        t.upgrade_protocol(0, 1)
    assert t.upgrade_protocol(1, 2) == 1
    for call in (lambda: t.append(people(spark, [2])), lambda: t.delete("true"), lambda: t.optimize(), lambda: t.upsert(people(spark, [2]), "id")):
        with pytest.raises(ProtocolError):
            call()
    with pytest.raises(ValueError):
        t.upgrade_protocol(1, 1)


def test_feed(spark, path):
    t = grown(spark, path, [1, 2], [3])
    c = t.consumer()
    assert ids(c.poll()) == [1, 2, 3] and c.poll() is None
    t.optimize()
    assert c.poll().count() == 0 and t.incremental_files(1) == []
    t.append(people(spark, [4]))
    assert [(v, f.stats.rows) for v, f in c.poll_files()] == [(3, 1)] and c.poll_files() == []
    t.delete("id = 1")
    assert {(r.id, r._commit_version) for r in t.incremental(3).select("id", "_commit_version").collect()} == {(2, 4), (3, 4)}
    with pytest.raises(VersionNotFound):
        t.incremental(9)


def test_view_keeps_its_version(spark, path):
    t = grown(spark, path, [1])
    with pytest.raises(ValueError):
        t.create_or_replace_temp_view(" ")
    t.create_or_replace_temp_view("people_view")
    t.append(people(spark, [2]))
    assert spark.sql("SELECT count(*) AS n FROM people_view").first() == Row(n=1)


def test_concurrent_writers(spark, path):
    start, errors = threading.Barrier(8), []

    def write(i):
        try:
            start.wait()
            VersionedTable(spark, path).append(people(spark, [i]))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [x.start() for x in threads], [x.join() for x in threads]
    t = VersionedTable(spark, path)
    assert not errors and t.version == 7 and ids(t.read()) == list(range(8))
    assert {f.key for f in t.storage.files("data") if f.key.endswith(".parquet")} == set(t.snapshot().files)


def test_conflicts_between_mutations(spark, path, monkeypatch):
    t = grown(spark, path, [1, 2], [11])
    other = VersionedTable(spark, path)
    base = t.snapshot()
    txn = t.begin_transaction().read_paths(base.files)
    other.delete("id = 1")
    assert txn.commit([t.info(2, "X")]) is None
    txn = t.begin_transaction().fail_on_metadata_changes()
    other.append(people(spark, [12]))
    assert txn.commit([t.info(3, "X")]) == 4
    txn = t.begin_transaction().fail_if_new_file_matches(lambda f: f.stats.columns["id"].max > 50)
    other.append(people(spark, [60]))
    assert txn.commit([t.info(5, "X")]) is None
    txn = t.begin_transaction().fail_on_metadata_changes()
    other.set_retention(dt.timedelta(1))
    assert txn.commit([t.info(6, "X")]) is None
    with pytest.raises(ValueError):
        txn.commit([])
    real, calls = VersionedTable.info, []

    def meddle(self, *a, **k):  # another writer gets in between plan and commit, once
        if a[1] == "DELETE" and not calls:
            calls.append(1)
            other.upsert(people(spark, [11], age=99), "id")
        return real(self, *a, **k)

    monkeypatch.setattr(VersionedTable, "info", meddle)
    t.delete("id = 12 OR age = 99")
    assert ids(t.read()) == [2, 60]
    calls.clear()
    monkeypatch.setattr("lakewright.table.ATTEMPTS", 0)
    with pytest.raises(ConflictError):
        t.append(people(spark, [5]))
    assert not [f for f in t.storage.files("data") if "5" == f.key]


def test_records(spark, path):
    from lakewright.records import Record, RecordTable

    t = RecordTable(VersionedTable(spark, path))
    for bad in ((1, " ", 1), (1, "a", -1)):
        with pytest.raises(ValueError):
            Record(*bad)
    a, b, c = Record(1, "Ann", 30), Record(2, "Bob", 40), Record(3, "Cy", 50)
    assert t.append([a, b], "app", 1) == 0 and t.append([c], "app", 1) == 0 and t.upsert([c]) == 1
    key = lambda r: r.id
    assert sorted(t.read_all(), key=key) == [a, b, c] and sorted(t.read(0), key=key) == [a, b] and t.count() == 3
    assert t.query_id_range(2, 2) == [b] and t.query("age > 45") == [c] and t.query(lambda r: r.name == "Ann") == [a] and t.query({"age": (35, 45)}) == [b]
    t.delete("id = 1")
    t.merge([Record(2, "Rob", 41)], MergeSpec().when_matched_update())
    assert sorted(t.read_all(), key=key) == [Record(2, "Rob", 41), c]
    other = RecordTable(grown(spark, path + "x", [1]))
    other.table.evolve_schema(T.StructType([f for f in other.table.schema if f.name != "age"]))
    with pytest.raises(TypeError):
        other.read_all()


@pytest.mark.parametrize("operation", ["delete", "upsert", "optimize", "z_order"])
def test_a_schema_change_between_staging_and_commit_is_noticed(spark, path, monkeypatch, operation):
    from lakewright.operators import maintain, mutate
    from lakewright.sources import writer

    t = grown(spark, path, [1, 2, 3], [4, 5])
    t.evolve_schema(T.StructType([*t.schema, column("city", "string")]))
    t.append(people(spark, [6]).withColumn("city", F.lit("Rome")))
    real, raced = writer.stage, []

    def stage(*args, **options):
        staged = real(*args, **options)
        if not raced:
            raced.append(1)
            other = VersionedTable(spark, path)
            other.evolve_schema(T.StructType([*other.schema, column("level", "int", default=7)]))
        return staged

    for module in (mutate, maintain):
        monkeypatch.setattr(module.writer, "stage", stage)
    act = {
        "delete": lambda: t.delete("id = 2"),
        "upsert": lambda: t.upsert(people(spark, [2], age=50), "id"),
        "optimize": t.optimize,
        "z_order": lambda: t.optimize_z_order("id"),
    }
    act[operation]()
    assert raced and ids(VersionedTable(spark, path).read()) == [i for i in range(1, 7) if operation != "delete" or i != 2]
    assert t.schema.names == ["id", "name", "age", "city", "level"] and {r.level for r in t.read().collect()} <= {7, None}
    assert t.read().where("level = 7").count() >= 3


def test_a_merge_works_out_its_source_once(spark, path):
    t = grown(spark, path, range(20))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    source = people(spark, range(15, 25), age=99).mapInArrow(counted, PEOPLE).withColumn("none", F.lit(None)).drop("none")
    t.upsert(source, "id")
    assert seen.value == 10 and ids(t.read()) == list(range(25)) and t.read().where("age = 99").count() == 10
    t.merge(people(spark, [1, 30]).withColumn("age", F.lit(None)), "id", MergeSpec().when_matched_update({"name": "'m'", "age": "s.age"}).when_not_matched_insert())
    assert t.read().where("id in (1, 30) and age is null").count() == 2 and ids(t.read()) == [*range(25), 30]
    assert t.storage.names("_work") == []


def test_hadoop_file_systems_and_unsafe_ones(spark, tmp_path):
    from lakewright.sources.storage import Storage

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.lake.link./t", f"file://{tmp_path}")
    t = VersionedTable(spark, "viewfs://lake/t/table")
    t.append(people(spark, [1, 2, 3]))
    t.upsert(people(spark, [3, 4], age=9), "id")
    t.delete("id = 1")
    t.checkpoint()
    assert ids(VersionedTable(spark, "viewfs://lake/t/table").read()) == [2, 3, 4] and t.version == 2
    assert t.storage.put_if_absent("x/1", b"a") and not t.storage.put_if_absent("x/1", b"b") and t.storage.read("x/1") == b"a"
    with pytest.raises(ValueError, match="consumer"):
        from lakewright.streaming.source import read_stream

        read_stream(spark, t)
    unsafe = Storage(spark, "nosuch://bucket/table")
    with pytest.raises(TableError, match="atomic"):
        unsafe.put_if_absent("_log/0", b"x")


def test_a_create_that_fails_because_of_another_writer_is_no_commit(spark, tmp_path, monkeypatch):
    from lakewright.sources.storage import Storage

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.pond.link./u", f"file://{tmp_path}")
    one, two = Storage(spark, "viewfs://pond/u/table"), Storage(spark, "viewfs://pond/u/table")
    real = one._fs

    class Late:
        """A file system whose first look finds nothing, just before another writer's file appears."""

        def __init__(self, fs):
            self.fs, self.looked = fs, False

        def exists(self, path):
            if not self.looked:
                self.looked = True
                assert two.put_if_absent("_log/1", b"other")
                return False
            return self.fs.exists(path)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    late = Late(real("_log/1")[0])
    monkeypatch.setattr(one, "_fs", lambda key: (late, real(key)[1]))
    assert one.put_if_absent("_log/1", b"mine") is False and two.read("_log/1") == b"other"


def test_times_are_searched(spark, path):
    t = grown(spark, path, *[[i] for i in range(6)])
    times = [t.log.time(v) for v in range(6)]
    for v, at in enumerate(times):
        assert t.snapshot_as_of(at).version == max(k for k in range(6) if times[k] <= at) >= v
    with pytest.raises(VersionNotFound):
        t.snapshot_as_of(times[0] - 1)


def test_the_streaming_source_opens_uris(spark, path):
    from lakewright.streaming.source import VersionReader, _Log

    t = grown(spark, path, [1, 2], [3])
    log = _Log(f"file://{path}")
    assert log.latest() == 1 and len(log.added(-1, 1)) == 2
    reader = VersionReader(f"file://{path}", t.schema, -1)
    parts = reader.partitions({"version": -1}, reader.latestOffset())
    assert sorted(i for p in parts for b in reader.read(p) for i in b.column("id").to_pylist()) == [1, 2, 3]
