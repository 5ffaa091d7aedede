"""Parts that need no table: actions, storage, snapshots, pruning, Z keys, schemas."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lakewright.errors import SchemaError
from lakewright.functions import schema as S
from lakewright.functions.schema import column
from lakewright.functions.zorder import interleaved, scaled
from lakewright.plans import pruning
from lakewright.plans.actions import AddFile, ColumnStats, CommitInfo, FileStats, Metadata, Protocol, RemoveFile, Txn, decode_all, encode_all
from lakewright.plans.log import Cache, Snapshot
from lakewright.sources.storage import Storage


def add(path, **stats):
    return AddFile(path, 1, 2, True, "k", FileStats(10, {c: ColumnStats(*v) for c, v in stats.items()}))


def test_actions_round_trip():
    values = [1, 1.5, float("inf"), "ü", True, b"\x00\xff", Decimal("1.20"), dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3, 4, 5, 678901), None]
    actions = [AddFile("p", 1, 2, False, "k", FileStats(3, {f"c{i}": ColumnStats(v, v, i) for i, v in enumerate(values)}), {"a": values[7]}), RemoveFile("p", 3, True), Metadata("i", "{}", ("a",), {"x": "y"}, {"k": "{}"}), Protocol(1, 2), Txn("a", 3, 4), CommitInfo(5, "OP", {"a": "b"}, None), AddFile("q", 1, 2, True, "k")]
    assert decode_all(encode_all(actions)) == actions


def test_replay():
    a, b = add("a"), add("b")
    s = Snapshot(-1).with_actions(0, [Protocol(), Metadata("1", "{}"), a, b, Txn("x", 5, 1)])
    s = s.with_actions(1, [RemoveFile("a", 9, True), Metadata("2", "{}"), Txn("x", 4, 2)])
    assert list(s.files) == ["b"] and list(s.tombstones) == ["a"] and s.metadata.id == "2" and s.transactions["x"].version == 5
    s = s.with_actions(2, [a])
    assert list(s.files) == ["b", "a"] and not s.tombstones and s.contains("a") and s.file_count == 2
    assert Snapshot(-1).with_actions(2, s.actions()) == s


def test_cache():
    c = Cache(2)
    c.put(1, "a"), c.put(2, "b"), c.get(1), c.put(3, "c")
    assert c.get(2) is None and c.get(1) == "a" and len(c) == 2 and 3 in c
    with pytest.raises(ValueError):
        Cache(0)
    with pytest.raises(ValueError):
        c.put(None, 1)


def test_storage(spark, tmp_path):
    s = Storage(spark, str(tmp_path))
    assert s.put_if_absent("a/b.json", b"1") and not s.put_if_absent("a/b.json", b"2") and s.read("a/b.json") == b"1"
    assert s.names("a") == ["b.json"] and s.names("a", after="b.json") == [] and s.names("none") == []
    assert s.exists("a/b.json") and s.delete("a/b.json") and not s.delete("a/b.json")
    for bad in ("", "/x", "../x", "a/../../x", "a//b", "a\\b"):
        with pytest.raises(ValueError):
            s.read(bad)
    assert s.key_of(f"file://{tmp_path}/data/c=a%2520b/x.parquet") == "data/c=a%20b/x.parquet"


def test_storage_through_hadoop(spark, tmp_path):
    s = Storage(spark, f"file://{tmp_path}")
    s.local = None  # as for any other file system
    assert s.put_if_absent("l/a.json", b"\x00\xff") and not s.put_if_absent("l/a.json", b"2") and s.read("l/a.json") == b"\x00\xff"
    s.write("l/a.json", b"3")
    assert s.read("l/a.json") == b"3" and s.names("l") == ["a.json"] and [f.key for f in s.files("l")] == ["l/a.json"] and s.files("none") == []
    assert s.rename_if_absent("l", "m") and s.exists("m/a.json") and s.delete("m") and not s.exists("m/a.json")


SCHEMA = T.StructType([column("x", "double", aliases=["old_x"]), column("y", "string"), column("z", "long", default=7)])
number = st.one_of(st.none(), st.floats(width=32), st.integers(-5, 5).map(float))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(number, st.one_of(st.none(), st.text(max_size=4))), min_size=1, max_size=6), st.integers(-6, 6), st.integers(0, 6), st.text(max_size=3), st.booleans(), st.booleans())
def test_pruning_never_hides_a_row(rows, low, width, text, renamed, with_stats):
    from lakewright.sources.writer import _column_stats

    def bounds(values):
        held = [v for v in values if v is not None]
        key = lambda v: (v != v, v)  # noqa: E731 NaN is the largest
        return (min(held, key=key), max(held, key=key)) if held else (None, None)

    physical = T.StructType([column("old_x" if renamed else "x", "float"), column("y", "string")])
    columns = {n: _column_stats(*bounds([r[i] for r in rows]), sum(r[i] is None for r in rows)) for i, n in enumerate(physical.names)}
    f = AddFile("p", 1, 1, True, "k", FileStats(len(rows), columns) if with_stats else None)
    for ranges in ({"x": (low, low + width)}, {"y": (min(text, "b"), max(text, "b"))}, {"x": (low, low + width), "y": ("", text)}, {"z": (low, low + width)}):
        inside = lambda v, r: v is not None and v == v and r[0] <= v <= r[1]
        hit = any(all(inside({"x": a, "y": b, "z": 7}[c], r) for c, r in ranges.items()) for a, b in rows)
        assert pruning.may_hold(f, ranges, SCHEMA, physical) or not hit


def test_merge_key_pruning():
    schema = T.StructType([column("id", "long")])
    f = add("a", id=(10, 20, 0))
    hit = lambda keys, exact: pruning.may_hold_any(f, "id", keys, exact, schema, schema)
    assert hit([1, 15], True) and not hit([1, 30], True) and hit((1, 30), False) and not hit((21, 30), False) and not hit([], True)
    assert not pruning.may_hold_any(add("b", id=(None, None, 10)), "id", [1], True, schema, schema)


@pytest.mark.parametrize("old,new,ok", [("int", "long", True), ("int", "double", True), ("long", "float", True), ("double", "float", False), ("long", "int", False), ("decimal(5,2)", "decimal(9,2)", True), ("decimal(5,2)", "decimal(9,3)", False), ("array<int>", "array<long>", True), ("map<string,int>", "map<string,long>", True), ("map<string,int>", "map<string,string>", False), ("struct<a:int>", "struct<a:long,b:string>", True), ("struct<a:int,b:int>", "struct<a:int>", False), ("string", "binary", False), ("date", "timestamp", False)])
def test_widening(old, new, ok):
    kind = lambda t: column("c", t).dataType
    assert S.widens(kind(old), kind(new)) is ok


def test_bounds_must_fit_the_type():
    assert pruning.comparable(dt.datetime(1970, 1, 1, 1), T.TimestampType(), "Europe/Berlin") == 0
    for value, kind in ((1, T.StringType()), ("1", T.LongType()), (True, T.LongType()), (dt.datetime(2020, 1, 1), T.DateType())):
        with pytest.raises(SchemaError):
            pruning.comparable(value, kind)


def test_nested_values_are_converted(spark):
    old = column("c", "struct<a:int,old:array<struct<x:int>>>").dataType
    inner = T.ArrayType(T.StructType([T.StructField("x", T.LongType()), column("y", "string", default="d")]))
    new = T.StructType([T.StructField("a", T.LongType()), T.StructField("new", inner, True, {"aliases": ["old"]})])
    df = spark.createDataFrame([(((1, [(2,)])),), (None,)], T.StructType([T.StructField("c", old)]))
    got = [r.c for r in df.select(S.converted(df["c"], old, new).alias("c")).collect()]
    assert got[1] is None and got[0].a == 1 and got[0].new[0].x == 2 and got[0].new[0].y == "d"


def test_z_keys_interleave_ranks():
    x, y = np.array([0, 1, 2, 3] * 4), np.repeat([0, 1, 2, 3], 4)
    ranks = [scaled(v, np.arange(4)) for v in (x, y)]
    keys = [bytes(k) for k in interleaved(ranks)]
    top = lambda v: (v >> 1, v & 1)
    want = sorted(range(16), key=lambda i: (top(x[i])[0], top(y[i])[0], top(x[i])[1], top(y[i])[1]))
    assert sorted(range(16), key=lambda i: keys[i]) == want
    assert scaled(np.array([5]), np.array([5])).tolist() == [0]
