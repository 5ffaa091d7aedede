"""Schemas of versioned tables: StructTypes whose fields may carry `aliases` and a `default` in their metadata."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError

_MISSING = object()
ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.StringType, T.BinaryType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)
_WIDER: dict[type, tuple[type, ...]] = {
    T.ByteType: (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType),
    T.ShortType: (T.IntegerType, T.LongType, T.FloatType, T.DoubleType),
    T.IntegerType: (T.LongType, T.FloatType, T.DoubleType),
    T.LongType: (T.FloatType, T.DoubleType),
    T.FloatType: (T.DoubleType,),
}


_ATOMIC = {k().simpleString(): k() for k in ORDERED if k is not T.DecimalType} | {"byte": T.ByteType(), "short": T.ShortType(), "long": T.LongType(), "integer": T.IntegerType()}


def parsed(text: str) -> T.DataType:
    """A type from its short name, as simpleString writes it; needs no session."""
    text = text.strip()
    if text in _ATOMIC:
        return _ATOMIC[text]
    if m := re.fullmatch(r"decimal\((\d+),\s*(-?\d+)\)", text):
        return T.DecimalType(int(m[1]), int(m[2]))
    if m := re.fullmatch(r"(array|map|struct)<(.*)>", text, re.S):
        parts, depth = [""], 0
        for c in m[2]:
            depth += (c in "<(") - (c in ">)")
            if c == "," and not depth:
                parts.append("")
            else:
                parts[-1] += c
        if m[1] == "struct":
            fields = [p.split(":", 1) for p in parts if p]
            return T.StructType([T.StructField(n.strip(), parsed(k)) for n, k in fields])
        kinds = [parsed(p) for p in parts]
        if len(kinds) == (1 if m[1] == "array" else 2):
            return T.ArrayType(*kinds) if m[1] == "array" else T.MapType(*kinds)
    raise SchemaError(f"no type: {text}")


def column(name: str, kind: T.DataType | str, nullable: bool = True, aliases: Iterable[str] = (), default: Any = _MISSING) -> T.StructField:
    """A field; aliases: earlier names; default: what rows written without the column hold."""
    metadata: dict[str, Any] = {}
    if aliases := list(aliases):
        metadata["aliases"] = aliases
    if default is not _MISSING:
        metadata["default"] = default
    if isinstance(kind, str):
        kind = parsed(kind)
    return T.StructField(name, kind, nullable, metadata)


def aliases(field: T.StructField) -> list[str]:
    return list((field.metadata or {}).get("aliases", ()))


def has_default(field: T.StructField) -> bool:
    return "default" in (field.metadata or {})


def default(field: T.StructField) -> Any:
    return (field.metadata or {}).get("default")


def name(text: str) -> Column:
    return F.col("`" + text.replace("`", "``") + "`")


def to_json(schema: T.StructType) -> str:
    return json.dumps(json.loads(schema.json()), sort_keys=True)


def from_json(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


def key(schema: T.StructType) -> str:
    """Names a physical layout: names and types, without aliases, defaults and nullability."""
    shape = [(f.name, f.dataType.simpleString()) for f in schema]
    return hashlib.sha256(json.dumps(shape).encode()).hexdigest()[:16]


def validate(schema: T.StructType) -> None:
    """Whether tables can hold the schema."""
    if not len(schema):
        raise SchemaError("a table needs a column")
    if len(set(schema.names)) < len(schema):
        raise SchemaError("column names are repeated")

    def check(kind: T.DataType, where: str) -> None:
        if isinstance(kind, T.ArrayType):
            check(kind.elementType, where)
        elif isinstance(kind, T.MapType):
            if not isinstance(kind.keyType, T.StringType):
                raise SchemaError(f"{where}: map keys must be strings")
            check(kind.valueType, where)
        elif isinstance(kind, T.StructType):
            for f in kind:
                check(f.dataType, f"{where}.{f.name}")
        elif not isinstance(kind, ORDERED):
            raise SchemaError(f"{where}: type {kind.simpleString()} is not supported")

    for f in schema:
        check(f.dataType, f.name)


def source_of(field: T.StructField, names: Iterable[str]) -> str | None:
    """The column of older rows that a field continues: its own name, else an alias."""
    names = set(names)
    return next((n for n in [field.name, *aliases(field)] if n in names), None)


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether every value of one type is read as the other without a rewrite."""
    if old == new or type(old) is type(new) and not isinstance(old, (T.DecimalType, T.ArrayType, T.MapType, T.StructType)):
        return True
    match old, new:
        case T.DecimalType(), T.DecimalType():
            return old.scale == new.scale and new.precision >= old.precision
        case T.ArrayType(), T.ArrayType():
            return widens(old.elementType, new.elementType)
        case T.MapType(), T.MapType():
            return widens(old.keyType, new.keyType) and widens(old.valueType, new.valueType)
        case T.StructType(), T.StructType():
            kept = [source_of(f, old.names) for f in new]
            if set(old.names) - set(kept):
                return False  # a nested field is dropped
            return all(widens(old[s].dataType, f.dataType) if s else f.nullable or has_default(f) for f, s in zip(new, kept, strict=True))
    return type(new) in _WIDER.get(type(old), ())


def evolution(old: T.StructType, new: T.StructType, partition_columns: Iterable[str] = ()) -> bool:
    """Whether a change drops columns, so that files are rewritten; raises where it is not allowed."""
    validate(new)
    used: dict[str, str] = {}
    for f in new:
        source = source_of(f, old.names)
        if source is None:
            if not f.nullable and not has_default(f):
                raise SchemaError(f"new column {f.name} must be nullable or have a default")
            continue
        if source in used:
            raise SchemaError(f"{used[source]} and {f.name} both continue {source}")
        used[source] = f.name
        if not widens(old[source].dataType, f.dataType):
            raise SchemaError(f"{source}: {old[source].dataType.simpleString()} cannot become {f.dataType.simpleString()}")
        if old[source].nullable and not f.nullable:
            raise SchemaError(f"{source} holds nulls and cannot become required")
    dropped = set(old.names) - set(used)
    if lost := dropped & set(partition_columns):
        raise SchemaError(f"partition columns cannot be dropped: {sorted(lost)}")
    if renamed := {c for c in partition_columns if c in used and used[c] != c}:
        raise SchemaError(f"partition columns cannot be renamed: {sorted(renamed)}")
    return bool(dropped)


def converted(value: Column, old: T.DataType, new: T.DataType) -> Column:
    """A value of an older type as the newer one, nested fields by name or alias."""
    if old == new:
        return value
    if isinstance(new, T.StructType):
        fields = []
        for f in new:
            s = source_of(f, old.names)
            fields.append((converted(value.getField(s), old[s].dataType, f.dataType) if s else literal(f)).alias(f.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(new, T.ArrayType) and isinstance(new.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(value, lambda x: converted(x, old.elementType, new.elementType))
    if isinstance(new, T.MapType) and isinstance(new.valueType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform_values(value, lambda _, x: converted(x, old.valueType, new.valueType))
    return value.cast(new)


def literal(field: T.StructField) -> Column:
    return F.lit(default(field)).cast(field.dataType)


def projection(physical: T.StructType, target: T.StructType) -> list[Column]:
    """Columns that show rows of an older schema in another: by name, else alias, else default, else null."""
    out = []
    for f in target:
        s = source_of(f, physical.names)
        out.append((converted(name(s), physical[s].dataType, f.dataType) if s else literal(f)).alias(f.name))
    return out


def aligned(df: DataFrame, target: T.StructType) -> DataFrame:
    """df with the target's columns and types; unknown columns, missing required ones and narrowing are errors.

    A null in a required column fails the job that writes it.
    """
    if len(set(df.columns)) < len(df.columns):
        raise SchemaError("column names are repeated")
    if unknown := [c for c in df.columns if c not in target.names]:
        raise SchemaError(f"columns that the table does not have: {unknown}")
    out = []
    for f in target:
        if f.name not in df.columns:
            if not f.nullable and not has_default(f):
                raise SchemaError(f"required column {f.name} is missing")
            out.append(literal(f).alias(f.name))
            continue
        have = df.schema[f.name].dataType
        if not isinstance(have, T.NullType) and not widens(have, f.dataType):
            raise SchemaError(f"{f.name}: {have.simpleString()} does not fit {f.dataType.simpleString()}")
        value = name(f.name).cast(f.dataType) if isinstance(have, T.NullType) else converted(name(f.name), have, f.dataType)
        if not f.nullable and df.schema[f.name].nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"null in required column {f.name}")).cast(f.dataType))
        out.append(value.alias(f.name))
    return df.select(*out)
