"""What a commit may say, and how it is written: one JSON object a line, typed by its single key."""

from __future__ import annotations

import base64
import dataclasses
import datetime as dt
import decimal
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnStats:
    """Bounds are typed by the file's schema; None: unknown."""

    min: Any = None
    max: Any = None
    nulls: int = 0


@dataclass(frozen=True)
class FileStats:
    rows: int
    columns: dict[str, ColumnStats] = field(default_factory=dict)


@dataclass(frozen=True)
class AddFile:
    path: str
    size: int
    modified: int
    data_change: bool
    schema_key: str
    stats: FileStats | None = None
    partition: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class RemoveFile:
    path: str
    deleted: int  # milliseconds
    data_change: bool


@dataclass(frozen=True)
class Metadata:
    id: str
    schema: str  # JSON of a StructType
    partition_columns: tuple[str, ...] = ()
    configuration: dict[str, str] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)  # of older files, by schema_key
    format: str = "parquet"


@dataclass(frozen=True)
class Protocol:
    min_reader: int = 1
    min_writer: int = 1


@dataclass(frozen=True)
class Txn:
    app_id: str
    version: int
    updated: int


@dataclass(frozen=True)
class CommitInfo:
    timestamp: int  # milliseconds
    operation: str
    parameters: dict[str, str] = field(default_factory=dict)
    user_metadata: str | None = None


Action = AddFile | RemoveFile | Metadata | Protocol | Txn | CommitInfo
_NAMES = {"add": AddFile, "remove": RemoveFile, "metadata": Metadata, "protocol": Protocol, "txn": Txn, "commit": CommitInfo}
_TAGS = {kind: name for name, kind in _NAMES.items()}


def _plain(value: Any) -> Any:
    """JSON that remembers the type where JSON has none."""
    match value:
        case None | bool() | int() | str():
            return value
        case float():
            return {"f": repr(value)}
        case decimal.Decimal():
            return {"n": str(value)}
        case dt.datetime():
            return {"t": value.isoformat()}
        case dt.date():
            return {"d": value.isoformat()}
        case bytes() | bytearray():
            return {"b": base64.b64encode(bytes(value)).decode()}
    raise TypeError(f"no bound of type {type(value).__name__}")


def _typed(value: Any) -> Any:
    if not isinstance(value, dict):
        return value
    ((tag, text),) = value.items()
    return {"f": float, "n": decimal.Decimal, "t": dt.datetime.fromisoformat, "d": dt.date.fromisoformat, "b": base64.b64decode}[tag](text)


def encode(action: Action) -> str:
    body = dataclasses.asdict(action)
    if isinstance(action, AddFile):
        body["partition"] = {k: _plain(v) for k, v in action.partition.items()}
        if action.stats:
            body["stats"]["columns"] = {k: [_plain(c.min), _plain(c.max), c.nulls] for k, c in action.stats.columns.items()}
    return json.dumps({_TAGS[type(action)]: body}, separators=(",", ":"), sort_keys=True)


def decode(line: str) -> Action:
    ((name, body),) = json.loads(line).items()
    if name == "add":
        body["partition"] = {k: _typed(v) for k, v in body["partition"].items()}
        if s := body["stats"]:
            body["stats"] = FileStats(s["rows"], {k: ColumnStats(_typed(a), _typed(b), n) for k, (a, b, n) in s["columns"].items()})
    elif name == "metadata":
        body["partition_columns"] = tuple(body["partition_columns"])
    return _NAMES[name](**body)


def encode_all(actions: list[Action]) -> bytes:
    return "".join(encode(a) + "\n" for a in actions).encode()


def decode_all(data: bytes) -> list[Action]:
    return [decode(line) for line in data.decode().splitlines() if line]


#: One row for each action; the line itself is the payload, the other columns let Spark filter checkpoints.
CHECKPOINT_SCHEMA = T.StructType([T.StructField("kind", T.StringType()), T.StructField("path", T.StringType()), T.StructField("line", T.StringType())])


def checkpoint_row(action: Action) -> tuple[str, str | None, str]:
    return _TAGS[type(action)], getattr(action, "path", None), encode(action)
