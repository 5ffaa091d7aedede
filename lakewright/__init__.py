"""Versioned tables on Spark."""

from .errors import ConflictError, LogCorrupted, ProtocolError, SchemaError, TableError, TableNotFound, VersionNotFound
from .functions.schema import column
from .operators.mutate import MergeSpec
from .table import VersionedTable

__all__ = ["ConflictError", "LogCorrupted", "MergeSpec", "ProtocolError", "SchemaError", "TableError", "TableNotFound", "VersionNotFound", "VersionedTable", "column"]
