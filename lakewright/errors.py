"""What can go wrong with a versioned table."""


class TableError(Exception):
    """Base of all errors of this library."""


class TableNotFound(TableError):
    """The table has no version yet."""


class VersionNotFound(TableError, ValueError):
    """A version, or a timestamp's version, that the log does not hold."""


class ConflictError(TableError):
    """Another writer changed what this one relied on."""


class SchemaError(TableError, ValueError):
    """Rows or a schema that do not fit the table's."""


class ProtocolError(TableError):
    """The table asks for a newer reader or writer."""


class LogCorrupted(TableError, OSError):
    """A gap or a malformed file in the log."""
