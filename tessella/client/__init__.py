"""DB-API 2.0 over a SparkSession."""

from tessella.client.dbapi import (
    BINARY, DATETIME, NUMBER, ROWID, STRING, Binary, Connection, Cursor, Date, DateFromTicks, IsolationLevel, Time, TimeFromTicks, Timestamp,
    TimestampFromTicks, apilevel, connect, paramstyle, threadsafety,
)
from tessella.client.errors import (
    DatabaseError, DataError, Error, ExternalError, IntegrityError, InterfaceError, InternalError, NotSupportedError, OperationalError, ProgrammingError,
    QueryError, UserError, Warning,
)

__all__ = [
    "BINARY", "DATETIME", "NUMBER", "ROWID", "STRING", "Binary", "Connection", "Cursor", "DataError", "DatabaseError", "Date", "DateFromTicks", "Error",
    "ExternalError", "IntegrityError", "InterfaceError", "InternalError", "IsolationLevel", "NotSupportedError", "OperationalError", "ProgrammingError",
    "QueryError", "Time", "TimeFromTicks", "Timestamp", "TimestampFromTicks", "UserError", "Warning", "apilevel", "connect", "paramstyle", "threadsafety",
]
