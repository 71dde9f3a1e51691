"""DB-API errors, how Spark's errors map to them, and retries with growing delays."""

from __future__ import annotations

import functools
import random
import time
from collections.abc import Callable


class Warning(Exception):  # noqa: A001, N818
    pass


class Error(Exception):
    pass


class InterfaceError(Error):
    pass


class DatabaseError(Error):
    pass


class DataError(DatabaseError):
    pass


class OperationalError(DatabaseError):
    pass


class IntegrityError(DatabaseError):
    pass


class InternalError(DatabaseError):
    pass


class ProgrammingError(DatabaseError):
    pass


class NotSupportedError(DatabaseError):
    pass


class QueryError(DatabaseError):
    """A statement failed: name, message, type (USER_ERROR, EXTERNAL, INTERNAL_ERROR) and (line, column) where known."""

    kind = "INTERNAL_ERROR"

    def __init__(self, message: str, name: str = "", location: tuple[int, int] | None = None):
        super().__init__(message)
        self.message, self.error_name, self.error_type, self.error_location = message, name, self.kind, location


class UserError(QueryError, ProgrammingError):
    kind = "USER_ERROR"


class ExternalError(QueryError, OperationalError):
    kind = "EXTERNAL"


def from_spark(error: Exception) -> QueryError:
    """The error of a statement: faults of its text are the user's, those of reading and writing external."""
    import re

    name = getattr(error, "getCondition", lambda: None)() or type(error).__name__
    text = str(error)
    at = re.search(r"line (\d+),? pos(?:ition)? (\d+)", text)
    location = (int(at[1]), int(at[2]) + 1) if at else None
    kinds = {c.__name__ for c in type(error).__mro__}
    if kinds & {"AnalysisException", "ParseException", "IllegalArgumentException", "ArithmeticException", "NumberFormatException", "DateTimeException"}:
        return UserError(text, name, location)
    if re.search(r"FileNotFound|PATH_NOT_FOUND|IOException|FAILED_READ_FILE|Connection", text):
        return ExternalError(text, name, location)
    return QueryError(text, name, location)


class Delays:
    """Delays before further attempts: base times 2 to the attempt, times a random share, at most `most`."""

    def __init__(self, base: float = 0.1, most: float = 2.0, jitter: bool = True):
        self.base, self.most, self.jitter = base, most, jitter

    def __call__(self, attempt: int) -> float:
        return min(self.most, self.base * 2**attempt * (random.random() if self.jitter else 1.0))


def retry(errors: tuple[type[Exception], ...], attempts: int = 3, delays: Callable[[int], float] | None = None, when: Callable[[object], bool] | None = None, sleep=time.sleep):
    """Decorator: call again after one of the errors, or while `when` holds for the result; the last failure is raised or returned."""
    wait = delays or Delays()

    def wrap(call):
        @functools.wraps(call)
        def run(*args, **kwargs):
            for attempt in range(1, attempts + 1):
                try:
                    out = call(*args, **kwargs)
                    if when is None or not when(out) or attempt == attempts:
                        return out
                except errors:
                    if attempt == attempts:
                        raise
                sleep(wait(attempt))

        return run

    return wrap
