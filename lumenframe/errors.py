"""Classes of Spark errors, by condition and SQL state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException


class Unsupported(NotImplementedError):
    """An operation with no form here; names it."""


@dataclass(frozen=True)
class ErrorClass:
    category: str
    severity: str
    retryable: bool
    retry_delay_ms: int | None


#: Condition prefixes, the more specific first.
_KINDS: list[tuple[str, ErrorClass]] = [
    ("TABLE_OR_VIEW_NOT_FOUND", ErrorClass("catalog", "error", False, None)),
    ("SCHEMA_NOT_FOUND", ErrorClass("catalog", "error", False, None)),
    ("UNRESOLVED", ErrorClass("analysis", "error", False, None)),
    ("PARSE", ErrorClass("parse", "error", False, None)),
    ("DIVIDE_BY_ZERO", ErrorClass("arithmetic", "error", False, None)),
    ("ARITHMETIC_OVERFLOW", ErrorClass("arithmetic", "error", False, None)),
    ("CAST", ErrorClass("conversion", "error", False, None)),
    ("CONCURRENT", ErrorClass("concurrency", "warning", True, 1000)),
    ("FAILED_READ_FILE", ErrorClass("storage", "error", True, 2000)),
    ("PATH_", ErrorClass("storage", "error", False, None)),
    ("OUT_OF_MEMORY", ErrorClass("resources", "critical", True, 30000)),
    ("INTERNAL_ERROR", ErrorClass("internal", "critical", False, None)),
    ("UNSUPPORTED", ErrorClass("unsupported", "error", False, None)),
]


def classify(error: BaseException) -> ErrorClass:
    """By error condition, not by words of the message."""
    if isinstance(error, Unsupported):
        return ErrorClass("unsupported", "error", False, None)
    condition = (error.getCondition() or "") if isinstance(error, PySparkException) else ""
    for prefix, kind in _KINDS:
        if condition.startswith(prefix):
            return kind
    if isinstance(error, (ConnectionError, TimeoutError)):
        return ErrorClass("network", "error", True, 1000)
    return ErrorClass("other", "error", False, None)
