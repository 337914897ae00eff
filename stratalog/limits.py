"""Limits of names, batches and pages; fixed values of the format."""

from __future__ import annotations

from .errors import InvalidArgumentError, ResourceLimitError

STREAM_NAME_BYTES = 1024
BRANCH_NAME_BYTES = 255
IDEMPOTENCY_KEY_BYTES = 1024
CONSUMER_ID_BYTES = 1024
EVENT_TYPE_BYTES = 1024
METADATA_ENTRIES = 256
METADATA_KEY_BYTES = 1024
METADATA_VALUE_BYTES = 64 << 10
BATCH_EVENTS = 4096
PAYLOAD_BYTES = 8 << 20
BATCH_BYTES = 16 << 20
PAGE_EVENTS = 4096
PAGE_BYTES = 16 << 20
LINEAGE_NODES = 64
PARTITIONS = 4096
BOOTSTRAP_BYTES = 8 << 20
RESERVED_PREFIX = "stratalog."


def within(what: str, actual: int, maximum: int) -> None:
    if actual > maximum:
        raise ResourceLimitError(f"{what} is {actual}, maximum is {maximum}")


def name(what: str, value: str, maximum: int) -> str:
    if not isinstance(value, str) or not value or "\0" in value:
        raise InvalidArgumentError(f"{what} must be a non-empty string without NUL")
    if len(value.encode()) > maximum:
        raise InvalidArgumentError(f"{what} is longer than {maximum} bytes")
    return value


def span(what: str, value: int, maximum: int, minimum: int = 1) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not minimum <= value <= maximum:
        raise InvalidArgumentError(f"{what} must be between {minimum} and {maximum}")
    return value
