"""Identifiers and hashes, as columns and on the driver: 32 lower-case hexadecimal digits each."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgumentError


def stream_id(database: Column | str, branch: Column | str, name: Column | str) -> Column:
    return F.substring(
        F.sha2(F.concat_ws("\0", *(x if isinstance(x, Column) else F.lit(x) for x in (database, branch, name))), 256),
        1, 32,
    )


def stream_id_of(database: str, branch: str, name: str) -> str:
    return hashlib.sha256("\0".join((database, branch, name)).encode()).hexdigest()[:32]


def partition_of(stream: Column, count: int) -> Column:
    """The first eight bytes of a stream id as an unsigned little-endian number, modulo count; never to be changed."""
    head = F.concat(*(F.substring(stream, 2 * i + 1, 2) for i in reversed(range(8))))
    return F.pmod(F.conv(head, 16, 10).cast("decimal(20,0)"), F.lit(count).cast("decimal(20,0)")).cast("int")


def partition_of_id(stream: str, count: int) -> int:
    return int.from_bytes(bytes.fromhex(stream[:16]), "little") % count


def new_id() -> str:
    return uuid.uuid4().hex


def import_id(source: str, offset: int) -> str:
    """The same id for the same record at each run of an import."""
    return hashlib.sha256(f"{source}\0{offset}".encode()).hexdigest()[:32]


def import_id_of(source: str, offset: Column) -> Column:
    """import_id as a column."""
    return F.substring(F.sha2(F.concat(F.lit(f"{source}\0"), offset.cast("string")), 256), 1, 32)


def parse_id(value: object) -> str:
    if not isinstance(value, str) or not re.fullmatch("[0-9a-fA-F]{32}", value):
        raise InvalidArgumentError("an id is 32 hexadecimal digits")
    return value.lower()


def fingerprint(*parts: object) -> str:
    """Equality key of content on the driver."""
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def event_fingerprint(event_type: str, version: str, metadata: str, payload: str) -> Column:
    """Equality key of events, as a column."""
    return F.sha2(
        F.concat_ws("\0", F.col(event_type), F.col(version).cast("string"), F.to_json(F.col(metadata)), F.col(payload)),
        256,
    )


def content_of(event_type: str, version: int, codec: str, metadata: dict[str, bytes], payload: bytes) -> str:
    """Equality key of an event's content: the same as content_column, on the driver."""
    held = ",".join(sorted(f"{k}={v.hex()}" for k, v in metadata.items()))
    return hashlib.sha256("\0".join((event_type, str(version), codec, held, payload.hex())).encode()).hexdigest()


def content_column() -> Column:
    """Equality key of an event's content, from the log's columns."""
    entries = F.array_sort(
        F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), F.lower(F.hex(e["value"]))))
    )
    held = F.coalesce(F.array_join(entries, ","), F.lit(""))
    return F.sha2(
        F.concat_ws(
            "\0", "event_type", F.col("schema_version").cast("string"), "codec", held, F.lower(F.hex("payload")),
        ),
        256,
    )


def millis(nanos: Column) -> Column:
    """Whole milliseconds; negative times clamp to 0."""
    whole = F.greatest(nanos, F.lit(0))
    return ((whole - F.pmod(whole, F.lit(1_000_000))) / 1_000_000).cast("long")
