"""Bytes as text: base64 and hexadecimal digits, on the driver and as columns."""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CodecError


def to_base64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def from_base64(text: str) -> bytes:
    try:
        return base64.b64decode(text, validate=True)
    except ValueError as e:
        raise CodecError(f"no base64: {e}") from None


def to_hex(data: bytes) -> str:
    return data.hex()


def from_hex(text: str) -> bytes:
    try:
        return bytes.fromhex(text)
    except ValueError as e:
        raise CodecError(f"no hexadecimal digits: {e}") from None


def base64_column(data: Column) -> Column:
    return F.base64(data)


def from_base64_column(text: Column) -> Column:
    """Null for what is no base64."""
    return F.try_to_binary(text, F.lit("base64"))


def hex_column(data: Column) -> Column:
    """Lower-case digits."""
    return F.lower(F.hex(data))


def from_hex_column(text: Column) -> Column:
    """Null for what are no hexadecimal digits."""
    return F.unhex(text)
