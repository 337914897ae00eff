"""Typed access to top-level fields of JSON bodies; a missing field, a JSON null and the string "null" are three things."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(field: str) -> str:
    return "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']"


def parsed(body: Column) -> Column:
    """The body as a variant; null for what is no JSON."""
    return F.try_parse_json(body)


def value(variant: Column, field: str) -> Column:
    return F.try_variant_get(variant, _path(field), "variant")


def is_string(variant: Column, field: str) -> Column:
    return F.coalesce(F.schema_of_variant(value(variant, field)) == "STRING", F.lit(False))


def text(variant: Column, field: str) -> Column:
    return F.try_variant_get(variant, _path(field), "string")


def equals(variant: Column, field: str, expected: object) -> Column:
    """Typed equality of a field: 1 is not "1"; a missing field equals nothing, not even null."""
    got = value(variant, field)
    if expected is None:
        return F.coalesce(F.is_variant_null(got), F.lit(False))
    other = F.parse_json(F.lit(json.dumps(expected)))
    same_kind = F.when(got.isNull() | F.is_variant_null(got), False).otherwise(
        F.regexp_replace(F.schema_of_variant(got), r"\(.*", "") == F.regexp_replace(
            F.schema_of_variant(other), r"\(.*", "",
        )
    )
    return F.coalesce(same_kind & (F.to_json(got) == F.to_json(other)), F.lit(False))


def index_key(variant: Column, field: str) -> Column:
    """A string's own characters, or any other value's JSON text (so "1" and 1 collide); null for a missing field."""
    got = value(variant, field)
    return F.when(got.isNull(), F.lit(None).cast("string")).when(F.is_variant_null(got), F.lit("null")).when(
        F.schema_of_variant(got) == "STRING", text(variant, field),
    ).otherwise(F.to_json(got))


def index_key_of(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(
        value, separators=(",", ":"), sort_keys=True, ensure_ascii=False,
    )
