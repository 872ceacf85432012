"""Loosely typed JSON values (VARIANT): truthiness, fallbacks, text and timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.bind import let
from tidemark.functions.timestamps import from_epoch, parse_iso

_FALSY = r'^(?:null|""|false|\[\]|\{\}|-?0+(?:\.0*)?(?:[eE][+-]?\d+)?)$'


def parse(body: Column) -> Column:
    return F.try_parse_json(body)


def field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a numeric type name; null when absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_null(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def is_kind(value: Column, name: str) -> Column:
    return F.coalesce(kind(value) == name, F.lit(False))


def truthy(value: Column) -> Column:
    """False for missing, null, empty text, zero, false, and empty lists and objects."""
    return value.isNotNull() & ~F.to_json(value).rlike(_FALSY)


def first_truthy(*values: Column) -> Column:
    """The first truthy value, else the last one as it is."""
    return F.coalesce(*[F.when(truthy(v), v) for v in values[:-1]], values[-1])


def string(value: Column) -> Column:
    """The value when it is text, else null."""
    return F.when(is_kind(value, "STRING"), F.try_variant_get(value, "$", "string"))


def to_text(value: Column) -> Column:
    """Any non-null value as text; lists and objects as JSON."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(~is_null(value), F.when(is_kind(value, "BOOLEAN"), F.initcap(text)).otherwise(text))


def text_or(value: Column, default) -> Column:
    """Text of a truthy value, else the default."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(truthy(value), to_text(value)).otherwise(fallback)


def elements(value: Column) -> Column:
    """Array elements; null unless the value is a list."""
    return F.try_variant_get(value, "$", "array<variant>")


def objects(value: Column) -> Column:
    """Those array elements that are objects."""
    return F.filter(elements(value), lambda v: is_kind(v, "OBJECT"))


def not_text(value: Column) -> Column:
    """Present, not null, and not a text."""
    return ~is_null(value) & ~is_kind(value, "STRING")


def timestamp(value: Column, unit: str | None = "auto") -> Column:
    """ISO text, or an epoch number when `unit` is given (see from_epoch); else null."""
    return let(value, lambda v: _timestamp(v, unit))


def _timestamp(value: Column, unit: str | None) -> Column:
    iso = F.when(is_kind(value, "STRING"), parse_iso(F.try_variant_get(value, "$", "string")))
    if unit is None:
        return iso
    number = F.when(
        ~is_null(value) & ~kind(value).isin("STRING", "OBJECT", "ARRAY"), F.try_variant_get(value, "$", "double")
    )
    return F.coalesce(iso, from_epoch(number, unit))
