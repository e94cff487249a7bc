"""Canonical JSON and fingerprints.

Keys in code-point order, arrays as stored, no blanks.  An absent optional key and a key holding null differ, so
optional keys are left out of the text when they are NULL, all other NULL fields are written as ``null``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONAL_KEYS = ("province", "eventArrangement")
_JSON_OPTIONS = {"ignoreNullFields": "false"}
# Control characters whose escape holds a hexadecimal letter; the canonical text has them in lower case.
_LETTER_ESCAPES = ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F")


def sort_keys(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of every nested struct in code-point order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda field: field.name)
        ordered = F.struct(*[sort_keys(value[field.name], field.dataType).alias(field.name) for field in fields])
        return F.when(value.isNotNull(), ordered)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(value, lambda item: sort_keys(item, kind.elementType))
    return value


def _lower_escapes(text: Column) -> Column:
    fixed = text
    for code in _LETTER_ESCAPES:
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
    return F.when(F.contains(text, F.lit("\\u00")), fixed).otherwise(text)


def canonical_json(schema: T.StructType, columns: Mapping[str, Column] | None = None,
                   without: Iterable[str] = (), optional: Iterable[str] = OPTIONAL_KEYS) -> Column:
    """Canonical JSON text of a row of the given schema."""
    left_out = set(without)
    may_miss = set(optional)
    fields = sorted((field for field in schema.fields if field.name not in left_out), key=lambda field: field.name)
    value = lambda name: (columns or {}).get(name, F.col(name))

    def text(kept: list[T.StructField]) -> Column:
        return F.to_json(F.struct(*[sort_keys(value(field.name), field.dataType).alias(field.name) for field in kept]), _JSON_OPTIONS)

    def without_nulls(kept: list[T.StructField], open_keys: list[str]) -> Column:
        """One text for each combination of absent optional keys; a row evaluates only its own."""
        if not open_keys:
            return text(kept)
        name, rest = open_keys[0], open_keys[1:]
        absent = without_nulls([field for field in kept if field.name != name], rest)
        return F.when(value(name).isNull(), absent).otherwise(without_nulls(kept, rest))

    return _lower_escapes(without_nulls(fields, [field.name for field in fields if field.name in may_miss]))


def publication_fingerprint(schema: T.StructType) -> Column:
    """SHA-256 of a row as published: without ``verifiedAt`` and with a collapsed description."""
    from tidemark.functions.text import collapse_spaces

    collapsed = {"description": collapse_spaces(F.col("description"))}
    return F.sha2(canonical_json(schema, columns=collapsed, without=("verifiedAt",)), 256)
