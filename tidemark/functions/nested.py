"""Nested JSON helpers: flattening structs to columns and canonical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "__"


def flatten_struct(schema: T.StructType, root: str, prefix: str = "", separator: str = SEPARATOR) -> list[Column]:
    """Columns ``a__b__c`` for every leaf under ``root``; arrays and maps become canonical JSON text."""
    out: list[Column] = []
    for field in schema.fields:
        path, name = f"{root}.`{field.name}`", f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            out += flatten_struct(field.dataType, path, f"{name}{separator}", separator)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            out.append(F.to_json(F.col(path)).alias(name))
        else:
            out.append(F.col(path).alias(name))
    return out


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys; NULL for text that is not JSON."""
    return F.to_json(F.try_parse_json(text))


def json_digest(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)
