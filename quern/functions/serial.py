"""Rows as JSON text and back, with their types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Times are written with all their digits.
OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def to_text(row: Column) -> Column:
    """A struct, list or map as JSON; nulls are kept."""
    return F.to_json(row, OPTIONS)


def from_text(text: Column, schema) -> Column:
    """The value that a JSON text holds, read by a schema; null if it isn't of that form."""
    return F.from_json(text, schema, OPTIONS)


def roundtrip(data: DataFrame, column: str) -> DataFrame:
    return data.withColumn(column, from_text(to_text(F.col(column)), data.schema[column].dataType))


def variant(text: Column) -> Column:
    """JSON text of any form as one typed value, numbers, texts, lists and objects mixed; null if it isn't JSON."""
    return F.try_parse_json(text)


def at(value: Column, path: str, kind: str) -> Column:
    """What stands at a path, as a type; null if nothing of that type stands there."""
    return F.try_variant_get(value, path, kind)


def kind_of(value: Column) -> Column:
    """The type that a value has in itself."""
    return F.schema_of_variant(value)
