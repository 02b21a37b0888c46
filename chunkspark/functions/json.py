"""JSON columns. Bad or empty JSON reads as an empty object unless `strict`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(text: Column, strict: bool = False) -> Column:
    if strict:
        return F.parse_json(text)
    return F.coalesce(F.try_parse_json(F.nullif(text, F.lit(""))), F.parse_json(F.lit("{}")))


def encode(value: Column) -> Column:
    return F.to_json(value)


def field(text: Column, path: str, kind: str = "string", strict: bool = False) -> Column:
    """The value at a path such as $.k, null where it is missing or of another kind."""
    return F.try_variant_get(decode(text, strict), path, kind)


def elements(text: Column, path: str = "$.graph.elements") -> Column:
    """Elements of the array at `path` as variants; none where it is missing."""
    found = F.try_variant_get(decode(text), path, "array<variant>")
    return F.coalesce(found, F.array().cast("array<variant>"))


def content_of(metadata: Column, document: Column, name: str = "content") -> Column:
    """A field of the metadata if it has one, else the document."""
    return F.coalesce(field(metadata, f"$.{name}"), document)
