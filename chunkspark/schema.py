"""Schemas of the three levels (domain, asset, chunk), of vectors and of search results."""

from __future__ import annotations

from pyspark.sql import types as T


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
DOMAIN = fields(id=_S, name=_S, domain_type=_S, meta=_S)
ASSET = fields(id=_S, domain_id=_S, name=_S, asset_hash=_S, meta=_S)
LOCATION = fields(file_path=_S, start_line=_I, end_line=_I)
CHUNK_META = fields(visibility=_S, is_static=_B, is_abstract=_B, is_template=_B, namespace=_S, language_specific=T.MapType(_S, _S))
#: What a chunker yields for one declaration. Lines count from 0.
CODE_CHUNK = fields(asset_id=_S, ordinal=_I, shares_lines=_B, language=_S, type=_S, name=_S, content=_S, docstring=_S, location=LOCATION, metadata=CHUNK_META)
CHUNK = fields(id=_S, asset_id=_S, domain_id=_S, meta=_S)
VECTOR = fields(id=_S, embedding=T.ArrayType(T.FloatType()), content=_S, doc_metadata=_S)
SEARCH_RESULT = fields(id=_S, document=_S, metadata=_S, score=T.DoubleType())

LANGUAGES = ("python", "cpp", "typescript", "csharp", "unity_asset")
CHUNK_TYPES = ("class", "function", "interface", "type", "const", "graph", "other")


def describe(schema: T.StructType) -> str:
    """The schema as JSON, for API registries."""
    return schema.json()
