"""Chunkers: from the source of one file to its declarations."""

from __future__ import annotations

from chunkspark.chunkers.braces import cpp_chunks, csharp_chunks, typescript_chunks
from chunkspark.chunkers.python import python_chunks
from chunkspark.chunkers.unity import unity_chunks
from chunkspark.sources.domains import Registry

CHUNKERS = Registry("chunker")
for _name, _chunker in (("python", python_chunks), ("cpp", cpp_chunks), ("typescript", typescript_chunks), ("csharp", csharp_chunks), ("unity_asset", unity_chunks)):
    CHUNKERS.register(_name)(_chunker)
