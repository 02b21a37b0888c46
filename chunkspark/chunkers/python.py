"""Python: classes and functions at the top level of a module."""

from __future__ import annotations

import ast
import warnings

from chunkspark.chunkers.base import Chunk


def _docstring(node: ast.AST, lines: list[bytes]) -> str | None:
    """The source, with quotes, of the first statement of the body that is a string, wherever it stands."""
    for statement in node.body:
        if isinstance(statement, ast.Expr) and isinstance(statement.value, ast.Constant) and isinstance(statement.value.value, str):
            return _source(statement.lineno, statement.col_offset, statement.end_lineno, statement.end_col_offset, lines)
    return None


def _source(line: int, column: int, end_line: int, end_column: int, lines: list[bytes]) -> str:
    """Source between two places; columns are in bytes, as `ast` has them."""
    own = lines[line - 1 : end_line]
    own = [*own[:-1], own[-1][:end_column]]
    own[0] = own[0][column:]
    return b"\n".join(own).decode("utf-8", "replace")


def python_chunks(source: str) -> list[Chunk]:
    """Chunks of a module; none if it has a syntax error. A decorated one begins at its first decorator."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = [x.rstrip(b"\r") for x in source.encode().split(b"\n")]
    out = []
    for node in tree.body:
        if not isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            continue
        line, column = node.lineno, node.col_offset
        if node.decorator_list:
            line = node.decorator_list[0].lineno
            column = lines[line - 1].find(b"@")
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        out.append(Chunk("python", kind, node.name, _source(line, column, node.end_lineno, node.end_col_offset, lines), line - 1, node.end_lineno - 1, _docstring(node, lines)))
    return out
