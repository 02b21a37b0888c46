"""Strings of chunks, citations and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMMARY = "\nSUMMARY:\n"
MAX_CHARS = 10_000


def location(path: Column, start: Column, end: Column) -> Column:
    """path:start-end"""
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def format_code_summary(code: Column, summary: Column) -> Column:
    return F.concat(F.lit("CODE:\n"), code, F.lit("\n" + SUMMARY), summary)


def truncate_chunk(text: Column, most: int = MAX_CHARS) -> Column:
    """At most `most` characters, plus the separator when code and summary share them by length."""
    parts = F.split(text, SUMMARY, -1)
    code, summary = F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))
    n_code = F.length(code)
    share = F.floor(F.lit(most) * n_code / F.nullif(n_code + F.length(summary), F.lit(0))).cast("int")
    both = F.concat(F.substring(code, F.lit(1), share), F.lit(SUMMARY), F.substring(summary, F.lit(1), F.lit(most) - share))
    return F.when(F.length(text) <= most, text).when(F.size(parts) == 2, both).otherwise(F.substring(text, 1, most))


def citation(path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("\U0001f4c4 "), path, F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")"))


def code_block(title: Column, code: Column, language: str = "python") -> Column:
    """A folded block of markup with a fenced code block inside."""
    return F.concat(F.lit("<details><summary>"), title, F.lit(f"</summary>\n\n```{language}\n"), code, F.lit("\n```\n\n</details>"))


def clean_comment(text: Column) -> Column:
    """A comment's lines without their slashes and stars."""
    lines = F.split(text, "\n", -1)
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^/*\**", ""), r"\**/?$", "")))
    return F.trim(F.array_join(F.filter(bare, lambda x: x != ""), "\n"))


def user_hash(value: Column) -> Column:
    """A stable anonymous id."""
    return F.sha2(value, 256)


def content_hash(content: Column) -> Column:
    """CRC-32 of the bytes as a decimal string."""
    return F.crc32(content.cast("binary")).cast("string")
