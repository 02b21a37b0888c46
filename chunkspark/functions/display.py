"""Rows as a table or as JSON, for terminals."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

FORMATS = ("table", "json")


def shown(rows: DataFrame, form: str = "table", most: int = 1000) -> str:
    """The first `most` rows as text: a feature of terminals, not a cut of the data."""
    if form not in FORMATS:
        raise ValueError(f"no format {form!r}; known: {', '.join(FORMATS)}")
    found = [r.asDict(recursive=True) for r in rows.limit(most).collect()]
    if form == "json":
        return json.dumps(found, indent=2, default=str, ensure_ascii=False)
    cells = [rows.columns, *([str("N/A" if x is None else x) for x in r.values()] for r in found)]
    wide = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip() for r in cells)
