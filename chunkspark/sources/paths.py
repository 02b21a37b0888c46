"""Which files are read, and by which chunker."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkspark.config import LanguageConfig, PathPatterns, default_languages

#: Folders whose verdict by ignore rules a task remembers.
FOLDERS = 100_000


def java_pattern(glob: str) -> str:
    """A regular expression for a shell pattern whose stars also cross slashes."""
    return fnmatch.translate(glob).replace("\\Z", "\\z")


def _any(path: Column, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (path.rlike("^" + java_pattern(g)) for g in globs), F.lit(False))


def wanted(path: Column, patterns: PathPatterns | None = None) -> Column:
    """Excludes go first, then any include admits; a path that matches neither is out."""
    p = patterns or PathPatterns()
    return ~_any(path, p.exclude) & _any(path, p.include)


def suffix(path: Column) -> Column:
    """The last dot and what follows, of the last part of the path; empty where it has none."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1)


def language_of(path: Column, languages: list[LanguageConfig] | None = None) -> Column:
    """The first enabled language that lists the suffix, null if none does."""
    out = F.lit(None).cast("string")
    for c in reversed(default_languages() if languages is None else languages):
        if c.enabled:
            own = suffix(path) if c.case_sensitive else F.lower(suffix(path))
            out = F.when(own.isin(*c.suffixes), c.name).otherwise(out)
    return out


def small_enough(language: Column, n_bytes: Column, languages: list[LanguageConfig] | None = None) -> Column:
    """Files of exactly the limit pass; a language without a limit takes any size."""
    out = F.lit(True)
    for c in default_languages() if languages is None else languages:
        if c.max_file_size is not None:
            out = F.when(language == c.name, n_bytes <= c.max_file_size).otherwise(out)
    return out


def ignore_pattern(rule: str, folder: str = "") -> tuple[str, bool]:
    """(regular expression, whether it takes back earlier rules) of an ignore rule in a folder.

    The expression matches a path below the root that the rule names; folders end with a slash.
    """
    keep = rule.startswith("!")
    rule = rule[1:] if keep else rule
    rule = rule[1:] if rule.startswith(("\\#", "\\!")) else rule
    folders_only = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.lstrip("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and (end := rule.find("]", i + 2)) > 0:
            inside = rule[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + "(?!/)[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        else:
            if rule[i] == "\\" and i + 1 < len(rule):
                i += 1
            out, i = out + ("\\" + rule[i] if not rule[i].isalnum() and rule[i] not in "_/-" else rule[i]), i + 1
    base = "".join("\\" + c if not c.isalnum() and c not in "_/-" else c for c in folder) + "/" if folder else ""
    return f"^{base}{'' if anchored else '(?:.*/)?'}{out}{'/' if folders_only else '/?'}$", keep


def _judge(rules: list[tuple[str, str]]) -> Callable[[str], bool]:
    """Whether rules drop a path. Those of a folder are asked only of what lies below it, and each folder is judged once."""
    of_folder: dict[str, list[tuple[int, re.Pattern, bool]]] = {}
    for i, (folder, rule) in enumerate(rules):
        rule = rule.strip()
        if rule and not rule.startswith("#"):
            pattern, keep = ignore_pattern(rule, folder)
            of_folder.setdefault(folder, []).append((i, re.compile(pattern), keep))

    def names(entry: str, above: list[str]) -> bool:
        last, drop = -1, False
        for folder in above:
            for i, pattern, keep in reversed(of_folder.get(folder, ())):
                if i < last:
                    break
                if pattern.fullmatch(entry):
                    last, drop = i, not keep
                    break
        return drop

    known: dict[str, bool] = {}

    def drops(path: str) -> bool:
        parts = path.split("/")
        above = ["", *("/".join(parts[:i]) for i in range(1, len(parts)))]
        for i, folder in enumerate(above[1:], 1):
            if folder not in known:
                if len(known) >= FOLDERS:
                    known.clear()
                known[folder] = names(folder + "/", above[:i])
            if known[folder]:
                return True
        return names(path, above)

    return drops


def ignored(path: Column, rules: list) -> Column:
    """Whether ignore rules drop a path relative to the root. A rule is a line, or (folder, line).

    Of the rules that name a file or folder the last one counts. What lies below an ignored folder
    is ignored, whatever rules say of it. Rules are matched in Arrow batches, so that the plan
    doesn't grow with them.
    """
    if not rules:
        return F.lit(False)
    pairs = [("", r) if isinstance(r, str) else tuple(r) for r in rules]

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        drops = _judge(pairs)
        for paths in batches:
            yield pd.Series([None if p is None else drops(p) for p in paths], dtype=object, index=paths.index)

    return run(path)
