"""C++, TypeScript and C#: declarations found by a scanner of comments, strings and brackets.

There is no grammar here. The scanner blanks out comments and strings, keeping lengths, and the
chunkers look for declarations in what is left, level by level, through namespaces and through
every other construct with a body. Below a declaration nothing is searched, so methods stay part
of their class.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from chunkspark.chunkers.base import Chunk, Metadata

OPEN, CLOSE = "([{", ")]}"
_BRACKET = re.compile(r"[()\[\]{}]")


@dataclass
class Comment:
    start: int
    end: int
    text: str


class Source:
    """A file's text, the same with comments and strings blanked, and its comments."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.comments: list[Comment] = []
        self._paired: str | None = None  # the code whose brackets are in _closing
        self._closing: dict[int, int] = {}
        self.code = self._blank()
        self.line_starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        return bisect_right(self.line_starts, at) - 1

    def column(self, at: int) -> int:
        return at - self.line_starts[self.line(at)]

    def _blank(self) -> str:
        text, n = self.text, len(self.text)
        out = list(text)

        def wipe(a: int, b: int) -> None:
            for i in range(a, min(b, n)):
                if out[i] != "\n":
                    out[i] = " "

        i, last = 0, ""
        while i < n:
            c = text[i]
            two = text[i : i + 2]
            if two in ("//", "/*"):
                end = text.find("\n", i) if two == "//" else text.find("*/", i + 2) + 2
                end = n if end < (0 if two == "//" else 2) else end
                self.comments.append(Comment(i, end, text[i:end]))
                wipe(i, end)
                i = end
                continue
            if self.language == "cpp" and (raw := re.compile(r'R"([^()\\ ]{0,16})\(').match(text, i)):
                end = text.find(f"){raw[1]}\"", raw.end())
                end = n if end < 0 else end + len(raw[1]) + 2
                wipe(i, end)
                i = end
                continue
            if self.language == "csharp" and (m := re.compile(r'"""+|[@$]+"').match(text, i)):
                i = self._long_string(i, m[0], wipe)
                last = '"'
                continue
            if c in "\"'" or (c == "`" and self.language == "typescript"):
                if c == "'" and last.isalnum() and self.language == "cpp":  # 1'000
                    i += 1
                    continue
                end = self._string_end(i, c)
                wipe(i, end)
                i, last = end, c
                continue
            if c == "/" and self.language == "typescript" and (last in "(,=:[!&|?{};>" or re.search(r"\b(?:return|typeof|case|in|of)\s*$", text[max(0, i - 12) : i])) and (m := re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/").match(text, i)):
                wipe(i, m.end())
                i, last = m.end(), "/"
                continue
            if not c.isspace():
                last = c
            i += 1
        return "".join(out)

    def _string_end(self, at: int, quote: str) -> int:
        text, i = self.text, at + 1
        while i < len(text):
            if text[i] == "\\":
                i += 2
            elif quote == "`" and text.startswith("${", i):
                depth, i = 1, i + 2
                while i < len(text) and depth:
                    if text[i] in "\"'`":
                        i = self._string_end(i, text[i])
                        continue
                    depth += {"{": 1, "}": -1}.get(text[i], 0)
                    i += 1
            elif text[i] == quote or (text[i] == "\n" and quote != "`"):
                return i + (text[i] == quote)
            else:
                i += 1
        return len(text)

    def _long_string(self, at: int, mark: str, wipe) -> int:
        """Verbatim, interpolated and raw strings; holes of interpolated ones are wiped with them."""
        text = self.text
        i = at + len(mark)
        if mark.startswith('"""'):
            end = text.find(mark, i)
            end = len(text) if end < 0 else end + len(mark)
        elif "@" in mark:
            while True:
                i = text.find('"', i)
                if i < 0 or not text.startswith('""', i):
                    break
                i += 2
            end = len(text) if i < 0 else i + 1
        else:
            end = self._string_end(i - 1, '"')
        wipe(at, end)
        return end

    def closing(self, at: int) -> int:
        """Place after the bracket that closes the one at `at`; the end of the text if none does."""
        if self._paired is not self.code:
            self._paired, self._closing, opened = self.code, {}, []
            for m in _BRACKET.finditer(self.code):
                if m[0] in OPEN:
                    opened.append(m.start())
                elif opened:
                    self._closing[opened.pop()] = m.end()
        return self._closing.get(at, len(self.code))

    def statement_end(self, at: int, stop: int) -> tuple[int, int]:
        """(end, place of the body's brace or -1) of what begins at `at`: up to ; or a closed brace."""
        i = at
        while i < stop:
            c = self.code[i]
            if c in "([":
                i = self.closing(i)
            elif c == "{":
                return self.closing(i), i
            elif c == ";":
                return i + 1, -1
            elif c == "}":
                return i, -1
            else:
                i += 1
        return stop, -1

    def before(self, at: int, skip: str) -> list[Comment]:
        """Comments that precede `at` with nothing between but space and what matches `skip`, last first."""
        out: list[Comment] = []
        between = re.compile(skip)
        for i in range(bisect_right(self.comments, at, key=lambda c: c.end) - 1, -1, -1):
            c = self.comments[i]
            if not between.fullmatch(self.code, c.end, out[-1].start if out else at):
                break
            out.append(c)
        return out

    def chunk(self, kind: str, name: str, start: int, end: int, doc: str | None, meta: Metadata, lines_from: int | None = None) -> Chunk:
        first = start if lines_from is None else lines_from
        return Chunk(self.language, kind, name, self.text[start:end], self.line(first), self.line(max(first, end - 1)), doc or None, meta)


def _bare(comment: str) -> str:
    """A comment's lines without slashes and stars."""
    body = re.sub(r"^/\*+|\*+/$", "", comment.strip())
    return "\n".join(x for x in (re.sub(r"^\s*(?:///*|\*+)?\s?", "", line).rstrip() for line in body.split("\n")) if x.strip()).strip()


_SPACE = r"\s*"
#: Each step takes what it can and never gives back, so that a search fails in one pass.
_CPP_SKIP = r"(?:[\s;]++|#\s*+include[^\n]*+|(?:[\w:<>,*&]|(?<= ))[^;{}()\n]*+;)*+"
_CPP_SCOPE = re.compile(r"(?:inline\s+)?namespace\s*([\w:]*)\s*(?:\[\[.*?\]\]\s*)?\{|extern\s+\{")
_CPP_CLASS = re.compile(r"(?:class|struct)\b(?:\s+(?:\[\[.*?\]\]|alignas\s*\([^)]*\)|__declspec\s*\([^)]*\)|__attribute__\s*\(\(.*?\)\)|[A-Z][A-Z0-9_]+(?=\s+[\w:]+\s*[:{<f])))*\s+([\w:]+)(?:\s*<[^{};]*>)?\s*(?:final\s*)?(?::[^{};]*)?(?=\{)")
#: A class that is declared ahead, or named as the type of what follows.
_CPP_AHEAD = re.compile(r"(?:(?:static|extern|const|typedef)\s+)*(?:class|struct)\s+([\w:]+)\s*(?=[;*&=\w,()])")
_CPP_FUNCTION = re.compile(r"(?:^|(?<=[\s*&>]))((?:[\w~]+(?:<[^<>;{}()]*>)?::)*(?:operator\s*(?:\(\)|\[\]|[^\s\w(]+|\w+)|~?\w+))\s*(?=\()")
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "sizeof", "alignas", "decltype", "noexcept", "__declspec", "__attribute__", "throw", "requires", "else", "do", "new", "delete", "static_assert", "defined"}


def cpp_chunks(source: str) -> list[Chunk]:
    """Classes, structs (declared ahead ones, too) and function definitions, at any depth outside of one another.

    What a syntax error leaves is kept.
    """
    src = Source(source, "cpp")
    code = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", lambda m: re.sub(r"[^\n]", " ", m[0]), src.code)
    src.code, whole = code, src.code
    out: list[Chunk] = []

    def doc(at: int) -> str:
        src.code = whole
        found = src.before(at, _CPP_SKIP)
        src.code = code
        return "\n".join(_bare(c.text) for c in reversed(found))

    levels: list[tuple[int, int, list[str]]] = [(0, len(code), [])]
    while levels:
        at, stop, scope = levels.pop()
        while at < stop:
            if code[at].isspace() or code[at] in ";}":
                at += 1
                continue
            if m := _CPP_SCOPE.match(code, at):
                end = src.closing(m.end() - 1)
                levels.append((end, stop, scope))
                at, stop, scope = m.end(), end - 1, [*scope, *([m[1]] if m[1] else [])]
                continue
            start, template, inner = at, False, None
            while m := re.compile(r"template\s*(?=<)").match(code, at):
                template, at = True, _angle(code, m.end())
                at += len(code[at:]) - len(code[at:].lstrip())
            end, brace = src.statement_end(at, stop)
            meta = Metadata(is_template=template, namespace="::".join(scope) or None)
            head = code[at:brace] if brace >= 0 else ""
            if brace >= 0 and (m := re.compile(r"(?:(?:typedef|static|const|constexpr|inline|friend)\s+)*").match(code, at)) and (c := _CPP_CLASS.match(code, m.end())):
                close = re.compile(r"[^;{}]*;").match(code, end)
                out.append(src.chunk("class", c[1], start, end, doc(start), meta, at))
                end = close.end() if close else end
            elif (c := _CPP_AHEAD.match(code, at)) and brace < 0:
                out.append(src.chunk("class", c[1], start, end if template else c.end(1), doc(start), meta, at))
            elif brace >= 0 and "(" in head and not re.match(r"\s*(?:enum|union)\b", head):
                name = next((m[1] for m in _CPP_FUNCTION.finditer(head) if m[1] not in _NOT_NAMES and not re.fullmatch(r"[A-Z][A-Z0-9_]*_API", m[1])), None)
                while end < stop and (m := re.compile(r"\s*,\s*[\w:]+\s*(?=\{)|\s*(?=\{)").match(code, end)) and ":" in head and code[m.end() : m.end() + 1] == "{":
                    end = src.closing(m.end())  # brace initialisers before the body
                if name and "=" not in re.sub(r"operator[^\w(]+", "", head.split("(")[0]):
                    out.append(src.chunk("function", re.sub(r"\s+", " ", name), start, end, doc(start), meta, at))
                else:
                    inner = brace
            elif brace >= 0:  # unions, initialisers
                inner = brace
            at = max(end, at + 1)
            if inner is not None:
                levels.append((at, stop, scope))
                at, stop = inner + 1, src.closing(inner) - 1
    return out


def _angle(code: str, at: int) -> int:
    """Place after the angle bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(code)):
        if code[i] == "<":
            depth += 1
        elif code[i] == ">":
            depth -= 1
            if depth == 0:
                return i + 1
        elif code[i] in ";{":
            break
    return at + 1


_TS_HEAD = r"(?:(?:export|declare|default)\s+)*"
_TS_SCOPE = re.compile(_TS_HEAD + r"(?:namespace|module)\s+([\w.$]+|\s*)\s*(?=\{)")
_TS_DECLARED = {
    "class": re.compile(r"class\s+([\w$]+)"),
    "interface": re.compile(r"interface\s+([\w$]+)"),
    "type": re.compile(r"type\s+([\w$]+)"),
    "function": re.compile(r"(?:async\s+)?function\b\s*\*?\s*([\w$]*)"),
    "const": re.compile(r"(?:const|let)\s+(?!enum\b)([\w$]+|[\[{])"),
}
_TS_SKIP = r"\s*(?:(?:export|declare|default|async)\s+)*"
_TS_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|override|get|set|accessor)\s+)*\*?\s*(?:[\w$#]+|\[[^\]\n]*\])\s*(?:<[^<>(){};]*>\s*)?(?=\()")
_TS_FOR = re.compile(r"for\s*(?:await\s*)?\(\s*((?:let|const)\s+([\w$]+|[\[{]))")
#: What stands before the brace of a class body, of an object, and of a block that a colon precedes.
_TS_CLASS_BODY = re.compile(r"\bclass\b[^{}();=]*$")
_TS_OBJECT = re.compile(r"(?:[=(,\[?:]|\breturn|\bexport\s+default)\s*$")
_TS_CASE = re.compile(r"(?:\bcase\b[^:;{}]*|\bdefault\s*):\s*$")


def typescript_chunks(source: str) -> list[Chunk]:
    """Classes, interfaces, type aliases, functions, every const or let, and methods of what is none of these, at any depth.

    Abstract classes and var are not listed, but what they contain is. Broken sources give what
    can still be told apart.
    """
    src = Source(source, "typescript")
    code = src.code
    out: list[Chunk] = []

    def doc(at: int) -> str | None:
        for c in src.before(at, _TS_SKIP):
            if c.text.startswith("/**"):
                return _bare(c.text)
        return None

    def unnamed(at: int) -> str:
        return f"anonymous_function_{src.line(at)}_{src.column(at)}"

    def add(kind: str, name: str, begin: int, end: int, scope: list[str], generic: bool = False) -> None:
        meta = Metadata(namespace=".".join(scope) or None)
        if generic:
            meta.language_specific["is_generic"] = "true"
        out.append(src.chunk(kind, name, begin, end, doc(begin), meta))

    def bound(m: re.Match, group: int) -> str:
        """The name that a const binds; a pattern is its own name."""
        name = m[group]
        return src.text[m.start(group) : src.closing(m.start(group))] if name in "[{" else name

    def within(at: int, stop: int, scope: list[str]) -> None:
        """All that has braces in a construct that is no chunk."""
        i = at
        while i < stop:
            if (m := _TS_FOR.match(code, i)) and not (i and (code[i - 1].isalnum() or code[i - 1] in "_$.")):
                close = src.closing(code.index("(", i))
                semicolon = code.find(";", m.end(), close)
                if semicolon > 0:
                    add("const", bound(m, 2), m.start(1), semicolon + 1, scope)
                    i = semicolon
                else:
                    i = m.end(1)
            elif code[i] == "{":
                head = code[at:i]
                close = src.closing(i)
                if _TS_CLASS_BODY.search(head):
                    members(i + 1, close - 1, scope)
                elif _TS_OBJECT.search(head if head.strip() else code[max(0, i - 40) : i]) and not _TS_CASE.search(head):
                    members(i + 1, close - 1, scope)
                else:
                    level(i + 1, close - 1, scope)
                i = max(close, i + 1)
            else:
                i += 1

    def members(at: int, stop: int, scope: list[str]) -> None:
        """Methods of a class or an object; what other members contain."""
        while at < stop:
            if code[at].isspace() or code[at] in ";,})]":
                at += 1
                continue
            end = at
            if m := _TS_METHOD.match(code, at):
                end = src.closing(m.end())
                if t := re.compile(r"\s*:\s*[^;{}=,]*(?=\{)|\s*(?=\{)").match(code, end):
                    end = src.closing(t.end())
                    add("function", unnamed(at), at, end, scope)
                    at = end
                    continue
            while end < stop and code[end] not in ";,\n":
                end = src.closing(end) if code[end] in OPEN else end + 1
            within(at, min(end, stop), scope)
            at = max(end, at + 1)

    def level(at: int, stop: int, scope: list[str]) -> None:
        while at < stop:
            if code[at].isspace() or code[at] in ";})],":
                at += 1
                continue
            if m := _TS_SCOPE.match(code, at):
                end = src.closing(m.end())
                level(m.end() + 1, end - 1, [*scope, m[1].strip()])
                at = end
                continue
            while m := re.compile(r"@[\w$.]+").match(code, at):  # decorators
                at = m.end()
                at = src.closing(at) if code[at : at + 1] == "(" else at
                at += len(code[at:]) - len(code[at:].lstrip())
            begin = re.compile(_TS_HEAD).match(code, at).end()
            found = next(((k, m) for k, r in _TS_DECLARED.items() if (m := r.match(code, begin))), None)
            end = _ts_end(src, begin, stop, found[0] if found else "")
            if found:
                kind, m = found
                name = (bound(m, 1) if m[1] else "") or unnamed(begin)
                add(kind, name, begin, end, scope, bool(re.compile(r"\s*<").match(code, m.end())))
            else:
                within(begin, end, scope)
            at = max(end, at + 1)

    level(0, len(code), [])
    return out


def _ts_end(src: Source, at: int, stop: int, kind: str) -> int:
    """End of a statement. Without a semicolon it ends at a line break that nothing carries over."""
    code, i = src.code, at
    body = kind in ("class", "interface", "function")
    while i < stop:
        c = code[i]
        if c in "([{":
            i = src.closing(i)
            if c == "{" and (body or not kind) and not re.compile(r"\s*[|&=]").match(code, i):
                return i
        elif c == ";":
            return i + 1
        elif c == "}":
            return i
        elif c == "\n" and not body and not re.search(r"(?:[=|&?:,+\-*/<(.]|=>)\s*$", code[at:i]) and not re.compile(r"\s*(?:[.|&?:+*/=)\]},]|=>|-(?!-))").match(code, i):
            return i
        else:
            i += 1
    return stop


_CS_SCOPE = re.compile(r"namespace\s+([\w.]+)\s*(?=\{)")
_CS_DECLARED = re.compile(r"(?:\[[^\]]*\]\s*)*((?:(?:public|private|protected|internal|static|abstract|sealed|partial|new|unsafe|readonly|file|ref)\s+)*)(class|interface|record(?:\s+(?:class|struct))?)\s+(@?\w+)")
_CS_KINDS = {"class": "class", "interface": "interface", "record": "class"}


def csharp_chunks(source: str) -> list[Chunk]:
    """Classes, interfaces and records, at any depth outside of one another. Structs and enums are not listed, nor is a file-scoped namespace noted."""
    src = Source(source, "csharp")
    code = re.sub(r"(?m)^[ \t]*#[^\n]*", lambda m: " " * len(m[0]), src.code)
    src.code = code
    out: list[Chunk] = []

    def doc(at: int) -> str | None:
        found = src.before(at, _SPACE)
        return "\n".join(c.text.strip() for c in reversed(found)) or None

    def level(at: int, stop: int, scope: list[str]) -> None:
        while at < stop:
            if code[at].isspace() or code[at] in ";}":
                at += 1
                continue
            if m := _CS_SCOPE.match(code, at):
                end = src.closing(m.end())
                level(m.end() + 1, end - 1, [*scope, m[1]])
                at = end
                continue
            end, brace = src.statement_end(at, stop)
            if m := _CS_DECLARED.match(code, at):
                words = m[1].split()
                kind = m[2].split()[0]
                meta = Metadata(
                    visibility=next((w for w in words if w in ("public", "private", "protected", "internal")), None),
                    is_static="static" in words, is_abstract="abstract" in words, namespace=".".join(scope) or None,
                    language_specific={"kind": kind, **({"partial": "true"} if "partial" in words else {})},
                )
                out.append(src.chunk(_CS_KINDS[kind], m[3].lstrip("@"), at, end, doc(at), meta))
            elif brace >= 0:
                level(brace + 1, end - 1, scope)
            at = max(end, at + 1)

    level(0, len(code), [])
    return out
