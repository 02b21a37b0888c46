"""What chunkers yield."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass
class Metadata:
    visibility: str | None = None
    is_static: bool = False
    is_abstract: bool = False
    is_template: bool = False
    namespace: str | None = None
    language_specific: dict[str, str] = field(default_factory=dict)


@dataclass
class Chunk:
    """A declaration. Lines count from 0, both ends included."""

    language: str
    type: str
    name: str
    content: str
    start_line: int
    end_line: int
    docstring: str | None = None
    metadata: Metadata = field(default_factory=Metadata)

    def row(self, asset_id: str, ordinal: int, path: str, shares_lines: bool = False) -> dict:
        return {
            "asset_id": asset_id, "ordinal": ordinal, "shares_lines": shares_lines, "language": self.language, "type": self.type, "name": self.name,
            "content": self.content, "docstring": self.docstring,
            "location": {"file_path": path, "start_line": self.start_line, "end_line": self.end_line},
            "metadata": asdict(self.metadata),
        }
