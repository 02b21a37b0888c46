"""Unity assets: YAML of several documents whose behaviours may hold a visual-script graph."""

from __future__ import annotations

import json
from functools import cache

from chunkspark.chunkers.base import Chunk, Metadata
from chunkspark.operators.graph import classify, grouped

#: Class codes of objects that have a handler.
GAME_OBJECT, MONO_BEHAVIOUR, INPUT_MANAGER = 1, 114, 13


@cache
def _loader():
    """A safe loader, in C where there is one, that gives a tagged object as (class code, object)."""
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        pass

    def build(loader, suffix, node):
        value = loader.construct_mapping(node, deep=True) if isinstance(node, yaml.MappingNode) else None
        return (suffix.rpartition(":")[2], value)

    Loader.add_multi_constructor("tag:", build)
    return Loader


def _documents(source: str):
    """(class code, object) of each document; tag handles count for the whole file."""
    import yaml

    head = [x for x in source.split("\n") if x.startswith("%")]
    parts: list[list[str]] = []
    for line in source.split("\n"):
        if line.startswith("---"):
            parts.append([line])
        elif parts:
            parts[-1].append(line)
        elif not line.startswith("%") and line.strip():
            parts.append([line])
    for part in parts:
        text = "\n".join([*head, *part] if part[0].startswith("---") else part)
        text = text.replace(" stripped\n", "\n", 1)
        value = yaml.load(text, _loader())  # noqa: S506  a SafeLoader
        yield value if isinstance(value, tuple) else (None, value)


def unity_chunks(source: str) -> list[Chunk]:
    """A chunk per group of graph elements, boxes and links included, its lines the group's place and the next.

    Files that aren't YAML have none.
    """
    import yaml

    out: list[Chunk] = []
    try:
        documents = list(_documents(source))
    except (yaml.YAMLError, ValueError):
        return []
    for code, value in documents:
        if not isinstance(value, dict):
            continue
        for name, body in value.items():
            if code == str(MONO_BEHAVIOUR) or (code is None and name == "MonoBehaviour"):
                out += _graph_chunks(body, len(out))
    return out


def _graph_chunks(body, at: int) -> list[Chunk]:
    data = body.get("_data") if isinstance(body, dict) else None
    text = data.get("_json") if isinstance(data, dict) else None
    if not text:
        return []
    try:
        graph = json.loads(text).get("graph", {})
        found = classify(graph.get("elements", []))
    except (ValueError, AttributeError, TypeError):
        return []
    nodes = list({n["id"]: n for n in found.nodes}.values())  # of one id the last element, in the place of the first
    places = grouped(nodes, found.boxes, found.edges)
    members: dict[int, list[str]] = {}
    for elements, groups in zip((nodes, found.edges, found.boxes), (places[0], places[2], places[1]), strict=True):
        for e, g in zip(elements, groups, strict=True):
            members.setdefault(g, []).append(e["raw_json"])
    return [Chunk("unity_asset", "other", "", "[" + ", ".join(own) + "]", at + i, at + i + 1, None, Metadata()) for i, own in enumerate(members.values())]
