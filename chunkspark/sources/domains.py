"""Domains from YAML files, and registries of their types."""

from __future__ import annotations

from dataclasses import fields
from importlib.metadata import entry_points
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkspark.config import DomainConfig, SearchConfig
from chunkspark.schema import DOMAIN


def discover_domains(folder: str) -> dict[str, DomainConfig]:
    """Enabled domains of the *.yaml files in `folder`, in order of name; of one id the last file wins."""
    import yaml

    out: dict[str, DomainConfig] = {}
    for path in sorted(Path(folder).glob("*.yaml")):
        raw = yaml.safe_load(path.read_text()) or {}
        if not isinstance(raw, dict) or "domain_type" not in raw or "domain_data" not in raw:
            raise ValueError(f"{path.name}: domain_type and domain_data are needed")
        if not raw.get("enabled", True):
            continue
        data = raw["domain_data"]
        known = {f.name for f in fields(SearchConfig)}
        search = SearchConfig(**{k: v for k, v in (raw.get("search_config") or {}).items() if k in known})
        out[data["id"]] = DomainConfig(data["id"], data["name"], raw["domain_type"], True, data.get("meta") or {}, raw.get("mixins") or {}, raw.get("processor_config") or {}, search)
    return out


def domains_frame(spark: SparkSession, domains: dict[str, DomainConfig]) -> DataFrame:
    import json

    return spark.createDataFrame([(d.id, d.name, d.domain_type, json.dumps(d.meta)) for d in domains.values()], DOMAIN)


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the one that comes last in `order`."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


class Registry:
    """Classes or functions by name, for sources, chunkers, indexers and embedders."""

    def __init__(self, what: str):
        self.what, self.known = what, {}

    def register(self, name: str):
        def keep(item):
            self.known[name] = item
            return item

        return keep

    def get(self, name: str):
        if name not in self.known:
            raise KeyError(f"no {self.what} named {name!r}; known: {', '.join(sorted(self.known)) or 'none'}")
        return self.known[name]


def load_plugins(group: str = "chunkspark.plugins") -> list[str]:
    """Call the entry points of a group; returns the names of those that failed."""
    failed = []
    for point in entry_points(group=group):
        try:
            point.load()()
        except Exception:  # a plugin's fault is not the program's  # noqa: BLE001
            failed.append(point.name)
    return failed
