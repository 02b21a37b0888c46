"""Index a domain: scan, compare, chunk, embed, and commit."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from functools import reduce
from urllib.parse import quote, unquote

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from chunkspark import schema
from chunkspark.config import DomainConfig, EmbeddingConfig, LanguageConfig, PathPatterns, default_languages
from chunkspark.operators import store, sync
from chunkspark.operators.segments import LevelOf, Segments, Table
from chunkspark.plans.processors import Processor, create_processor

@dataclass
class Counts:
    found: int
    dirty: int
    deleted: int
    chunks: int


class Level:
    """Assets, chunks or vectors of all domains, or of one."""

    def __init__(self, index: Index, name: str):
        self.index, self.name = index, name

    def read(self, domain_id: str | None = None) -> DataFrame:
        domains = self.index.domain_ids() if domain_id is None else [domain_id]
        parts = [own.read(self.name, own.last()[1]) for own in map(self.index.segments, domains)]
        return reduce(DataFrame.unionByName, parts) if parts else self.index.spark.createDataFrame([], self.index.levels[self.name].schema)


class Index:
    """Domains, assets, chunks and vectors of a state folder.

    Each domain has a log of versions. An entry lists the segments that hold its assets, chunks and
    vectors, so one commit changes all three, and a run writes what it changes.
    """

    def __init__(self, spark: SparkSession, folder: str, config: EmbeddingConfig | None = None):
        self.spark, self.config = spark, config or EmbeddingConfig()
        self.folder = folder.rstrip("/")
        self.domains = Table(spark, f"{self.folder}/domains", schema.DOMAIN, ["id"])
        vectors = schema.T.StructType([*schema.VECTOR.fields, schema.T.StructField("domain_id", schema.T.StringType()), schema.T.StructField("asset_id", schema.T.StringType())])
        of_asset = ("domain_id", "asset_id")
        self.levels = {"assets": LevelOf(schema.ASSET, ("domain_id", "id")), "chunks": LevelOf(schema.CHUNK, of_asset), "vectors": LevelOf(vectors, of_asset)}
        self.assets, self.chunks, self.vectors = (Level(self, name) for name in self.levels)

    def versions(self, domain_id: str) -> store.Versions:
        return store.Versions(self.spark, f"{self.folder}/state/{quote(domain_id, safe='')}")

    def segments(self, domain_id: str) -> Segments:
        return Segments(self.versions(domain_id), self.levels, ("domain_id", "id"))

    def domain_ids(self) -> list[str]:
        return [unquote(n) for n in store.Versions(self.spark, f"{self.folder}/state").names()]

    def register(self, domain: DomainConfig) -> None:
        """Write a domain's row, if it isn't there as it is."""
        row = self.spark.createDataFrame([(domain.id, domain.name, domain.domain_type, json.dumps(domain.meta))], schema.DOMAIN)
        if not self.domains.read().intersect(row).take(1):
            self.domains.upsert(row)

    def sync(self, root: str, domain_id: str, patterns: PathPatterns | None = None, ignore: list | str | None = None, languages: list[LanguageConfig] | None = None) -> Counts:
        """Bring a codebase domain to the state of the files below `root`."""
        p = patterns or PathPatterns()
        own = {c.name: {f.name: getattr(c, f.name) for f in fields(c)} for c in languages or []}
        off = {c.name: {"enabled": False} for c in default_languages()} if languages is not None else {}
        settings = {"include": p.include, "exclude": p.exclude, "ignore": ignore or [], "languages": off | own}
        return self.run(create_processor(DomainConfig(domain_id, domain_id, "codebase", meta={"directory_path": root}, processor=settings), self.config))

    def run(self, processor: Processor) -> Counts:
        """Bring a domain to the state of its source. Only added and modified assets are loaded and parsed.

        Assets are compared by one full outer join. Assets without chunks are kept with their hash,
        so they aren't parsed again. Assets, chunks and vectors change in one commit; a run that
        ends before it has changed nothing, and one that another commit overtook is a Conflict.
        """
        domain_id = processor.domain.id
        self.register(processor.domain)
        segments = self.segments(domain_id)
        number, state = segments.last()
        seen = processor.source.scan(self.spark).persist(StorageLevel.DISK_ONLY)
        stored = segments.read("assets", state)
        states = sync.diff(stored, seen.select("id", "domain_id", "asset_hash")).persist(StorageLevel.DISK_ONLY)
        kept = [seen, states]
        try:
            n = sync.counts(states).first()
            if not n["dirty"] and not n["deleted"]:
                return Counts(n["found"], 0, 0, 0)
            gone = states.filter("state in ('modified', 'deleted')").select("domain_id", "id")
            changed = states.filter("state in ('added', 'modified')").select("domain_id", "id")
            fresh = processor.source.load(seen.join(changed, ["domain_id", "id"], "left_semi")).persist(StorageLevel.DISK_ONLY)
            parsed = processor.parser.parse(fresh).persist(StorageLevel.DISK_ONLY)
            kept += [fresh, parsed]
            new = {
                "assets": fresh.select("id", "domain_id", "name", "asset_hash", "meta"),
                "chunks": parsed.select("id", "asset_id", "domain_id", "meta"),
                "vectors": processor.indexer.index(parsed),
            }
            staged = segments.stage(new, gone)
            n_chunks = parsed.count()
            try:
                segments.commit(number, [*state, staged], staged)
            except store.Conflict:
                segments.drop(staged)
                raise
            segments.compact()
            return Counts(n["found"], n["dirty"], n["deleted"], n_chunks)
        finally:
            for df in kept:
                df.unpersist()

    def sweep(self, domain_id: str) -> None:
        """Delete folders that the domain's current state doesn't name. For times without readers or writers."""
        self.segments(domain_id).sweep()

    def changes(self, domain_id: str, after: int = 0) -> DataFrame:
        """Assets changed since commit `after`: domain_id, id, change (upsert or delete), commit."""
        segments = self.segments(domain_id)
        return segments.changes(segments.versions.entries(after))

    def search_store(self, domain_id: str) -> DataFrame:
        """The vectors of a domain; its folders alone are read."""
        return self.vectors.read(domain_id)
