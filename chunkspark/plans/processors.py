"""What a domain does with its files: where they come from, how they are cut, and how they are embedded."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkspark.config import DomainConfig, EmbeddingConfig, LanguageConfig, PathPatterns, default_languages
from chunkspark.operators.chunk import parse_assets, wrap_chunks
from chunkspark.operators.embed import embedding
from chunkspark.operators.vector_cache import VectorCache
from chunkspark.sources.domains import Registry
from chunkspark.sources.files import GIT, parseable, read_files, scan_files


@runtime_checkable
class Source(Protocol):
    """Assets of a domain: `scan` gives id, domain_id, asset_hash and what `load` needs; `load` gives the rows that a parser takes."""

    def scan(self, spark: SparkSession) -> DataFrame: ...

    def load(self, assets: DataFrame) -> DataFrame: ...


@runtime_checkable
class Parser(Protocol):
    """Chunks (id, asset_id, domain_id, content, meta) of loaded assets."""

    def parse(self, assets: DataFrame) -> DataFrame: ...


@runtime_checkable
class Indexer(Protocol):
    """Vectors (id, embedding, content, doc_metadata, domain_id, asset_id) of chunks."""

    def index(self, chunks: DataFrame) -> DataFrame: ...


@dataclass
class CodebaseMeta:
    """Where a codebase is, and of which commit."""

    directory_path: str
    git_url: str | None = None
    git_branch: str | None = None
    git_commit_hash: str | None = None


@dataclass
class CodebaseSettings:
    include: list[str] | None = None
    exclude: list[str] | None = None
    ignore: list[str] | str = GIT
    languages: dict[str, dict] = field(default_factory=dict)

    def patterns(self) -> PathPatterns:
        default = PathPatterns()
        return PathPatterns(default.include if self.include is None else self.include, default.exclude if self.exclude is None else self.exclude)

    def all_languages(self) -> list[LanguageConfig]:
        """Default languages with what the settings say of them."""
        return [LanguageConfig(**({f.name: getattr(c, f.name) for f in fields(c)} | self.languages.get(c.name, {}))) for c in default_languages()]


#: (class of a domain's meta, class of its settings) by domain type.
TYPES = Registry("domain type")
TYPES.register("codebase")((CodebaseMeta, CodebaseSettings))
#: Makers of sources, parsers and indexers: called with the domain, its meta and settings, and the embedding config.
MIXINS = Registry("mixin")


@dataclass
class Context:
    domain: DomainConfig
    meta: object
    settings: object
    embedding: EmbeddingConfig


@MIXINS.register("CodebaseSource")
@dataclass
class CodebaseSource:
    context: Context

    def scan(self, spark: SparkSession) -> DataFrame:
        c = self.context
        return scan_files(spark, c.meta.directory_path, c.domain.id, c.settings.patterns(), c.settings.ignore)

    def load(self, assets: DataFrame) -> DataFrame:
        found = read_files(assets, self.context.settings.all_languages())
        return found.withColumn("meta", F.to_json(F.struct("file_path")))


@MIXINS.register("CodebaseParser")
@dataclass
class CodebaseParser:
    context: Context

    def parse(self, assets: DataFrame) -> DataFrame:
        return wrap_chunks(parse_assets(parseable(assets, self.context.settings.all_languages())))


@MIXINS.register("CodebaseIndexer")
@dataclass
class CodebaseIndexer:
    context: Context

    def index(self, chunks: DataFrame) -> DataFrame:
        config = self.context.embedding
        if config.cache_path:
            chunks = VectorCache(chunks.sparkSession, config.cache_path).embed(chunks, "content", config)
        else:
            chunks = chunks.withColumn("embedding", embedding(F.col("content"), config))
        return chunks.select("id", "embedding", "content", F.col("meta").alias("doc_metadata"), "domain_id", "asset_id")


@dataclass
class Processor:
    domain: DomainConfig
    source: Source
    parser: Parser
    indexer: Indexer


def create_processor(domain: DomainConfig, embedding_config: EmbeddingConfig | None = None) -> Processor:
    """The processor that a domain's config names; meta and settings that don't fit its type are errors."""
    try:
        meta_of, settings_of = TYPES.get(domain.domain_type)
        context = Context(domain, meta_of(**domain.meta), settings_of(**domain.processor), embedding_config or EmbeddingConfig())
        names = {"source": "CodebaseSource", "parser": "CodebaseParser", "indexer": "CodebaseIndexer"} | domain.mixins
        made = {part: MIXINS.get(names[part])(context) for part in ("source", "parser", "indexer")}
    except (KeyError, TypeError) as e:
        raise ValueError(f"no processor for domain {domain.id!r}: {e.args[0]}") from e
    for part, kind in (("source", Source), ("parser", Parser), ("indexer", Indexer)):
        if not isinstance(made[part], kind):
            raise ValueError(f"no processor for domain {domain.id!r}: {names[part]} is no {part}")
    return Processor(domain, **made)
