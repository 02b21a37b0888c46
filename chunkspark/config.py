"""Settings of paths, languages, embedding, search, models, stores, logging and domains."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass

# Defaults that an index of the same files must share.
#: Order in which languages claim a file, with the suffixes of each and whether case matters.
DEFAULT_LANGUAGES = {
    "python": ((".py",), True),
    "cpp": ((".cpp", ".h", ".hpp", ".cc", ".hh"), False),
    "typescript": ((".ts", ".tsx"), False),
    "csharp": ((".cs",), False),
    "unity_asset": ((".meta",), True),
}


@dataclass
class PathPatterns:
    include: list[str] = field(default_factory=lambda: ["**/*"])
    exclude: list[str] = field(default_factory=lambda: ["**/venv/**", "**/.git/**", "**/__pycache__/**", "**/tests/**"])


@dataclass
class LanguageConfig:
    name: str
    suffixes: tuple[str, ...]
    case_sensitive: bool = False
    enabled: bool = True
    max_file_size: int | None = 1_000_000


def default_languages() -> list[LanguageConfig]:
    """C# has no size limit and Unity assets a larger one."""
    limits = {"csharp": None, "unity_asset": 10_000_000}
    return [LanguageConfig(n, s, c, True, limits.get(n, 1_000_000)) for n, (s, c) in DEFAULT_LANGUAGES.items()]


@dataclass
class EmbeddingConfig:
    provider: str = "hashing"
    model: str = "signed-words"
    dimension: int = 768
    #: What questions begin with, for models that tell them from documents.
    query_prompt: str = ""
    #: Folder of a `vector_cache`, if texts embedded before are to be looked up.
    cache_path: str | None = None
    #: Of providers behind a server: its address, the environment variable with its key, texts and characters of a request, tries and seconds.
    url: str | None = None
    key_variable: str | None = None
    batch_texts: int = 64
    batch_characters: int = 200_000
    tries: int = 5
    timeout: float = 60.0


@dataclass
class SearchConfig:
    top_k: int = 50
    score_threshold: float | None = None
    metric: str = "l2"
    prefilter: bool = False


@dataclass
class SearchQuery:
    """One vector query, of the only search method there is."""

    embedding: list[float]
    top_k: int = 10
    score_threshold: float | None = 0.0


@dataclass
class ModelConfig:
    """A language model: a name in `operators.chat.MODELS` and what its maker takes."""

    provider: str = "testing"
    name: str = "offline"
    system_prompt: str = ""
    settings: dict = field(default_factory=dict)


@dataclass
class AnalyticsConfig:
    """Events are kept only if this is on and has a folder."""

    enabled: bool = False
    folder: str | None = None


@dataclass
class ChatConfig:
    model: ModelConfig = field(default_factory=ModelConfig)
    title: str = "Code assistant"
    placeholder: str = "Ask about the code"
    analytics: AnalyticsConfig = field(default_factory=AnalyticsConfig)


@dataclass
class StoreConfig:
    """Where vectors are: a provider in `operators.vectors.STORES`, its folder or URL, and how it searches."""

    provider: str = "parquet"
    location: str = "./state"
    table: str = "vectors"
    metric: str = "l2"
    prefilter: bool = False
    content_field: str | None = None
    options: dict = field(default_factory=dict)


@dataclass
class LoggingConfig:
    level: str = "INFO"
    json_lines: bool = False
    to_stderr: bool = True
    file: str | None = None

    def apply(self, name: str = "chunkspark") -> None:
        """Set up the package's logger."""
        import json
        import logging

        class Lines(logging.Formatter):
            def format(self, record):
                return json.dumps({"time": self.formatTime(record), "level": record.levelname, "name": record.name, "message": record.getMessage()})

        handlers = ([logging.StreamHandler()] if self.to_stderr else []) + ([logging.FileHandler(self.file, delay=True)] if self.file else [])
        logger = logging.getLogger(name)
        logger.setLevel(self.level)
        logger.handlers = handlers
        for h in handlers:
            h.setFormatter(Lines() if self.json_lines else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))


def settings(kind, path: str | None = None, given: dict | None = None):
    """A settings object from the fields that `given` has, then those of a YAML file, then defaults; unknown fields are an error."""
    from pathlib import Path

    import yaml

    raw = (yaml.safe_load(Path(path).read_text()) if path and Path(path).exists() else None) or {}
    values = raw | (given or {})
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"{kind.__name__} has no {', '.join(sorted(unknown))}")
    for name, value in values.items():
        factory = known[name].default_factory
        if isinstance(value, dict) and isinstance(factory, type) and is_dataclass(factory):
            values[name] = settings(factory, given=value)
    return kind(**values)


@dataclass
class RateLimit:
    requests: int = 2
    window_seconds: int = 60


@dataclass
class DomainConfig:
    id: str
    name: str
    domain_type: str
    enabled: bool = True
    meta: dict = field(default_factory=dict)
    mixins: dict[str, str] = field(default_factory=dict)
    processor: dict = field(default_factory=dict)
    search: SearchConfig = field(default_factory=SearchConfig)
