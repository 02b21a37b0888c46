"""Assets from a directory tree."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkspark.config import LanguageConfig, PathPatterns
from chunkspark.sources.paths import ignored, language_of, small_enough, wanted

#: Files of more bytes are hashed but not kept for a chunker, whatever its own limit.
MOST_BYTES = 1 << 30
#: What `.gitignore` files say, instead of rules that the caller gives.
GIT = "git"


def asset_id(path: Column, root: str) -> Column:
    """The path below `root`."""
    bare = root.split("://")[-1].rstrip("/")
    return F.regexp_replace(path, "^(?:[a-z0-9]+:/*)?/*" + "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in bare.lstrip("/")) + "/", "")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path and length of every file below `root`, but for hidden and empty ones. Contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def open_file(uri: str):
    """A stream of a file that the listing named."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + (rest if colon else uri).lstrip("/"))
    authority, _, path = rest.lstrip("/").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system.open_input_stream(f"{base.rstrip('/')}/{path}")


def _text_of(uri: str) -> str | None:
    try:
        with open_file(uri) as f:
            return f.read().decode("utf-8", "replace")
    except OSError:
        return None


def gitignore_rules(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(folder below the root, rule) of every `.gitignore` file, those of outer folders first; none unless the root is a git checkout.

    Listings leave hidden files out, so executors look for one in each folder that has files.
    """
    base = root.rstrip("/")
    if _text_of(f"{base}/.git/HEAD") is None:
        return []
    parts = F.split(asset_id(F.col("path"), root), "/")
    folders = list_files(spark, root).select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("folder")).distinct()

    def run(batches):
        for pdf in batches:
            found = [(f, _text_of(f"{base}/{f}/.gitignore" if f else f"{base}/.gitignore")) for f in pdf["folder"]]
            yield pd.DataFrame([x for x in found if x[1] is not None], columns=["folder", "rules"])

    rows = folders.mapInPandas(run, "folder string, rules string").collect()  # settings, few
    return [(folder, line) for folder, text in sorted(map(tuple, rows), key=lambda r: (r[0].count("/") + bool(r[0]), r[0])) for line in text.split("\n")]


def _contents(keep_content: bool):
    def run(batches):
        for pdf in batches:
            hashes, contents = [], []
            for uri, keep in zip(pdf["uri"], pdf["fit"], strict=True):
                crc, parts = 0, []
                with open_file(uri) as f:
                    while data := f.read(1 << 20):
                        crc = zlib.crc32(data, crc)
                        if keep and keep_content:
                            parts.append(data)
                hashes.append(str(crc))
                contents.append(b"".join(parts) if keep and keep_content else None)
            yield pd.DataFrame({**{c: pdf[c] for c in pdf.columns if c != "fit"}, "asset_hash": hashes, "content": contents})

    return run


FILE = "id string, domain_id string, name string, file_path string, uri string, n_bytes long"


def read_files(files: DataFrame, languages: list[LanguageConfig] | None = None, contents: bool = True) -> DataFrame:
    """`files` (FILE) with asset_hash, the CRC-32 of what they hold now, and content if a chunker takes them.

    Each file is read once, as a stream.
    """
    columns = [x.split()[0] for x in FILE.split(", ")]
    language = language_of(F.col("file_path"), languages)
    fit = language.isNotNull() & small_enough(language, F.col("n_bytes"), languages) & (F.col("n_bytes") <= MOST_BYTES)
    dealt = files.select(*columns, F.coalesce(fit, F.lit(False)).alias("fit"))
    return dealt.mapInPandas(_contents(contents), f"{FILE}, asset_hash string, content binary")


def scan_files(spark: SparkSession, root: str, domain_id: str, patterns: PathPatterns | None = None, ignore: list | str | None = None, languages: list[LanguageConfig] | None = None, contents: bool = False) -> DataFrame:
    """One row per file below `root` that patterns and ignore rules admit: FILE, asset_hash, and content if asked for.

    Patterns see the whole path, ignore rules the part below the root. Both are applied to the
    listing, so files that they leave out are never opened. `ignore` is a list of rules, or GIT
    for those of the tree's own files.
    """
    rules = gitignore_rules(spark, root) if ignore == GIT else ignore or []
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    own = asset_id(F.col("path"), root)
    rows = list_files(spark, root).filter(wanted(path, patterns) & ~ignored(own, rules))
    files = rows.select(
        own.alias("id"), F.lit(domain_id).alias("domain_id"), F.element_at(F.split(own, "/"), -1).alias("name"),
        path.alias("file_path"), F.col("path").alias("uri"), F.col("length").alias("n_bytes"),
    )
    found = read_files(files, languages, contents)
    return found if contents else found.drop("content")


def parseable(assets: DataFrame, languages: list[LanguageConfig] | None = None) -> DataFrame:
    """Assets that a chunker takes, with `language` and `source`: right suffix, small enough, valid UTF-8."""
    marked = assets.withColumn("language", language_of(F.col("file_path"), languages))
    fit = marked.filter(F.col("language").isNotNull() & small_enough(F.col("language"), F.col("n_bytes"), languages) & F.col("content").isNotNull())
    return fit.filter(F.is_valid_utf8(F.col("content").cast("string"))).withColumn("source", F.col("content").cast("string"))
