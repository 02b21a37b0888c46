"""Embeddings of texts by named providers; the one built in hashes words to signed dimensions."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkspark.config import EmbeddingConfig
from chunkspark.sources.domains import Registry

PROVIDERS = Registry("embedding provider")
#: What texts are embedded as.
MODES = ("document", "query")


@PROVIDERS.register("hashing")
def hashing(config: EmbeddingConfig) -> Callable[[list[str], str], np.ndarray]:
    """Unit vectors: each word adds +1 or -1 to one dimension, by CRC-32. Stable across runs and machines."""
    known: dict[str, tuple[int, float]] = {}  # words met, with their dimension and sign

    def place(word: str) -> tuple[int, float]:
        if word not in known:
            if len(known) > 200_000:
                known.clear()
            h = zlib.crc32(word.encode())
            known[word] = h % config.dimension, 1.0 if h >> 31 else -1.0
        return known[word]

    def embed(texts: list[str], mode: str) -> np.ndarray:
        out = np.zeros((len(texts), config.dimension), np.float32)
        for i, text in enumerate(texts):
            if words := Counter(re.findall(r"\w+", text.lower())):
                at, sign = zip(*map(place, words), strict=True)
                out[i] = np.bincount(at, np.array(sign) * np.array(list(words.values())), config.dimension)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)

    return embed


#: Answers after which a request is sent again, and the longest wait before that.
AGAIN, MOST_WAIT = {408, 425, 429, 500, 502, 503, 504}, 30.0


def _asked(config: EmbeddingConfig, texts: list[str], mode: str) -> list[list[float]]:
    """Vectors of one request, in the order of its texts. What may pass is tried again, later each time."""
    body = json.dumps({"model": config.model, "input": texts, "input_type": mode}).encode()
    headers = {"Content-Type": "application/json"}
    if config.key_variable and os.environ.get(config.key_variable):
        headers["Authorization"] = f"Bearer {os.environ[config.key_variable]}"
    for n in range(1, config.tries + 1):
        wait = min(MOST_WAIT, 0.25 * 2**n)
        try:
            with urllib.request.urlopen(urllib.request.Request(config.url, body, headers), timeout=config.timeout) as answer:
                got = json.load(answer)
            break
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or n == config.tries:
                raise RuntimeError(f"{config.url} answered {e.code}") from e
            said = e.headers.get("Retry-After", "")
            wait = min(MOST_WAIT, float(said)) if re.fullmatch(r"\d+(\.\d+)?", said) else wait
        except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
            if n == config.tries:
                raise RuntimeError(f"{config.url} can't be reached: {e}") from e
        time.sleep(wait)
    if "embeddings" in got:
        out = got["embeddings"]
    else:
        rows = got["data"]
        out = [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])] if all("index" in r for r in rows) else [r["embedding"] for r in rows]
    if len(out) != len(texts) or any(len(v) != config.dimension for v in out):
        raise RuntimeError(f"{config.url} gave {len(out)} vectors of {sorted({len(v) for v in out})} numbers for {len(texts)} texts of {config.dimension}")
    return out


@PROVIDERS.register("http")
def over_http(config: EmbeddingConfig) -> Callable[[list[str], str], np.ndarray]:
    """Vectors from a server that takes {model, input, input_type} and answers {data: [{index, embedding}]} or {embeddings}.

    A batch's texts go once each, in requests of at most `batch_texts` texts and `batch_characters`
    characters (a longer text goes alone, whole). Each task sends one request at a time, so a
    server sees as many as there are cores; the key is read where the task runs.
    """
    if not config.url:
        raise ValueError("the http provider needs a url")

    def embed(texts: list[str], mode: str) -> np.ndarray:
        own = list(dict.fromkeys(texts))
        vectors: dict[str, list[float]] = {}
        batch, size = [], 0
        for i, text in enumerate(own):
            batch.append(text)
            size += len(text)
            if i + 1 == len(own) or len(batch) == config.batch_texts or size + len(own[i + 1]) > config.batch_characters:
                vectors |= zip(batch, _asked(config, batch, mode), strict=True)
                batch, size = [], 0
        return np.array([vectors[t] for t in texts], np.float32).reshape(len(texts), config.dimension)

    return embed


def prompted(texts: list[str], config: EmbeddingConfig, mode: str) -> list[str]:
    """Texts as the provider gets them: queries begin with the config's prompt."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; known: {', '.join(MODES)}")
    return [config.query_prompt + t for t in texts] if mode == "query" and config.query_prompt else texts


def embed_texts(texts: str | list[str], config: EmbeddingConfig | None = None, mode: str = "document"):
    """Vectors of texts on the driver; one text gives one vector. Empty input and unknown providers are errors."""
    config = config or EmbeddingConfig()
    if not texts:
        raise ValueError("nothing to embed")
    given = prompted([texts] if isinstance(texts, str) else list(texts), config, mode)
    try:
        provider = PROVIDERS.get(config.provider)
    except KeyError as e:
        raise ValueError(str(e)) from e
    try:
        out = provider(config)(given, mode)
    except Exception as e:
        raise RuntimeError(f"{config.provider} failed: {e}") from e
    return out[0].tolist() if isinstance(texts, str) else out.tolist()


def embedding(text: Column, config: EmbeddingConfig | None = None, mode: str = "document") -> Column:
    """An array<float> column. The provider is made once per task and sees Arrow batches."""
    config = config or EmbeddingConfig()
    PROVIDERS.get(config.provider)
    prompted([], config, mode)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = PROVIDERS.get(config.provider)(config)
        for texts in batches:
            yield pd.Series(list(provider(prompted([t or "" for t in texts], config, mode), mode)), index=texts.index)

    return run(text)
