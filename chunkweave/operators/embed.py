"""Embeddings behind one interface: a deterministic hashing embedder, or any model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave import config

Embedder = Callable[[list[str], str], list[list[float]]]


def hashing(dim: int = config.DIM) -> Embedder:
    """Signed feature hashing of words and word pairs, length one. Deterministic; no quality is claimed."""

    def embed(texts: list[str], task: str) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            words = (t or "").lower().split()
            for w in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                h = xxhash.xxh64_intdigest(w)
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def with_retry(embed: Embedder, tries: int = 6, wait: float = 1.0) -> Embedder:
    """Retries with waits of 1, 2, 4 ... times ``wait``; the last error is raised."""

    def run(texts: list[str], task: str) -> list[list[float]]:
        for i in range(tries):
            try:
                return embed(texts, task)
            except Exception:
                if i == tries - 1:
                    raise
                time.sleep(wait * 2**i)
        return []

    return run


def embed_texts(rows: DataFrame, key: str, embedder: Embedder, task: str = "document", dim: int = config.DIM) -> DataFrame:
    """``key, vector`` of ``rows(key, text)``; a batch that fails is tried text by text, then a zero vector.

    Zero vectors are stored but never searched. Limit an external service by the number of partitions.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = [t or "" for t in pdf["text"]]
            try:
                got = embedder(texts, task)
            except Exception:
                got = []
                for t in texts:
                    try:
                        got.append(embedder([t], task)[0])
                    except Exception:
                        got.append([0.0] * dim)
            yield pd.DataFrame({key: pdf[key], "vector": [np.asarray(v, np.float32) for v in got]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInPandas(run, f"{key} {kind}, vector array<float>")


def dimension(rows: DataFrame) -> int:
    """The dimension of the stored vectors: the size of the first non-empty one, 0 if there is none."""
    first = rows.where(F.size("vector") > 0).select(F.size("vector")).limit(1).collect()
    return first[0][0] if first else 0
