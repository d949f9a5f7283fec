"""Embedding providers: a registry of functions from texts to vectors, applied in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Provider = Callable[[list[str]], list[list[float]]]
PROVIDERS: dict[str, Callable[..., Provider]] = {}


def provider(name: str):
    def wrap(f: Callable[..., Provider]) -> Callable[..., Provider]:
        PROVIDERS[name] = f
        return f

    return wrap


def hash_vector(text: str, dim: int) -> list[float]:
    """Two bytes a dimension of a chain of SHA-256 digests (each of the one before), scaled to [-1, 1], over its norm."""
    block, data = hashlib.sha256(text.encode()).digest(), b""
    while len(data) < 2 * dim:
        data += block
        block = hashlib.sha256(block).digest()
    v = [int.from_bytes(data[2 * i : 2 * i + 2], "big") / 32767.5 - 1.0 for i in range(dim)]
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


@provider("hash")
def hash_provider(dim: int = 64, prefix: str = "") -> Provider:
    return lambda texts: [hash_vector(prefix + t, dim) for t in texts]


def embed(rows: DataFrame, key: str, make: Callable[[], Provider], text: str = "text") -> DataFrame:
    """(key, vector) with a provider that each worker makes once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for b in batches:
            yield pd.DataFrame({key: b[key], "vector": f(b[text].fillna("").tolist())})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<double>")


def hash_vectors(rows: DataFrame, key: str, dim: int = 64, text: str = "text") -> DataFrame:
    return embed(rows, key, lambda: PROVIDERS["hash"](dim), text)


def pack(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, blob): vectors as little-endian float32."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "blob": [np.asarray(v, "<f4").tobytes() for v in b[vector]]})

    return rows.select(key, vector).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, blob binary")


def unpack(rows: DataFrame, key: str, blob: str = "blob") -> DataFrame:
    """(key, vector) of little-endian float32 blobs."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "vector": [np.frombuffer(x, "<f4").tolist() for x in b[blob]]})

    return rows.select(key, blob).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<float>")
