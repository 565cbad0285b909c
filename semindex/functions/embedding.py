"""Embedding models: a registry, and a deterministic one that needs no files."""

from __future__ import annotations

import re
import zlib
from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(ABC):
    """A model as Spark sees it: batches of texts to vectors. Instances travel to the workers."""

    name: str
    dimension: int
    batch_size: int = 32

    @abstractmethod
    def encode_documents(self, texts: list[str]) -> np.ndarray:
        """(len(texts), dimension) float32."""

    def encode_queries(self, texts: list[str]) -> np.ndarray:
        """Queries may be encoded in another way than documents."""
        return self.encode_documents(texts)

    def info(self) -> dict:
        return {"model_name": self.name, "embedding_dimension": self.dimension}

    def close(self) -> None:
        """Free what the model holds."""


_TOKEN = re.compile(r"[^\W_]+")


class HashingEmbedder(Embedder):
    """Signed feature hashing of words and of their three-letter pieces; no model files, the same
    vector everywhere."""

    def __init__(self, dimension: int = 256) -> None:
        self.name, self.dimension = f"hashing-{dimension}", dimension

    def encode_documents(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in enumerate(texts):
            for word in _TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", text or "").lower()):
                for piece, weight in ((word, 1.0), *((f"#{word[i : i + 3]}", 0.3) for i in range(len(word) - 2))):
                    h = zlib.crc32(piece.encode())
                    out[row, (h >> 1) % self.dimension] += weight if h & 1 else -weight
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)


_MODELS: dict[str, Embedder] = {}


def register(model: Embedder, *aliases: str) -> Embedder:
    for name in (model.name, *aliases):
        _MODELS[name] = model
    return model


def resolve(name: str) -> Embedder:
    """A model by its name, or by the part after the last slash."""
    if name in _MODELS:
        return _MODELS[name]
    short = [m for n, m in _MODELS.items() if n.rsplit("/", 1)[-1] == name.rsplit("/", 1)[-1]]
    if not short:
        raise KeyError(f"unknown embedding model {name!r}; known: {sorted(_MODELS)}")
    return short[0]


DEFAULT = register(HashingEmbedder(), "default")


def embed(text: Column, model: Embedder = DEFAULT, queries: bool = False) -> Column:
    """array<float> vectors of a text column, in Arrow batches; order is kept, errors fail the job."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        encode = model.encode_queries if queries else model.encode_documents
        values = texts.fillna("").tolist()
        parts = [encode(values[i : i + model.batch_size]) for i in range(0, len(values), model.batch_size)]
        return pd.Series([row for part in parts for row in np.asarray(part, np.float32)])

    return run(text)


def embed_query(text: str, model: Embedder = DEFAULT) -> list[float]:
    return [float(x) for x in model.encode_queries([text])[0]]


def embed_document(text: str, model: Embedder = DEFAULT) -> list[float]:
    return [float(x) for x in model.encode_documents([text])[0]]
