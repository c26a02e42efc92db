"""Vectors: norms, products, the byte codec and offline vectorizers."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

TINY = 1e-10


def normalised(v: Column) -> Column:
    """Unit length, computed in doubles and kept as floats; a vector of hardly any length stays as it is."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm < TINY, v.cast("array<float>")).otherwise(F.transform(d, lambda x: x / norm).cast("array<float>"))


def is_unit_length(v: Column) -> Column:
    """Whether the squares sum to 1 within 1e-5, in doubles."""
    total = F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    return F.abs(total - 1.0) < 1e-5


def dot(v: Column, q: Sequence[float]) -> Column:
    """Product with a query vector, in doubles; the cosine of unit vectors."""
    query = F.array(*[F.lit(float(np.float32(x))) for x in q])
    products = F.zip_with(v.cast("array<double>"), query, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def encode(v: Sequence[float]) -> bytes:
    return np.asarray(v, "<f4").tobytes()


def decode(data: bytes) -> list[float]:
    if len(data) % 4:
        raise ValueError(f"{len(data)} bytes are no whole number of floats")
    return np.frombuffer(data, "<f4").tolist()


@F.pandas_udf(BinaryType())
def encode_vectors(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else encode(x))


@F.pandas_udf(ArrayType(FloatType()))
def decode_vectors(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else np.array(decode(x), np.float32))


class Vectorizer(Protocol):
    """Texts to unit vectors; dim is 0 while unknown."""

    model: str
    dim: int

    def embed(self, texts: Sequence[str]) -> list[np.ndarray]: ...


def unit(v: np.ndarray) -> np.ndarray:
    d = np.asarray(v, np.float64)
    n = float(np.sqrt((d * d).sum()))
    return (d if n < TINY else d / n).astype(np.float32)


@dataclass(frozen=True)
class HashVectorizer:
    """Deterministic unit vectors from a text's FNV-1a hash, for work without a model server."""

    model: str = "hash"
    dim: int = 4

    def embed(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> np.ndarray:
        # fixed values: FNV-1a of 32 bits, then the 13, 17, 5 shifts for each component
        state = 2166136261
        for b in text.encode():
            state = ((state ^ b) * 16777619) & 0xFFFFFFFF
        out = []
        for _ in range(self.dim):
            state = (state ^ (state << 13)) & 0xFFFFFFFF
            state ^= state >> 17
            state = (state ^ (state << 5)) & 0xFFFFFFFF
            out.append((state - (1 << 32) if state >> 31 else state) / 2**31)
        return unit(np.array(out))


@dataclass(frozen=True)
class HttpVectorizer:
    """A model server that answers {"embeddings": [...]} to {"model", "input"}; `post` does the call."""

    model: str
    post: Callable[[dict], dict]
    dim: int = 0
    batch: int = 32

    def embed(self, texts: Sequence[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for k in range(0, len(texts), self.batch):
            part = list(texts[k : k + self.batch])
            got = self.post({"model": self.model, "input": part}).get("embeddings", [])
            if len(got) != len(part):
                raise ValueError(f"{len(part)} texts sent, {len(got)} vectors received")
            out += [unit(np.array(v)) for v in got]
        return out

    def available(self, names: Sequence[str]) -> bool:
        """Whether a server's list of models has this one, whatever its tag and case."""
        own = self.model.lower().split(":")[0]
        return any(n.lower().split(":")[0] == own for n in names)


class ModelServerError(RuntimeError):
    """The model server can't be reached, refuses, or lacks the model."""


def json_call(url: str, body: dict | None = None, timeout: float = 120) -> dict:
    """POST of a body as JSON, or GET without one; the answer's JSON."""
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return json.loads(r.read())
    except urllib.error.HTTPError as e:
        raise ModelServerError(f"{url}: status {e.code}: {e.read()[:200].decode('utf-8', 'replace')}") from e
    except OSError as e:
        raise ModelServerError(f"no model server at {url}: {e}") from e


def model_server(base: str, model: str, batch: int = 32, call: Callable = json_call) -> HttpVectorizer:
    """A vectorizer by the server at `base`; the calls are made on the executors. An error if it lacks the model."""
    # fixed values: the server's paths and fields
    base = base.rstrip("/")
    made = HttpVectorizer(model, lambda body: call(f"{base}/api/embed", body), batch=batch if batch > 0 else 32)
    names = [m["name"] for m in call(f"{base}/api/tags").get("models", [])]
    if not made.available(names):
        raise ModelServerError(f"the server at {base} has no model {model!r}, but {', '.join(sorted(names)) or 'none'}")
    return made


def embed_column(df: DataFrame, text: str, vectorizer: Vectorizer, out: str = "vector") -> DataFrame:
    """A vector column, made in Arrow batches on the executors."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, np.float32) for v in vectorizer.embed(texts.tolist())], index=texts.index, dtype=object)

    return df.withColumn(out, run(F.col(text)))
