"""Vectors: their bytes, and a deterministic embedder that stands in where no model is installed."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def to_bytes(vector: Column) -> Column:
    """float32 little-endian bytes of a vector; null stays null."""
    return F.pandas_udf(lambda s: s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes()), "binary")(vector)


def from_bytes(data: Column) -> Column:
    """The vector of float32 little-endian bytes; null stays null."""
    return F.pandas_udf(lambda s: s.map(lambda b: None if b is None else np.frombuffer(b, "<f4")), "array<float>")(data)


def to_text(vector: Column) -> Column:
    return F.base64(to_bytes(vector))


def from_text(text: Column) -> Column:
    return from_bytes(F.unbase64(text))


DIM = 64
#: Words whose places an encoder remembers.
_REMEMBERED = 1 << 20


def hashing_encoder(dim: int = DIM) -> Encoder:
    """Words of lower-cased texts counted at places and with signs that the first 32 bits of their MD5
    give, at length 1; a text whose counts cancel out is all zeros. The counts are integers, so each
    number of a vector is one rounded division."""
    places: dict[str, tuple[int, int]] = {}

    def place(word: str) -> tuple[int, int]:
        if len(places) >= _REMEMBERED:
            places.clear()
        h = int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)
        return places.setdefault(word, (h % dim, 1 if h >> 31 else -1))

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            for word, n in Counter(text.lower().split()).items():
                at, sign = places.get(word) or place(word)
                row[at] += sign * n
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)

    return encode


def embed(df: DataFrame, make: Callable[[], Encoder], text: str = "text", prefix: str = "", dim: int = DIM, batch: int = 32) -> DataFrame:
    """Adds embedding. make builds the model once for each task; vectors of another size are an error."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for s in series:
            texts = [prefix + (t or "") for t in s]
            made = [encode(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            if any(m.shape[1] != dim for m in made):
                raise ValueError(f"the model's vectors don't have {dim} numbers")
            yield pd.Series([v for m in made for v in m])

    typed: Callable[[Iterator[pd.Series]], Iterator[pd.Series]] = run
    return df.withColumn("embedding", F.pandas_udf(typed, "array<float>", functionType=F.PandasUDFType.SCALAR_ITER)(F.col(text)))


def embedded(text: str, make: Callable[[], Encoder], prefix: str = "") -> list[float]:
    """The vector of one question, by the model that embed takes."""
    return [float(x) for x in make()([prefix + text])[0]]
