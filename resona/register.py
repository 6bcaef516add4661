"""The functions of this package for SQL: ``register(spark)``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resona.functions import synonyms, vectors as vx
from resona.operators import encode
from resona.sources import extract

_VECTOR = T.ArrayType(T.DoubleType())


@F.pandas_udf(_VECTOR)
def _involution(v: pd.Series) -> pd.Series:
    return v.map(lambda x: np.concatenate([x[:1], x[:0:-1]]))


@F.pandas_udf(_VECTOR)
def _normalize(v: pd.Series) -> pd.Series:
    return v.map(lambda x: x / n if (n := np.linalg.norm(x)) >= vx.TINY else x)


@F.pandas_udf(T.DoubleType())
def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = np.stack(a.to_numpy()), np.stack(b.to_numpy())
    n = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    return pd.Series(np.where(n > vx.TINY**2, (x * y).sum(axis=1) / np.where(n > 0, n, 1), 0.0))


@F.pandas_udf(_VECTOR)
def _unbind(c: pd.Series, key: pd.Series) -> pd.Series:
    x, y = np.stack(c.to_numpy()), np.stack(key.to_numpy())
    y = np.concatenate([y[:, :1], y[:, :0:-1]], axis=1)
    return pd.Series(list(np.fft.irfft(np.fft.rfft(x, axis=1) * np.fft.rfft(y, axis=1), n=x.shape[1], axis=1)))


@F.pandas_udf(_VECTOR)
def _superpose(v: pd.Series, weight: pd.Series) -> list[float]:
    """The weighted sum of a group's vectors; of a group too large for a task, sum parts of it first and then their sums."""
    return (np.stack(v.to_numpy()) * weight.to_numpy(float)[:, None]).sum(axis=0)


def _encoder(dimension: int, groups: dict[str, list[str]]):
    @F.pandas_udf(_VECTOR)
    def encode_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        @lru_cache(encode.CACHE)
        def drawn(feature: str) -> np.ndarray:
            v = np.random.default_rng(int(hashlib.sha256(feature.encode()).hexdigest()[:16], 16)).standard_normal(dimension)
            return v / np.linalg.norm(v)

        def one(text: str | None) -> np.ndarray:
            v = sum(w * drawn(f) for f, w in encode.text_features(text or "", groups).items())
            n = np.linalg.norm(v)
            return v / n if n >= vx.TINY else v

        for part in texts:
            yield part.map(one, na_action=None)

    return encode_text


@F.udtf(returnType="id: string, name: string, content: string")
class PythonUnits:
    """The units of a Python file: SELECT * FROM python_units(path, text)."""

    def eval(self, path: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from extract.python_units(path, text) or []


def register(spark: SparkSession, dimension: int = 1024) -> None:
    """Makes vec_bind, vec_unbind, vec_involution, vec_normalize, vec_cosine, random_vector, encode_text, python_units and the aggregate superpose known to SQL."""
    groups = {w: list(g) for g in synonyms.GROUPS for w in g}
    for name, f in (("superpose", _superpose), ("encode_text", _encoder(dimension, groups)), ("vec_bind", vx.bind), ("vec_unbind", _unbind), ("vec_involution", _involution), ("vec_normalize", _normalize), ("vec_cosine", _cosine), ("random_vector", vx.random_vectors(dimension))):
        spark.udf.register(name, f)
    spark.udtf.register("python_units", PythonUnits)
