"""Vector functions as column expressions over array<double>, and Arrow functions where a transform is needed."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Below this length a vector counts as zero.
TINY = 1e-10
#: Rows that are bound at once, so that a batch's transforms stay small.
BOUND = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """v at length 1; unchanged where it is (nearly) zero."""
    n = norm(v)
    return F.when(n < TINY, v).otherwise(F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of the angle; 0 where either is (nearly) zero."""
    n, m = norm(a), norm(b)
    return F.when((n < TINY) | (m < TINY), F.lit(0.0)).otherwise(dot(a, b) / (n * m))


def involution(v: Column) -> Column:
    """The first component, then the others in reverse: what unbinding binds with."""
    return F.when(F.size(v) < 2, v).otherwise(F.concat(F.slice(v, 1, 1), F.reverse(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(1))))))


def resize(v: Column, size: int) -> Column:
    """v cut or filled up with zeros, at length 1."""
    return normalize(F.concat(F.slice(v, 1, size), F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(v), F.lit(0)))))


def superpose(df: DataFrame, by: list[str], vector: str, weight: Column | None = None, name: str = "vector") -> DataFrame:
    """The weighted sum of the vectors of each group; components are summed by Spark and put in order again."""
    w = F.lit(1.0) if weight is None else weight
    each = df.select(*by, w.alias("_w"), F.posexplode(vector).alias("_pos", "_x"))
    sums = each.groupBy(*by, "_pos").agg(F.sum(F.col("_x") * F.col("_w")).alias("_s"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_s"))), lambda p: p["_s"]).alias(name))


def _rows(a: pa.Array) -> np.ndarray:
    """A batch's vectors as one matrix, without an object for each."""
    sizes = np.unique(a.value_lengths().to_numpy(False))
    if len(a) and (len(sizes) != 1 or a.null_count):
        raise ValueError("vectors of one batch must have one length")
    return a.flatten().to_numpy(False).reshape(len(a), -1 if len(a) else 0).astype(float)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def bind(a: pa.Array, b: pa.Array) -> pa.Array:
    """Circular convolution, by the Fourier transform of many rows."""
    out = []
    for lo in range(0, len(a), BOUND):
        x, y = _rows(a.slice(lo, BOUND)), _rows(b.slice(lo, BOUND))
        out.append(np.fft.irfft(np.fft.rfft(x, axis=1) * np.fft.rfft(y, axis=1), n=x.shape[1], axis=1))
    whole = np.concatenate(out) if out else np.zeros((0, 0))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1) * whole.shape[1], pa.int32()), pa.array(whole.ravel()))


def unbind(c: Column, key: Column) -> Column:
    """What was bound with key, up to noise."""
    return bind(c, involution(key))


def unbind_relation(c: Column, source: Column, role: Column) -> Column:
    """The target of bind(bind(source, role), target), up to noise."""
    return unbind(unbind(c, source), role)


#: How numpy's default generator makes a start of a seed (its SeedSequence), and the step of its PCG64.
_FIRST, _THEN, _LEFT, _RIGHT, _STEP = (0x43B0D7E5, 0x931E8875), (0x8B51F9DD, 0x58F38DED), 0xCA01F9DD, 0x4973F715, 0x2360ED051FC65DA44385DF649FCCF645


def _starts(seeds: np.ndarray) -> list[list[int]]:
    """Four numbers for each seed (unsigned, 64 bits), as np.random.SeedSequence(seed).generate_state(4, np.uint64) gives them."""
    u, shift = np.uint32, np.uint32(16)

    def hashing(constant: int, factor: int):
        def hashed(x: np.ndarray) -> np.ndarray:
            nonlocal constant
            x = x ^ u(constant)
            constant = constant * factor % 2**32
            x = x * u(constant)
            return x ^ x >> shift

        return hashed

    hashed = hashing(*_FIRST)
    seeds = np.ascontiguousarray(seeds, "<u8").view("<u4").reshape(-1, 2)
    pool = [hashed(x) for x in (seeds[:, 0], seeds[:, 1], np.zeros(len(seeds), u), np.zeros(len(seeds), u))]
    for i in range(4):
        for k in range(4):
            if i != k:
                x = u(_LEFT) * pool[k] - u(_RIGHT) * hashed(pool[i])
                pool[k] = x ^ x >> shift
    hashed = hashing(*_THEN)
    return np.stack([hashed(pool[k % 4]) for k in range(8)], axis=1).astype("<u4").view("<u8").tolist()


def unit_vectors(seeds: np.ndarray, dimension: int) -> np.ndarray:
    """A row for each seed (unsigned, 64 bits): np.random.default_rng(seed).standard_normal(dimension) at length 1.

    One generator is put to each seed's start, since making one takes far longer than drawing.
    """
    out, bits = np.empty((len(seeds), dimension)), np.random.PCG64(0)
    draw, state, whole = np.random.Generator(bits).standard_normal, bits.state, 2**128
    for row, (a, b, c, d) in zip(out, _starts(seeds)):
        inc = ((c << 64 | d) << 1 | 1) % whole
        state["state"] = {"state": (((a << 64 | b) + inc) * _STEP + inc) % whole, "inc": inc}
        bits.state = state
        draw(out=row)
    return out / np.sqrt([v @ v for v in out]).reshape(-1, 1) if len(out) else out


def random_vectors(dimension: int):
    """A column function from a decimal seed to its unit vector, by numpy's default generator."""

    @F.pandas_udf("array<double>")
    def draw(seed: pd.Series) -> pd.Series:
        return pd.Series(list(unit_vectors(np.array(list(map(int, seed)), np.uint64), dimension)))

    return draw
