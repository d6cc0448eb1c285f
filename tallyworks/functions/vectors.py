"""Vector arithmetic with higher-order functions, and the hash embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.numbers import col


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: str | Column) -> Column:
    """L2-normalised vector; a zero vector stays zero (MTH-04)."""
    n = norm(v)
    safe = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(col(v), lambda x: x.cast("double") / safe)


def cosine(a: str | Column, b: str | Column) -> Column:
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(den, F.lit(0.0)))


def mean_vectors(df: DataFrame, key: str, vector: str, out: str = "centroid") -> DataFrame:
    """Mean vector per key (MTH-04); rows without a key or a vector are left out.

    One running sum per key and task, combined after the shuffle.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, array_to_vector(vector).alias("_v"))
    return rows.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias(out))


def hash_embed(text: str | Column, dim: int = 128) -> Column:
    """Token counts in blake2b buckets, L2-normalised (ML-06); Arrow batches, one text at a time as a Python string."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: dict[str, int] = {}
        for s in batches:
            rows = np.zeros((len(s), dim), dtype=np.float32)
            for v, t in zip(rows, s):
                for w in (t.as_py() or "").lower().split():
                    b = seen.get(w)
                    if b is None:
                        if len(seen) > 200_000:
                            seen.clear()
                        b = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % dim
                        seen[w] = b
                    v[b] += 1.0
                n = float(np.linalg.norm(v))
                if n:
                    v /= n
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * dim), pa.array(rows.ravel()))

    return embed(col(text))
