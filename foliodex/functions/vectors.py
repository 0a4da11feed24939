"""Column functions on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fitted(vector: Column, dims: int) -> Column:
    """Cut or filled up with zeros to ``dims`` values; null stays null."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), dims)), 1, dims)


def usable(vector: Column) -> Column:
    """Whether a vector has values, all of them finite, and not only zeros."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (x * F.lit(0.0).cast("float") == F.lit(0.0).cast("float")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    n = norm(vector)
    return F.transform(vector, lambda x: F.when(n > 0, (x / n).cast("float")).otherwise(x))


def distance_to(query: list[float]):
    """A function of a vector column: the Euclidean distance to ``query``, vectors and query filled up with zeros to one length.

    Runs on whole Arrow batches; null vectors have no distance.
    """
    q = np.asarray(query, np.float64)

    def measure(vectors: pa.Array) -> pa.Array:
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        live = np.flatnonzero(~vectors.is_null().to_numpy(zero_copy_only=False))
        sizes = sizes[live]
        row = np.repeat(np.arange(len(live)), sizes)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        beside = np.where(at < len(q), q[np.minimum(at, len(q) - 1)], 0.0)
        squares = np.bincount(row, (flat - beside) ** 2, len(live)).astype(np.float64)
        tail = np.concatenate([np.cumsum((q**2)[::-1])[::-1], [0.0]])
        squares += tail[np.minimum(sizes, len(q))]
        out = np.full(len(vectors), np.nan)
        out[live] = np.sqrt(squares)
        return pa.array(out, pa.float64(), mask=np.isnan(out))

    return F.arrow_udf(measure, T.DoubleType())
