"""Many vector searches at once, by blocks of queries against blocks of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries that one task compares at once, on average.
ROWS, QUERIES = 20_000, 2_000
#: Two distances that round to the same 6 decimals differ by no more than ``STEP``; pairs whose exact distances are held at once.
STEP, PAIRS = 1.001e-6, 50_000


def knn_batch(vectors: DataFrame, asked: Column, k: int) -> DataFrame:
    """query_id, id, distance, place of the ``k`` nearest of (id, embedding) for each row that is ``asked``, itself left out.

    All vectors have one length. A block of queries meets a block of rows in one task, so a query is sent once for each
    20,000 rows; the best of the blocks are merged. Ties by id; distances are rounded to 6 decimals.
    """
    sizes = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("q")).first()
    across, down = max(1, -(-sizes["n"] // ROWS)), max(1, -(-sizes["q"] // QUERIES))
    rows = vectors.withColumn("x", F.pmod(F.xxhash64("id"), F.lit(across)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    left = vectors.where(asked).select(F.col("id"), F.col("embedding")).withColumn("y", F.pmod(F.xxhash64("id"), F.lit(down)).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return schema.empty_table()
        b = b.sort_by("id")
        matrix = lambda t: t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)
        q, m = matrix(a), matrix(b)
        own, other, found = a["id"].to_numpy(), b["id"].to_numpy(), []
        lengths = (m**2).sum(1)
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            sizes = (part**2).sum(1)
            square = sizes[:, None] + lengths - 2 * part @ m.T
            square[own[at : at + 256, None] == other] = np.inf
            n = min(k, len(m))
            edge = np.partition(square, n - 1, axis=1)[:, n - 1]
            # all that may round to the distance of the last one or less, however many; squares from products are off by no more than ``slip``
            slip = 8 * (m.shape[1] + 4) * np.finfo(np.float64).eps * (sizes + lengths.max())
            edge = (np.sqrt(np.maximum(edge, 0) + slip) + STEP) ** 2 + slip
            r, c = np.nonzero((square <= edge[:, None]) & np.isfinite(square))
            exact = np.empty(len(r))
            for i in range(0, len(r), PAIRS):
                exact[i : i + PAIRS] = np.round(np.sqrt(((m[c[i : i + PAIRS]] - part[r[i : i + PAIRS]]) ** 2).sum(1)), 6)
            by = np.lexsort((other[c], exact, r))
            r, c, exact = r[by], c[by], exact[by]
            kept = np.arange(len(r)) - np.searchsorted(r, r) < k
            found.append((own[at + r[kept]], other[c[kept]], exact[kept]))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], schema=schema)

    left = left.toDF("id", "embedding", "y", "x")
    met = left.groupBy("x", "y").cogroup(rows.select("id", "embedding", "x", "y").toDF("id", "embedding", "x", "y").groupBy("x", "y")).applyInArrow(meet, "query_id long, id long, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
