"""Most similar vectors for every vector: a hierarchical k-means tree, searched best bin first.

The tree is fit on a bounded sample, its bins hold all vectors. A query takes the nearest node out of a priority
queue and goes on to bins that are not much farther than its first one; how much, and how many bins at most, is widened until a
sample of queries reaches the wanted recall against brute force. Equal vectors are one entry that stands for its smallest keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliodex.session import stage

#: The lengths of the vectors of each model.
DIMENSIONS = {"local-small-64": 64, "online-mid-96": 96}
#: Vectors of a model that its tree is fit on: so many for each bin, but no fewer and no more; and queries that calibrate it at most.
PER_BIN, FEWEST, SAMPLE, QUERIES = 40, 20_000, 200_000, 1_000
#: Children of a node, rounds of k-means.
BRANCHES, ROUNDS = 12, 8
RECALL = 0.99
#: Members and visitors of a bin that one task compares at once: a query is sent once for each bin it visits, unless the bin is fuller.
MEMBERS, VISITORS = 4_000, 30_000
#: Neighbours by single precision that are compared in double precision, and what single precision may be off.
CLOSE, OFF = 24, 4e-6
#: Cosines count in millionths.
MILLION = 1_000_000


def bin_size(n: int) -> int:
    """Vectors a bin of ``n`` should hold: few enough to tell them apart, as many as keep a query from visiting too many bins, and never more than ``MEMBERS``."""
    return min(MEMBERS, max(200, round(6 * n**0.5)))


@dataclass
class Tree:
    """Nodes in arrays: centroids, first child and number of children (0 of a bin)."""

    centroids: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def visits(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` first bins (-1 where there are fewer) that best-bin-first search takes out for each query, and their squared distances.

        All queries move on together; a row of ``near`` is one query's priority queue.
        """
        n, width = len(queries), int(self.count.max(initial=1))
        out, apart, seen = np.full((n, most), -1), np.full((n, most), np.inf), np.zeros(n, np.int64)
        near, node, used = np.full((n, width + 1), np.inf), np.zeros((n, width + 1), np.int64), np.ones(n, np.int64)
        near[:, 0] = 0
        rows = np.arange(n)
        while True:
            at = near[rows, :].argmin(1)
            live = np.isfinite(near[rows, at]) & (seen[rows] < most)
            rows, at = rows[live], at[live]
            if not len(rows):
                return out, apart
            taken, far_ = node[rows, at], near[rows, at]
            near[rows, at] = np.inf
            bins = self.count[taken] == 0
            out[rows[bins], seen[rows[bins]]] = taken[bins]
            apart[rows[bins], seen[rows[bins]]] = far_[bins]
            seen[rows[bins]] += 1
            r, t = rows[~bins], taken[~bins]
            if len(r):
                child = self.first[t][:, None] + np.arange(width)
                real = np.arange(width) < self.count[t][:, None]
                child = np.where(real, child, 0)
                c = self.centroids[child]
                far = ((c - queries[r][:, None, :]) ** 2).sum(2)
                if (need := int(used[r].max()) + width) > near.shape[1]:
                    more = need + 4 * width - near.shape[1]
                    near = np.concatenate([near, np.full((n, more), np.inf)], 1)
                    node = np.concatenate([node, np.zeros((n, more), np.int64)], 1)
                slot = used[r][:, None] + np.arange(width)
                near[r[:, None], slot] = np.where(real, far, np.inf)
                node[r[:, None], slot] = child
                used[r] += width

    def near_bins(self, queries: np.ndarray, most: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Query and bin of the visits: those of the ``most`` first bins that are no farther than ``slack`` times the first."""
        order, apart = self.visits(queries, most)
        row, place = np.nonzero((order >= 0) & (apart <= slack**2 * apart[:, :1] + 1e-12))
        return row, order[row, place]

    def bin_of(self, vectors: np.ndarray) -> np.ndarray:
        """The bin of each vector: down to the nearest child until there is none."""
        at = np.zeros(len(vectors), np.int64)
        width = int(self.count.max(initial=1))
        while len(inner := np.flatnonzero(self.count[at])):
            child = self.first[at[inner]][:, None] + np.arange(width)
            real = np.arange(width) < self.count[at[inner]][:, None]
            far = ((self.centroids[np.where(real, child, 0)] - vectors[inner][:, None, :]) ** 2).sum(2)
            at[inner] = child[np.arange(len(inner)), np.where(real, far, np.inf).argmin(1)]
        return at


def _kmeans(points: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """Each point's cluster after some rounds of k-means."""
    centers = points[random.choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        of = ((centers**2).sum(1) - 2 * points @ centers.T).argmin(1)
        sums = np.zeros((k, points.shape[1]))
        np.add.at(sums, of, points)
        sizes = np.bincount(of, minlength=k)
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
    return of


def fit_tree(points: np.ndarray, least: int) -> Tree:
    """A tree over the sample with bins of about ``least`` sampled points or fewer."""
    random = np.random.default_rng(7)
    centroids, first, count = [points.mean(0)], [0], [0]
    open_ = [(0, points)]
    while open_:
        at, own = open_.pop()
        if len(own) <= max(least, 1):
            continue
        of = _kmeans(own, min(BRANCHES, -(-len(own) // max(least, 1)) + 1, len(own)), random)
        kinds = np.unique(of)
        if len(kinds) < 2:
            continue
        first[at], count[at] = len(centroids), len(kinds)
        for c in kinds:
            open_.append((len(centroids), own[of == c]))
            centroids.append(own[of == c].mean(0))
            first.append(0)
            count.append(0)
    return Tree(np.array(centroids), np.array(first), np.array(count))


def matrix(packed: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Packed vectors as the rows of a matrix."""
    return np.frombuffer(b"".join(packed.to_pylist()), np.float32).reshape(-1, dims).astype(np.float64)


def usable(df: DataFrame, key: str, model: str, vector: str, dimensions: dict[str, int]) -> DataFrame:
    """(model, key, v) of the vectors that take part, cut or filled up with zeros to their model's length; ``v`` is their 32-bit values as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = batch.column(0).to_numpy(zero_copy_only=False)
            for m in set(models.tolist()) & set(dimensions):
                part = batch.take(pa.array(np.flatnonzero(models == m)))
                d, own = dimensions[m], part.column(2)
                sizes = np.diff(own.offsets.to_numpy())
                flat = own.flatten().to_numpy(zero_copy_only=False).astype(np.float32)  # a null is no number
                row = np.repeat(np.arange(len(part)), sizes)
                at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                values = np.zeros((len(part), d), np.float32)
                values[row[at < d], at[at < d]] = flat[at < d]
                kept = np.flatnonzero(np.isfinite(values).all(1) & values.any(1))
                data = pa.array([v.tobytes() for v in values[kept]], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(kept)) for i in (0, 1)), data], names=["model", "key", "v"])

    rows = df.where(df[key].isNotNull() & df[model].isin(list(dimensions)) & (F.size(df[vector]) > 0)).select(df[model].alias("model"), df[key].cast("long").alias("key"), df[vector].cast("array<float>").alias("v"))
    return rows.mapInArrow(pack, "model string, key long, v binary").groupBy("model", "key").agg(F.max("v").alias("v"))


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` highest scores of each row; of equal ones the first columns."""
    n = scores.shape[1]
    ranked = scores * n - np.arange(n)
    k = min(k, n)
    at = np.argpartition(-ranked, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(scores), 1))
    return np.repeat(np.arange(len(scores)), k), at.ravel()


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows with all rows in millionths, in double precision."""
    a, b = a / np.sqrt((a**2).sum(1))[:, None], b / np.sqrt((b**2).sum(1))[:, None]
    return np.rint(a @ b.T * MILLION).astype(np.int64)


def nearest(a: np.ndarray, b: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and cosines (millionths) of the ``k`` highest of each row of ``a`` with all of ``b``, ``floor`` at least; of equal ones the first columns.

    Single precision finds those that can be among the highest, double precision decides.
    """
    a, b = _unit(a), _unit(b)
    fast = b.astype(np.float32).T.copy()
    out = []
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        scores = part.astype(np.float32) @ fast
        least = np.full(len(part), floor / MILLION - OFF, np.float32)
        if scores.shape[1] > 4 * CLOSE:
            some = scores[:, :: max(1, scores.shape[1] // 1024)]
            if some.shape[1] > k:  # the k-th of some columns is a bound for all
                least = np.maximum(least, np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k] - np.float32(OFF))
        r, c = np.nonzero(scores >= least[:, None])
        near = scores[r, c]
        by = np.lexsort((-near, r))
        r, c, near = r[by], c[by], near[by]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        # what may tie with the CLOSE-th stays too
        edge = np.full(len(part), -np.inf, np.float32)
        last = place == CLOSE - 1
        edge[r[last]] = near[last] - np.float32(OFF)
        kept = near >= edge[r]
        r, c = r[kept], c[kept]
        exact = np.rint(np.einsum("ij,ij->i", part[r], b[c]) * MILLION).astype(np.int64)
        by = np.lexsort((c, -exact, r))
        r, c, exact = r[by], c[by], exact[by]
        kept = (np.arange(len(r)) - np.searchsorted(r, r) < k) & (exact >= floor)
        out.append((r[kept] + at, c[kept], exact[kept]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m**2).sum(1))[:, None]


def _index(entries: DataFrame, k: int, least: int, dimensions: dict[str, int]) -> tuple[dict[str, Tree], dict[str, tuple[int, float]], DataFrame]:
    """The tree of each model, how many bins to visit at most and how much farther than the first, and all entries with their bins."""
    sizes = {r["model"]: r["count"] for r in entries.groupBy("model").count().collect()}  # one row for each known model
    trees: dict[str, Tree] = {}
    asked: dict[str, pa.Table] = {}
    for m, n in sizes.items():
        drawn = entries.where(F.col("model") == m).orderBy(F.xxhash64("v", F.lit(1)), "entry").limit(min(SAMPLE, max(FEWEST, PER_BIN * n // bin_size(n)), n)).select("entry", "v").toArrow()
        points = _unit(matrix(drawn["v"], dimensions[m]))
        trees[m] = fit_tree(points, max(1, bin_size(n) * len(points) // n))
        asked[m] = drawn.slice(0, QUERIES)
    queries = {m: (matrix(t["v"], dimensions[m]), t["entry"].to_numpy()) for m, t in asked.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = batch.column(0).to_numpy(zero_copy_only=False)
            for m in set(models.tolist()):
                part = batch.take(pa.array(np.flatnonzero(models == m)))
                bins = trees[m].bin_of(_unit(matrix(part.column(2), dimensions[m])))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bins)], names=["model", "entry", "v", "bin"])

    placed = stage(entries.mapInArrow(place, "model string, entry long, v binary, bin long"), "knn-bins")

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = batch.column(0).to_numpy(zero_copy_only=False)
            for m in set(models.tolist()):
                part = batch.take(pa.array(np.flatnonzero(models == m)))
                q, at, s = nearest(queries[m][0], matrix(part.column(2), dimensions[m]), k + 1, least)
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(q)), pa.array(q), part.column(1).take(pa.array(at)), part.column(3).take(pa.array(at)), pa.array(s)], names=["model", "query", "entry", "bin", "score"])

    best = Window.partitionBy("model", "query").orderBy(F.desc("score"), "entry")
    near = placed.mapInArrow(truth, "model string, query long, entry long, bin long, score long")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).toPandas()  # at most QUERIES * (k + 1) rows of a model
    visits = {}
    for m, tree in trees.items():
        own = near[near["model"] == m]
        own = own[own["entry"].to_numpy() != queries[m][1][own["query"].to_numpy()]]
        most = int((tree.count == 0).sum())
        if not len(own):
            visits[m] = min(most, 4), 1.0
            continue
        widest = min(most, 4)
        while True:
            order, apart = tree.visits(_unit(queries[m][0]), widest)
            of = own["query"].to_numpy()
            hit = order[of] == own["bin"].to_numpy()[:, None]
            met = hit.any(1)
            # how much farther than the first bin the bin of each true neighbour lies; those not met are beyond all
            ratio = np.sqrt(np.where(met, (apart[of] * hit).max(1, where=hit, initial=0), np.inf) / np.maximum(apart[of, 0], 1e-12))
            if met.mean() >= RECALL + (1 - RECALL) / 2 or widest == most:
                needed = np.sort(ratio)[max(0, int(np.ceil(RECALL * len(ratio))) - 1)]
                visits[m] = widest, float(needed if np.isfinite(needed) else ratio[met].max(initial=1.0)) + 1e-6
                break
            widest = min(most, widest * 2)
    return trees, visits, placed


def neighbours(df: DataFrame, key: str, model: str, vector: str, k: int = 5, least: float = 0.8, dimensions: dict[str, int] | None = None) -> DataFrame:
    """(model, key, neighbour, cosine, place): the ``k`` most similar other keys of the same model with a cosine of ``least`` or more.

    The cosine is taken in double precision and rounded to 6 decimals; of equal ones the smaller key comes first.
    Null, empty and zero vectors, those that hold NaN, infinity or null, null keys and unknown models do not take
    part; vectors are cut or filled up with zeros to the model's length in ``dimensions``. Of several vectors of one
    key and model, that with the greatest bytes counts. Other columns are not read. Some true neighbours are missing: visits
    are widened until ``RECALL`` of those of a sample are found.
    """
    dimensions = dimensions or DIMENSIONS
    rows = stage(usable(df, key, model, vector, dimensions), "knn-vectors")
    floor = round(least * MILLION)
    # equal vectors are one entry, known by its smallest key, and stand for their k + 1 smallest keys
    salted = rows.select("model", "key", "v", F.xxhash64("v").alias("digest"), F.hash("v").alias("check"), F.pmod(F.xxhash64("key"), F.lit(64)).alias("salt"))
    of_vector = salted.groupBy("model", "digest", "check").agg(F.min("key").alias("entry"))
    members = salted.select("model", "key", "digest", "check", "salt").join(of_vector, ["model", "digest", "check"]).drop("digest", "check")
    members = stage(members, "knn-members")
    entries = stage(rows.join(of_vector.select("model", F.col("entry").alias("key")), ["model", "key"], "left_semi").select("model", F.col("key").alias("entry"), "v"), "knn-entries")
    trees, visits, placed = _index(entries, k, floor, dimensions)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                models = batch.column(0).to_numpy(zero_copy_only=False)
                for m in set(models.tolist()):
                    part = batch.take(pa.array(np.flatnonzero(models == m)))
                    row, bins = trees[m].near_bins(_unit(matrix(part.column(2), dimensions[m])), *visits[m])
                    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32()), pa.array(bins))
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], names=["model", "entry", "v", "bins"])

    # a bin with many members or visitors is cut into cells by hashes; there are no more bins than sampled vectors
    spread = lambda of, n: F.pmod(F.xxhash64("entry"), F.ceil(F.col(of) / n))
    going = placed.select("model", "entry", "v").mapInArrow(visit, "model string, entry long, v binary, bins array<long>")
    going = stage(going, "knn-visits").select("model", "entry", "v", F.explode("bins").alias("bin"))
    callers = going.groupBy("model", "bin").agg(F.count(F.lit(1)).alias("visits"))
    load = placed.groupBy("model", "bin").agg(F.count(F.lit(1)).alias("members")).join(callers, ["model", "bin"])
    load = stage(load, "knn-load")
    cells = F.explode(F.sequence(F.lit(0), F.ceil(F.col("members") / MEMBERS).cast("int") - 1))
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("visits") / VISITORS).cast("int") - 1))
    inside = placed.join(load, ["model", "bin"]).withColumn("x", spread("members", MEMBERS).cast("int")).withColumn("y", parts)
    going = going.join(load, ["model", "bin"]).withColumn("y", spread("visits", VISITORS).cast("int")).withColumn("x", cells)

    def meet(key_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("model", pa.string()), ("entry", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        m = key_[0].as_py()
        right = right.sort_by("entry")
        a, b = matrix(left["v"], dimensions[m]), matrix(right["v"], dimensions[m])
        own, other = left["entry"].to_numpy(), right["entry"].to_numpy()
        q, c, score = nearest(a, b, k + 1, floor)
        return pa.Table.from_arrays([pa.array([m] * len(q), pa.string()), pa.array(own[q]), pa.array(other[c]), pa.array(score)], schema=schema)

    met = going.select("model", "bin", "x", "y", "entry", "v").groupBy("model", "bin", "x", "y").cogroup(inside.select("model", "bin", "x", "y", "entry", "v").groupBy("model", "bin", "x", "y")).applyInArrow(meet, "model string, entry long, other long, score long")
    best = Window.partitionBy("model", "entry").orderBy(F.desc("score"), "other")
    closest = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")
    few = Window.partitionBy("model", "entry", "salt").orderBy("key")
    fewer = Window.partitionBy("model", "entry").orderBy("key")
    shown = members.withColumn("i", F.row_number().over(few)).where(F.col("i") <= k + 1).withColumn("i", F.row_number().over(fewer)).where(F.col("i") <= k + 1)
    options = closest.join(shown.select("model", F.col("entry").alias("other"), F.col("key").alias("neighbour")), ["model", "other"])
    first = Window.partitionBy("model", "entry").orderBy(F.desc("score"), "neighbour")
    options = options.withColumn("i", F.row_number().over(first)).where(F.col("i") <= k + 1).select("model", "entry", "neighbour", "score")
    found = members.select("model", "entry", "key").join(options, ["model", "entry"]).where("key <> neighbour")
    place = Window.partitionBy("model", "key").orderBy(F.desc("score"), "neighbour")
    return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select("model", F.col("key").alias(key), "neighbour", (F.col("score") / MILLION).alias("cosine"), "place")


def recall(df: DataFrame, found: DataFrame, key: str, model: str, vector: str, k: int = 5, least: float = 0.8, dimensions: dict[str, int] | None = None, modulus: int = 100) -> float:
    """The share of the true neighbours of the keys divisible by ``modulus`` that ``found`` has, against brute force.

    The queries are sent to all rows in blocks.
    """
    dimensions = dimensions or DIMENSIONS
    rows = stage(usable(df, key, model, vector, dimensions), "knn-recall")
    queries = rows.where(F.col("key") % modulus == 0)
    blocks = 64
    floor = round(least * MILLION)
    left = queries.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("x", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))

    def meet(key_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("model", pa.string()), ("key", pa.int64()), ("neighbour", pa.int64()), ("score", pa.int64())])
        if not len(a) or not len(b):
            return schema.empty_table()
        m = key_[0].as_py()
        b = b.sort_by("key")
        own, other, out = a["key"].to_numpy(), b["key"].to_numpy(), []
        right_ = matrix(b["v"], dimensions[m])
        left_ = matrix(a["v"], dimensions[m])
        for at in range(0, len(own), 512):
            scores = _cosines(left_[at : at + 512], right_)
            scores[own[at : at + 512][:, None] == other[None, :]] = -MILLION
            q, c = _top(scores, k)
            kept = scores[q, c] >= floor
            out.append((own[at + q[kept]], other[c[kept]], scores[q, c][kept]))
        columns = [np.concatenate(x) for x in zip(*out)]
        return pa.Table.from_arrays([pa.array([m] * len(columns[0]), pa.string()), *map(pa.array, columns)], schema=schema)

    met = left.groupBy("model", "x").cogroup(right.groupBy("model", "x")).applyInArrow(meet, "model string, key long, neighbour long, score long")
    best = Window.partitionBy("model", "key").orderBy(F.desc("score"), "neighbour")
    true = met.withColumn("i", F.row_number().over(best)).where(F.col("i") <= k)
    got = found.select("model", F.col(key).alias("key"), "neighbour", F.lit(1).alias("hit"))
    share = true.join(got, ["model", "key", "neighbour"], "left").agg((F.count("hit") / F.count(F.lit(1))).alias("share")).first()["share"]
    return 1.0 if share is None else share
