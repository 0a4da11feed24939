"""Documents into containers of fixed capacity: linear grouping for large items, best fit for small ones.

All decisions are made on histograms of sizes and of free space, which have at most ``capacity`` rows
however many documents there are; documents find their container from their rank, in Spark.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliodex.llm.ranks import ranked
from foliodex.llm.tokenize import token_counts
from foliodex.session import stage

CAPACITY = 2048
#: Items over this share of the capacity are large.
LARGE = 1 / 8
#: Groups of equal cardinality among the large items.
GROUPS = 20


def fullest(values: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, list[int]]:
    """The configuration of most value that fits: an unbounded knapsack over the capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = sorted(range(len(sizes)), key=lambda g: sizes[g])
    for room in range(sizes[order[0]], capacity + 1):
        best[room], took[room] = best[room - 1], -1
        for g in order:
            if sizes[g] > room:
                break
            if (v := best[room - sizes[g]] + values[g]) > best[room] + 1e-12:
                best[room], took[room] = v, g
    counts, room = [0] * len(sizes), capacity
    while room >= sizes[order[0]]:
        if (g := took[room]) < 0:
            room -= 1
        else:
            counts[g] += 1
            room -= sizes[g]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """How often to use which configuration of few sizes: the covering program by column generation, rounded down."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(40 * k):
        value, column = fullest(np.linalg.solve(basis.T, np.ones(k)), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        amount, change = np.linalg.solve(basis, need), np.linalg.solve(basis, np.array(column, float))
        ratio = np.where(change > 1e-9, np.maximum(amount, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    amount = np.linalg.solve(basis, need)
    left, chosen = list(demand), []
    for j in range(k):
        column = [round(x) for x in basis[:, j]]
        times = min([int(amount[j] + 1e-6), *(left[g] // c for g, c in enumerate(column) if c)])
        if times > 0:
            chosen.append((column, times))
            left = [n - times * c for n, c in zip(left, column)]
    return chosen


def plan_large(histogram: list[tuple[int, int]], capacity: int) -> tuple[list[tuple], list[tuple], int]:
    """Ranges of ranks (first rank, items, items in a container, first container), the ranges left over as
    (size, first rank, items), and the number of containers. ``histogram``: (size, items), largest size first;
    an item's rank counts from the largest item."""
    placed, at, used = [], 0, 0
    if histogram and histogram[0][0] == capacity:
        placed.append((0, histogram[0][1], 1, 0))
        at = used = histogram[0][1]
        histogram = histogram[1:]
    large = [(s, n) for s, n in histogram if s > capacity * LARGE]
    ends = at + np.cumsum([n for _, n in large], dtype=np.int64) if large else np.empty(0, np.int64)
    total = int(ends[-1]) - at if large else 0
    rest: list[tuple[int, int, int]] = []

    def leave(first: int, last: int) -> None:
        """Keep the ranks from first to last for the best fit, by size."""
        while first < last:
            i = int(np.searchsorted(ends, first, "right"))
            stop = min(last, int(ends[i]))
            rest.append((large[i][0], first, stop - first))
            first = stop

    if total:
        cuts = sorted({at + total * g // GROUPS for g in range(GROUPS + 1)})
        groups = [(large[int(np.searchsorted(ends, a, "right"))][0], a, b) for a, b in zip(cuts, cuts[1:])]
        merged: list[list[int]] = []
        for s, a, b in groups:  # groups of one rounded size are one
            if merged and merged[-1][0] == s:
                merged[-1][2] = b
            else:
                merged.append([s, a, b])
        free = [a for _, a, _ in merged]
        for column, times in configurations([s for s, _, _ in merged], [b - a for _, a, b in merged], capacity):
            for g, c in enumerate(column):
                if c:
                    placed.append((free[g], c * times, c, used))
                    free[g] += c * times
            used += times
        for (_, _, b), a in zip(merged, free):
            leave(a, b)
    first = at + total
    for s, n in histogram[len(large) :]:
        rest.append((s, first, n))
        first += n
    return placed, rest, used


def plan_small(items: list[tuple[int, int, int]], room: list[tuple[int, int]], capacity: int, used: int) -> list[tuple]:
    """Best fit, largest first: (first rank, items, items in a container, class, first container).

    ``room``: (free space, containers); a container is known by its class, the free space it had at first,
    and its rank there. New containers have class -1 and follow ``used``."""
    classes: dict[int, list[list[int]]] = {r: [[r, 0, n]] for r, n in room if r > 0}
    sizes, placed, new = sorted(classes), [], used

    def put(r: int, segment: list[int]) -> None:
        if r > 0:
            if r not in classes:
                classes[r] = []
                insort(sizes, r)
            classes[r].append(segment)

    for s, first, n in sorted(items, key=lambda x: (-x[0], x[1])):
        while n:
            i = bisect_left(sizes, s)
            if i == len(sizes):
                q = capacity // s
                segment, r = [-1, new, -(-n // q)], capacity
                new += segment[2]
            else:
                r = sizes[i]
                q = r // s
                segment = classes[r].pop()
                if not classes[r]:
                    del classes[r]
                    sizes.pop(i)
            whole = min(segment[2], n // q)
            q, many = (q, whole) if whole else (n, 1)
            placed.append((first, q * many, q, segment[0], segment[1]))
            put(r - q * s, [segment[0], segment[1], many])
            if segment[2] > many:
                put(r, [segment[0], segment[1] + many, segment[2] - many])
            first, n = first + q * many, n - q * many
    return placed


def _lookup(df: DataFrame, plan: list[tuple]) -> DataFrame:
    """Each row of ``df`` (doc, piece, size, rank) with ``class`` and ``slot`` after the plan's ranges of ranks; a plan is bounded by the capacity."""
    table = np.array(sorted(plan), np.int64).reshape(-1, 5)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            at = np.searchsorted(table[:, 0], rows["rank"].to_numpy(), "right") - 1
            hit = table[np.maximum(at, 0)] if len(table) else np.zeros((len(rows), 5), np.int64)
            inside = (at >= 0) & (rows["rank"].to_numpy() < hit[:, 0] + hit[:, 1])
            slot = hit[:, 4] + (rows["rank"].to_numpy() - hit[:, 0]) // np.maximum(hit[:, 2], 1)
            yield rows.assign(**{"class": np.where(inside, hit[:, 3], -2), "slot": slot})

    return df.mapInPandas(assign, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, class long, slot long")


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``key``, ``piece``, ``n_tokens`` and ``container`` of each row of ``df``, or of each piece of a text over the capacity.

    Pieces count from 0; all but the last of a text are full. A row without tokens (null or empty text) needs no
    room: its container is null. Each row is packed, also where ``key`` is null or repeats. Other columns are not read.
    """
    counted = token_counts(df.select(df[key].alias("doc"), df[text].alias("text")), "doc", "text", path)
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0))
    items = stage(
        counted.select("doc", "n_tokens", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece")).select(
            "doc", "piece", F.least(F.col("n_tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("size")
        ),
        "pack-items",
    )
    histogram = sorted(((r["size"], r["count"]) for r in items.groupBy("size").count().collect()), reverse=True)  # at most capacity + 1 rows
    rows = sum(n for _, n in histogram)
    histogram = [(s, n) for s, n in histogram if s > 0]
    large, rest, used = plan_large(histogram, capacity)
    starts = np.cumsum([0, *(n for _, n in histogram)]).tolist()
    base = [(s, b) for (s, _), b in zip(histogram, starts)]
    begin = df.sparkSession.createDataFrame(base, "size long, begin long")  # at most capacity rows
    by_rank = (
        ranked(items.where("size > 0"), "size", ["doc", "piece"], rows, "number")
        .join(F.broadcast(begin), "size")
        .select("doc", "piece", "size", (F.col("number") + F.col("begin")).alias("rank"))
    )
    first = stage(_lookup(by_rank, [(a, n, q, 0, c) for a, n, q, c in large]), "pack-large")
    placed, left = first.where("class = 0").drop("class", "rank"), first.where("class = -2").drop("class", "slot")
    filled = placed.groupBy("slot").agg((F.lit(capacity) - F.sum("size")).alias("free")).where("free > 0")
    room = [(r["free"], r["count"]) for r in filled.groupBy("free").count().collect()]  # at most capacity rows
    second = _lookup(left, plan_small(rest, room, capacity, used))
    known = ranked(filled, "free", ["slot"], sum(n for _, n in room)).select(F.col("free").alias("class"), F.col("rank").alias("slot"), F.col("slot").alias("container"))
    small = second.join(known, ["class", "slot"], "left").select("doc", "piece", "size", F.when(F.col("class") == -1, F.col("slot")).otherwise(F.col("container")).alias("container"))
    result = (
        placed.select("doc", "piece", "size", F.col("slot").alias("container"))
        .unionByName(small)
        .unionByName(items.where("size = 0").withColumn("container", F.lit(None).cast("long")))
    )
    return result.select(F.col("doc").alias(key), F.col("piece").cast("int").alias("piece"), F.col("size").alias("n_tokens"), "container")
