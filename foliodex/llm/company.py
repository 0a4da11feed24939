"""The company words keep, as skip-gram vectors, and how glyphs are misread, learned from words in like company.

Skip-gram with negative sampling factorises the table of words and neighbours whose cells are their pointwise mutual
information, shifted by the logarithm of the number of negative samples. Here that table is factorised itself, for as many frequent
words as ``CONTEXTS`` says; any other word gets the vector its own neighbours lead to in the same factors. So vectors come from
all pairs, and the model stays small whatever the data.

Misreadings are learned from pairs of a rare word of the scans and a frequent word that differ in one place and stand in like
company. An edit counts by how much more often it makes such pairs than it makes pairs with rare words of texts that are no scans.
All pairs and all such words count; they are added up in tasks, and the driver gets sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliodex.session import stage

#: Frequent words that the table of company is factorised for, factors, negative samples, and neighbours to either side.
CONTEXTS, DIMENSIONS, NEGATIVES, WINDOW = 1000, 32, 1, 2
#: Letters of a word that misreadings are learned from, and the least cosine of two words in like company.
LETTERS, LIKE = 5, 0.1
#: What company counts at most for or against a link.
MOST = 3.0
#: Longer words meet by known edits only.
LONGEST = 64
#: Edits of two glyphs are looked for in words of up to so many letters.
TWICE = 40


def neighbours(words: list[str], ids: dict[str, int]) -> Iterator[tuple[str, int]]:
    """Skip-gram pairs: each word with the numbers of the known words up to ``WINDOW`` places away."""
    known = [ids.get(w, -1) for w in words]
    for i, w in enumerate(words):
        for c in known[max(0, i - WINDOW) : i] + known[i + 1 : i + 1 + WINDOW]:
            if c >= 0:
                yield w, c


@dataclass
class Company:
    """The factors of the table: the words' numbers, their share of all neighbours, their factors, and the factors' sizes."""

    ids: dict[str, int]
    shares: np.ndarray
    contexts: np.ndarray
    sizes: np.ndarray

    def cells(self, near: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Positive shifted mutual information of words that stand ``n`` of ``total`` times beside ``near``."""
        return np.maximum(0.0, np.log(n / (total * self.shares[near])) - np.log(NEGATIVES))

    def fold(self, starts: np.ndarray, near: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Vectors of words with the neighbours from each start on."""
        sizes = np.diff(np.append(starts, len(near)))
        of = np.repeat(np.arange(len(starts)), sizes)
        total = np.bincount(of, n, len(starts))[of]
        out = np.zeros((len(starts), len(self.sizes)))
        np.add.at(out, of, self.cells(near, n, total)[:, None] * self.contexts[near])
        return out / self.sizes

    def fit_of(self, vector: list[float], near: list[str]) -> float:
        """How well a word with this vector stands beside others: its mean cosine with their factors."""
        at = [self.ids[w] for w in near if w in self.ids]
        u, c = np.asarray(vector), self.contexts[at]
        size = np.sqrt((u @ u) * (c**2).sum(1))
        return float(((c @ u) / np.where(size > 0, size, 1)).mean()) if at else 0.0


def fit_company(counted: DataFrame, frequent: list[str]) -> Company:
    """The model of pair counts (word, near, n), ``near`` being numbers of ``frequent`` words, at most ``CONTEXTS``."""
    k = len(frequent)
    ids = {w: i for i, w in enumerate(frequent)}
    beside = np.full(k, 1e-9)
    for r in counted.groupBy("near").agg(F.sum("n").alias("n")).collect():  # one row for each frequent word
        beside[r["near"]] = r["n"]
    shares = beside / beside.sum() if k else beside
    own = counted.where(F.col("word").isin(frequent)).toPandas()  # at most CONTEXTS * CONTEXTS rows
    table, model = np.zeros((k, k)), Company(ids, shares, np.zeros((k, 0)), np.zeros(0))
    if len(own):
        at, near, n = own["word"].map(ids).to_numpy(), own["near"].to_numpy(), own["n"].to_numpy(float)
        table[at, near] = model.cells(near, n, np.bincount(at, n, k)[at])
    squares, left = np.linalg.eigh(table @ table.T)
    d = min(DIMENSIONS, int((squares > 1e-9).sum()))
    sizes, left = np.sqrt(squares[::-1][:d]), left[:, ::-1][:, :d]
    return Company(ids, shares, table.T @ left / np.sqrt(sizes), sizes)


def word_vectors(counted: DataFrame, model: Company) -> DataFrame:
    """(word, vector) of all words of pair counts (word, near, n)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1)
            flat, offsets = own.flatten(), own.offsets.to_numpy()
            found = model.fold(offsets[:-1] - offsets[0], flat.field("near").to_numpy(), flat.field("n").to_numpy().astype(float))
            d = found.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d * (len(found) + 1), d) if d else np.zeros(len(found) + 1, int), pa.int32()), pa.array(found.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["word", "vector"])

    listed = counted.groupBy("word").agg(F.collect_list(F.struct("near", "n")).alias("own"))  # no more than CONTEXTS of a word
    return listed.mapInArrow(compute, "word string, vector array<float>")


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; null where one is missing or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t), F.lit(0.0), lambda s, t: s + t)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def edit(seen: str, meant: str) -> tuple[str, str]:
    """What stands between the common beginning and the common end of two words."""
    i, most = 0, min(len(seen), len(meant))
    while i < most and seen[i] == meant[i]:
        i += 1
    j = 0
    while j < most - i and seen[-1 - j] == meant[-1 - j]:
        j += 1
    return seen[i : len(seen) - j], meant[i : len(meant) - j]


def is_misreading(seen: str, meant: str, hyphens: str) -> bool:
    """Whether an edit is one of glyphs: no hyphen comes or goes, nothing appears from nothing, and letters do not only change places, which is a typing error."""
    return bool(seen and meant) and not any(c in hyphens for c in seen + meant) and sorted(seen) != sorted(meant)


def one_place_apart(words: DataFrame, frequent: DataFrame) -> DataFrame:
    """(word, origin, ...) of words and frequent words (origin, often), both of ``LETTERS`` to ``LONGEST`` letters, that differ by one or two glyphs in one place.

    They meet by what is left when these glyphs are gone.
    """
    rest = lambda c, k: F.transform(F.sequence(F.lit(0), F.char_length(c) - k), lambda i: F.concat(F.substring(c, F.lit(1), i), F.lit("*"), F.substring(c, i + k + 1, F.char_length(c))))
    rests = lambda c: F.explode(F.array_distinct(F.concat(rest(c, 1), rest(c, 2))))
    long = lambda df, c: df.where(F.char_length(c).between(LETTERS, LONGEST)).withColumn("rest", rests(F.col(c)))
    met = long(words, "word").join(long(frequent, "origin"), "rest").drop("rest")
    return met.where("word <> origin").distinct()


@dataclass
class Misreadings:
    """Weights of glyph edits (seen, meant), and mean and deviation of cosines of words in like and in unlike company."""

    weights: dict[tuple[str, str], float]
    like: tuple[float, float]
    unlike: tuple[float, float]

    def of_company(self, cosine_: Column) -> Column:
        """Log-likelihood ratio of a cosine, ``MOST`` either way as company is a weak witness of a rare word; 0 of a missing one."""
        (m, s), (n, t) = self.like, self.unlike
        ratio = (cosine_ - n) ** 2 / (2 * t * t) - (cosine_ - m) ** 2 / (2 * s * s) + float(np.log(t / s))
        return F.when(cosine_.isNull(), 0.0).when(ratio > MOST, MOST).when(ratio < -MOST, -MOST).otherwise(ratio)

    @cached_property
    def by_seen(self) -> dict[str, list[tuple[str, float]]]:
        """What each run of glyphs may have been, with weights; a word is not held against every edit."""
        out: dict[str, list[tuple[str, float]]] = {}
        for (seen, meant), weight in self.weights.items():
            out.setdefault(seen, []).append((meant, weight))
        return out

    def origins(self, word: str) -> dict[str, float]:
        """Words that may have been misread as ``word`` by one or two known edits, and the weight of the weaker one."""
        sizes = sorted({len(seen) for seen in self.by_seen})
        places = [(at, at + n, meant, weight) for at in range(len(word)) for n in sizes for meant, weight in self.by_seen.get(word[at : at + n], ()) if at + n <= len(word)]
        found: dict[str, float] = {}
        for a, b, x, w in places:
            key = word[:a] + x + word[b:]
            found[key] = max(w, found.get(key, 0.0))
        if LETTERS <= len(word) <= TWICE:
            places.sort()
            for i, (a, b, x, w) in enumerate(places):
                for c, d, y, v in places[i + 1 :]:
                    if c >= b:
                        key = word[:a] + x + word[b:c] + y + word[d:]
                        found[key] = max(min(w, v), found.get(key, 0.0))
        found.pop(word, None)
        return found


def learn_misreadings(pairs: DataFrame, controls: DataFrame, n_odd: int, n_controls: int, hyphens: str) -> Misreadings:
    """From all pairs (word, origin, v, u) of rare words of scans with the only frequent word they are one place apart from and both vectors, and such pairs
    (word, origin) of ``n_controls`` rare words of other texts.

    ``n_odd`` rare words were asked. Unlike company is that of each word with the origins of all other words; as a squared product of vectors is a product of their
    squares, sums of these tell its moments without the pairs.
    """
    side = DIMENSIONS + 1
    unit = lambda m: m / np.maximum(np.sqrt((m**2).sum(1)), 1e-9)[:, None]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edit and cosine of each pair that may be a misreading, and by cell this task's sums over all pairs."""
        squares, own = np.zeros((2, side, side)), np.zeros(2)
        rows = lambda seen, meant, cell, near: pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(meant, pa.string()), pa.array(cell, pa.int32()), pa.array(near, pa.float64())], names=["seen", "meant", "cell", "near"])
        for batch in batches:
            if n := batch.num_rows:
                a, b = (unit(batch.column(i).flatten().to_numpy().astype(float).reshape(n, -1)) for i in (2, 3))
                near = (a * b).sum(1)
                own += near.sum(), (near**2).sum()
                for total, m in zip(squares, (a, b)):
                    m = np.column_stack([np.ones(n), m])
                    total[: m.shape[1], : m.shape[1]] += m.T @ m
                edits = [edit(w, o) for w, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                kept = [i for i, e in enumerate(edits) if is_misreading(*e, hyphens)]
                yield rows([edits[i][0] for i in kept], [edits[i][1] for i in kept], [None] * len(kept), near[kept])
        if squares[0, 0, 0]:
            cells = np.append(squares.ravel(), own)
            yield rows([None] * len(cells), [None] * len(cells), range(len(cells)), cells)

    def edits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = [edit(w, o) for w, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in edits], pa.string()), pa.array([y for _, y in edits], pa.string())], names=["seen", "meant"])

    near = F.col("near")
    compared = pairs.where((F.size("v") > 0) & (F.size("u") > 0)).select("word", "origin", "v", "u").mapInArrow(compare, "seen string, meant string, cell int, near double")
    summed = compared.groupBy("seen", "meant", "cell").agg(F.sum((near >= LIKE).cast("long")).alias("like"), F.count(F.lit(1)).alias("n"), F.sum(near).alias("total"), F.sum(near * near).alias("squares"))
    chance = controls.select("word", "origin").mapInArrow(edits_of, "seen string, meant string").groupBy("seen", "meant").agg(F.count(F.lit(1)).alias("chance"))
    by_chance = n_odd * (F.coalesce("chance", F.lit(0)) + 0.5) / (n_controls + 1000)  # as if half a pair had been made by 1000 more words
    weighed = summed.join(chance, ["seen", "meant"], "left").withColumn("weight", F.log((F.col("like") + 0.5) / (by_chance + 0.3)))
    found = weighed.where("cell is not null or like > 0 and weight > 1").collect()  # sums of a fixed number of cells, and the edits that count
    known = [r for r in found if r["cell"] is None]
    cells = np.zeros(2 * side * side + 2)
    for r in found:
        if r["cell"] is not None:
            cells[r["cell"]] = r["total"]
    (a, b), own = cells[:-2].reshape(2, side, side), cells[-2:]
    words = int(a[0, 0])
    like = sum(r["n"] for r in known), sum(r["total"] for r in known), sum(r["squares"] for r in known)
    unlike = words * (words - 1), a[0, 1:] @ b[0, 1:] - own[0], (a[1:, 1:] * b[1:, 1:]).sum() - own[1]

    def moments(n: int, total: float, squares: float) -> tuple[float, float]:
        mean = total / n
        return round(float(mean), 9), round(float(max(np.sqrt(max(squares / n - mean**2, 0.0)), 0.05)), 9)  # sums in any order give the same

    return Misreadings({(r["seen"], r["meant"]): r["weight"] for r in known}, moments(*like) if like[0] > 20 else (0.3, 0.25), moments(*unlike) if words > 20 else (0.05, 0.2))


def pair_counts(rows: DataFrame, words_of: Callable[[pa.RecordBatch], Iterator[list[str]]], frequent: list[str]) -> DataFrame:
    """(word, near, n): how often each word stands near each frequent one, given by number; ``words_of`` makes lists of words of a batch's columns."""
    ids = {w: i for i, w in enumerate(frequent)}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for words in words_of(batch):
                counts.update(neighbours(words, ids))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in counts], pa.string()), pa.array([c for _, c in counts], pa.int32()), pa.array(counts.values(), pa.int64())], names=["word", "near", "n"])

    return stage(rows.mapInArrow(pairs, "word string, near int, n long").groupBy("word", "near").agg(F.sum("n").alias("n")), "company-pairs")
