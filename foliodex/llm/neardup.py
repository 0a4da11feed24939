"""Near-duplicate texts through pivot distance tables.

A text's fingerprint has one bit of each of ``BITS`` min-hashes of its word shingles, so the Hamming distance of two
fingerprints tells how similar the texts are. Texts that share a key (a band of min-hashes) meet in a group; some of the group's
fingerprints are its references, and each member's distances to them its row of a distance table. By the triangle
inequality two fingerprints are at least as far apart as any two coordinates of theirs differ, so pairs whose greatest
coordinate difference is over a radius are discarded. What survives is verified on the texts themselves.

No group has more than ``MEMBERS`` members. Texts that meet many others in a band, as those made from one template do, are
joined instead by their rarest shingles (prefix filtering, which misses nothing), and groups that are still larger are
cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliodex.llm.tokenize import slices
from foliodex.llm.words import U, mix, shingles
from foliodex.session import stage

#: Bands, min-hashes in a band, and bits of a fingerprint, one of each min-hash. Two texts of similarity s agree in no band with
#: probability (1 - s**WORDS)**BANDS, 4e-5 at 0.7 and 2e-8 at 0.8.
BANDS, WORDS, BITS = 24, 3, 256
#: Two similar texts are further apart than the radius with at most this probability.
MISS = 1e-6
#: Members of a group, and how many of them are references.
MEMBERS, REFERENCES = 64, 16
#: Tasks that the members of one band too many are looked up in; pairs that are compared at once.
SALTS, AT_ONCE = 16, 2_000_000
_random = np.random.default_rng(20)
_SCALE = _random.integers(0, 2**32, (2, BITS), np.uint32) | np.uint32(1)


def radius(least: float) -> int:
    """The distance that fingerprints of texts with a similarity of ``least`` exceed with a probability of at most ``MISS``."""
    p, tail = (1 - least) / 2, 1.0
    for r in range(BITS + 1):
        tail -= comb(BITS, r) * p**r * (1 - p) ** (BITS - r)
        if tail <= MISS:
            return r
    return BITS


def minima(runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Min-hashes (texts x BITS) of texts that have ``counts`` shingles, each at least one."""
    starts = np.cumsum(counts) - counts
    high, low = (runs >> U(32)).astype(np.uint32), runs.astype(np.uint32)
    words = np.empty((len(counts), BITS), np.uint32)
    for k in range(BITS):
        words[:, k] = np.minimum.reduceat(high * _SCALE[0, k] + low * _SCALE[1, k], starts)
    return words


def fingerprints(words: np.ndarray) -> np.ndarray:
    """Fingerprints (texts x bytes) of min-hashes: a well mixed bit of each."""
    return np.packbits((mix(words.astype(U) + U(1)) >> U(40)).astype(np.uint8) & 1, axis=1)


def band_rows(words: np.ndarray) -> np.ndarray:
    """For each text and band one number that stands for its min-hashes."""
    keys = np.zeros((len(words), BANDS), U)
    for k in range(WORDS):
        keys = mix(keys + words[:, k : BANDS * WORDS : WORDS].astype(U) + U(1))
    return mix(keys + np.arange(BANDS, dtype=U)).view(np.int64)


def sketch(rows: DataFrame, n: int) -> DataFrame:
    """(key, version, tie, class, bands, print) for each row of (key, version, tie, text) with at least ``n`` words; ``class`` is a hash of its words in order."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for a, b in slices(texts):
                runs, counts = shingles(texts[a:b], n)
                kept = np.flatnonzero(counts)
                if not len(kept):
                    continue
                counts = counts[kept]
                starts = np.cumsum(counts) - counts
                place = np.arange(len(runs)) - np.repeat(starts, counts)
                of = np.add.reduceat(mix(runs + place.astype(U)), starts).view(np.int64)
                words = minima(runs, counts)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (len(kept) + 1), BANDS), pa.int32()), pa.array(band_rows(words).ravel()))
                prints = pa.array([p.tobytes() for p in fingerprints(words)], pa.binary())
                at = pa.array(kept + a)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(of), bands, prints], names=["key", "version", "tie", "class", "bands", "print"])

    return rows.mapInArrow(compute, f"key long, version {rows.schema['version'].dataType.simpleString()}, tie long, class long, bands array<long>, print binary")


def distance_table(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hamming distances (members x REFERENCES) of each member to the first members of its group."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    table = np.empty((len(prints), REFERENCES), np.int16)
    for p in range(REFERENCES):
        reference = (starts + np.minimum(p, sizes - 1))[group]
        table[:, p] = np.bitwise_count(prints ^ prints[reference]).sum(1)
    return table


def survivors(groups: DataFrame, within: int) -> DataFrame:
    """(a, b), a < b, of the pairs inside the groups (group, key, print, left, right, size) that their distance tables do not discard.

    A pair has a ``left`` member and a ``right`` one that comes after it by ``size`` and key; it is discarded if some
    coordinate differs by more than ``within``.
    """
    member = F.struct("key", "print", "left", "right", "size")
    listed = groups.groupBy("group").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1).select("members")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0)
            sizes = np.diff(own.offsets.to_numpy())
            flat = own.flatten()
            keys, left, right, size = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "left", "right", "size"))
            prints = np.frombuffer(b"".join(flat.field("print").to_pylist()), U).reshape(len(keys), -1)
            starts = np.cumsum(sizes) - sizes
            table = distance_table(prints, starts, sizes)
            ends = np.append(np.flatnonzero(np.diff(np.cumsum(sizes**2) // AT_ONCE)) + 1, len(sizes))
            first = 0
            for last in ends.tolist():
                s, n = starts[first:last], sizes[first:last]
                who = np.arange(s[0], s[0] + n.sum()) if len(n) else np.empty(0, np.int64)
                mates, begin = np.repeat(n, n), np.repeat(s, n)
                x = np.repeat(who, mates)
                y = np.arange(len(x)) - np.repeat(np.cumsum(mates) - mates, mates) + np.repeat(begin, mates)
                after = left[x] & right[y] & ((size[x] < size[y]) | (size[x] == size[y]) & (keys[x] < keys[y]))
                x, y = x[after], y[after]
                near = np.abs(table[x] - table[y]).max(1, initial=0) <= within
                a, b = keys[x[near]], keys[y[near]]
                first = last
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return listed.mapInArrow(compute, "a long, b long").distinct()


def band_groups(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (group, key) of the texts (key, bands) that share a band with at most ``MEMBERS`` in all, and the keys of those that share one with more.

    No more than one member too many of a band goes through a shuffle from one task.
    """
    keyed = texts.select("key", F.explode("bands").alias("group"))
    inside = Window.partitionBy("group").orderBy("key")
    met = keyed.withColumn("i", F.row_number().over(inside)).where(F.col("i") <= MEMBERS + 1).groupBy("group").agg(F.collect_list("key").alias("keys")).where(F.size("keys") > 1)
    met = stage(met, "neardup-bands")
    full = met.where(F.size("keys") > MEMBERS).select("group", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return met.where(F.size("keys") <= MEMBERS).select("group", F.explode("keys").alias("key")), salted.join(full, ["group", "salt"], "left_semi").select("key").distinct()


def shingle_rows(texts: DataFrame, n: int) -> DataFrame:
    """(key, size, shingle) of the distinct shingles of each of (key, text), ``size`` being their number."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_pylist()
            for a, b in slices(own):
                runs, counts = shingles(own[a:b], n)
                owner = np.repeat(np.arange(a, b), counts)
                by = np.lexsort((runs, owner))
                runs, owner = runs[by], owner[by]
                first = np.ones(len(by), bool)
                first[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
                runs, owner = runs[first], owner[first]
                size = np.bincount(owner - a, minlength=b - a)[owner - a] if len(owner) else owner
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(size.astype(np.int32)), pa.array(runs.view(np.int64))], names=["key", "size", "shingle"])

    return texts.select("key", "text").mapInArrow(compute, "key long, size int, shingle long")


def prefix_groups(texts: DataFrame, n: int, least: float) -> DataFrame:
    """(group, key, left, right, size) of texts (key, text) that share one of their rarest shingles.

    Two texts of a similarity of ``least`` share at least 2 * least / (1 + least) of the smaller one's distinct shingles and
    ``least`` of the larger one's; so one of as many of the rarest of the smaller (``left``) as may be missing and one more is among as
    many of the larger. Shingles of more than ``MEMBERS`` texts are cut into blocks that meet each other, if any text has them left.
    """
    rows = stage(shingle_rows(texts, n), "neardup-shingles")
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.coalesce("n", F.lit(1)), "shingle"))
    missing = lambda share: F.col("size") - F.ceil(share * F.col("size") - 1e-9) + 1
    ranked = rows.join(held, "shingle", "left").withColumn("rank", rank).where(F.col("rank") <= missing(least)).where("n is not null")
    prefix = stage(ranked.select("shingle", "key", "size", "n", (F.col("rank") <= missing(2 * least / (1 + least))).alias("left")), "neardup-prefixes")
    few = prefix.where(F.col("n") <= MEMBERS).select(F.col("shingle").alias("group"), "key", "left", F.lit(True).alias("right"), "size")
    many = prefix.where(F.col("n") > MEMBERS)
    loads = many.groupBy("shingle").agg(F.ceil(F.count_if("left") / MEMBERS).cast("int").alias("across"), F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("down")).where("across > 0")
    spread = many.join(loads, "shingle")
    block: Column = F.xxhash64("key")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    sides = spread.where("left").withColumn("x", F.pmod(block, F.col("across")).cast("int")).withColumn("y", all_of("down")).withColumn("right", F.lit(False))
    other = spread.withColumn("y", F.pmod(block, F.col("down")).cast("int")).withColumn("x", all_of("across")).withColumn("right", F.lit(True)).withColumn("left", F.lit(False))
    blocks = sides.unionByName(other).select(F.xxhash64("shingle", "x", "y").alias("group"), "key", "left", "right", "size")
    return few.unionByName(blocks)


def verified(pairs: DataFrame, n: int, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b, text_a, text_b) whose shingle sets have at least the similarity ``least``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b in slices([x + y for x, y in zip(left, right)]):
                runs, counts = shingles([t for pair in zip(left[a:b], right[a:b]) for t in pair], n)
                owner = np.repeat(np.arange(len(counts)), counts)
                by = np.lexsort((runs, owner))
                first = np.ones(len(by), bool)
                first[1:] = (runs[by][1:] != runs[by][:-1]) | (owner[by][1:] != owner[by][:-1])
                runs, owner = runs[by][first], owner[by][first]
                sizes = np.bincount(owner, minlength=len(counts))
                by = np.lexsort((runs, owner >> 1))
                pair, runs = owner[by] >> 1, runs[by]
                both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (runs[1:] == runs[:-1])], minlength=b - a)
                either = sizes[::2] + sizes[1::2] - both
                same = both / np.maximum(either, 1)
                kept = np.flatnonzero(both >= least * either - 1e-9)
                at = pa.array(kept + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(same[kept])], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(compute, "a long, b long, similarity double")


def candidates(texts: DataFrame, sources: DataFrame, n: int, least: float, within: int | None = None) -> DataFrame:
    """(a, b), a < b: the pairs of texts (key, bands, print) that survive; ``sources`` (key, text) holds their texts.

    ``within`` is the radius of ``least`` unless given.
    """
    within = radius(least) if within is None else within
    prints = texts.select("key", "print")
    few, many = band_groups(texts)
    both = F.lit(True)
    pairs = survivors(few.join(prints, "key").select("group", "key", "print", both.alias("left"), both.alias("right"), F.lit(0).alias("size")), within)
    many = stage(many, "neardup-hot")
    if not many.isEmpty():
        groups = prefix_groups(sources.join(many, "key", "left_semi"), n, least)
        pairs = pairs.unionByName(survivors(groups.join(prints, "key").select("group", "key", "print", "left", "right", "size"), within)).distinct()
    return pairs


def near_duplicates(df: DataFrame, key: str, text: str, version: str | None = None, n: int = 3, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Members (key, class) and similar pairs (class_a, class_b, similarity) of classes, class_a < class_b.

    Texts with the same words in order are one class. Similarity is that of the sets of runs of ``n`` words.
    Where a ``key`` repeats, the row of the greatest ``version`` counts, of equal ones that of the greatest text
    hash. Texts with fewer than ``n`` words, null and empty ones and null keys have no class. Other columns
    are not read. Both results are tables in the shared folder; copies are not expanded into pairs.
    """
    rows = df.select(df[key].cast("long").alias("key"), (df[version] if version else F.lit(None).cast("long")).alias("version"), F.xxhash64(df[text]).alias("tie"), df[text].alias("text"))
    rows = rows.where("key is not null")
    latest = rows.groupBy("key").agg(F.max("version").alias("latest"))
    newest = F.col("version").eqNullSafe(F.col("latest"))
    sketched = sketch(rows.where("text <> ''"), n).join(latest, "key").where(newest)
    members = stage(sketched.groupBy("key").agg(F.max_by(F.struct("class", "bands", "print"), "tie").alias("x")).select("key", "x.*"), "neardup-members")
    # any member stands for its class; its text is read again for verification
    classes = members.groupBy("class").agg(F.min("key").alias("key"))
    texts = stage(members.join(classes, ["class", "key"], "left_semi").select("key", "bands", "print"), "neardup-texts")

    def current(wanted: DataFrame) -> DataFrame:
        own = rows.where("text <> ''").join(wanted, "key").join(latest, "key").where(newest)
        return own.groupBy("key").agg(F.max_by("text", "tie").alias("text"))

    pairs = stage(candidates(texts, current(texts.select("key")), n, least), "neardup-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sources = stage(current(wanted), "neardup-sources")
    both = pairs.join(sources.toDF("a", "text_a"), "a").join(sources.toDF("b", "text_b"), "b")
    similar = verified(both, n, least)
    of = members.select("key", "class")
    linked = (
        similar.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "similarity")
    )
    return of, stage(linked, "neardup-links")


def expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b) of all similar keys, a < b: members of linked classes, and of one class."""
    of_class = members.toDF("a", "class"), members.toDF("b", "class")
    same = of_class[0].join(of_class[1], "class").where("a < b").select("a", "b")
    across = links.join(of_class[0].withColumnRenamed("class", "class_a"), "class_a").join(of_class[1].withColumnRenamed("class", "class_b"), "class_b")
    return same.unionByName(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
