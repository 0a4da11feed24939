"""Long passages that stand verbatim in several documents, by content-defined chunks of a gear rolling hash.

A gear hash runs over each text. Every stretch of ``LEAST`` characters belongs to the lowest gear value in it;
neighbouring stretches with the same lowest value make up a chunk. Where a chunk begins and ends depends on the
characters near by only, so an insertion shifts chunks without changing them. Chunks are deduplicated by digest: a
chunk that stands in two documents is shared as a whole, and of each chunk one copy is compared further, stretch by
stretch, with other chunks of the same lowest value. Two equal stretches always have the same lowest value, so none
is missed. Chunks and stretches are told by two hashes, their own of 64 bits and the lowest value of 58 bits, so
chance makes no two of them equal at any size of data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliodex.llm.words import U, code_points, mix, prefix_sums, span_hash
from foliodex.session import stage

LEAST = 150
#: Characters the gear hash sees: one shift of 64 bits per character.
GEAR = 64
#: Stretches of a text that are looked at at once; longer texts go in parts.
PART = 1_000_000


def lowest(codes: np.ndarray, least: int) -> np.ndarray:
    """For each stretch of ``least`` codes the lowest mixed gear value in it; of equal values the position decides."""
    gear = mix(codes.astype(U) * U(0x9E3779B97F4A7C15) + U(1))
    width = 1
    while width < min(GEAR, least):
        gear[width:] += gear[:-width] << U(width)
        width *= 2
    low = (mix(gear) & ~U(63)) | (np.arange(len(codes), dtype=U) & U(63))
    low = low[width - 1 :]
    window, span = least - width + 1, 1
    while span * 2 <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[: len(low) - (window - span)], low[window - span :]) if window > span else low


def chunks(texts: list[str], least: int) -> tuple[np.ndarray, ...]:
    """(text, lowest value, digest, first stretch, stretches) of all chunks of the texts, each of at least ``least`` characters."""
    codes, starts = code_points(texts)
    sizes = np.append(starts[1:], len(codes)) - starts - 1
    low = lowest(codes, least) >> U(6)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)[: len(low)]
    place = np.arange(len(low)) - starts[owner]
    inside = place + least <= sizes[owner]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(low)))
    first, count = first[inside[first]], count[inside[first]]
    digest = span_hash(prefix_sums(codes), first, first + count + least - 1)
    return owner[first], low[first], digest, place[first], count


def _parts(docs: list, texts: list[str | None], least: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Rows, offsets and parts of texts, about ``PART`` characters at once; parts of a text repeat what one stretch needs."""
    rows, offsets, parts, total = [], [], [], 0
    for row, text in enumerate(texts):
        if docs[row] is None or not text or len(text) < least:
            continue
        for at in range(0, len(text) - least + 1, PART):
            part = text[at : at + PART + least - 1]
            rows.append(row), offsets.append(at), parts.append(part)
            total += len(part)
            if total >= PART:
                yield rows, offsets, parts
                rows, offsets, parts, total = [], [], [], 0
    if parts:
        yield rows, offsets, parts


def _chunk_rows(df: DataFrame, least: int) -> DataFrame:
    """(low, digest, doc, lo, n) of all chunks of (doc, text)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for rows, offsets, parts in _parts(docs, batch.column(1).to_pylist(), least):
                of, low, digest, lo, n = chunks(parts, least)
                doc = batch.column(0).take(pa.array(np.array(rows)[of]))
                yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(digest.view(np.int64)), doc, pa.array(lo + np.array(offsets)[of], pa.int32()), pa.array(n, pa.int32())], names=["low", "digest", "doc", "lo", "n"])

    return df.mapInArrow(compute, "low long, digest long, doc long, lo int, n int")


def _stretch_rows(df: DataFrame, least: int) -> DataFrame:
    """(hash, low, digest, k, owner) of each stretch of the chunks of (text, chunks), chunks being (low, digest, owner, lo, n)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1)
            of = pc.list_parent_indices(own).to_pylist()
            flat = own.flatten()
            lo, n = flat.field("lo").to_pylist(), flat.field("n").to_pylist()
            texts = batch.column(0)
            kept, text = -1, ""
            at = 0
            while at < len(lo):
                pieces, end, total = [], at, 0
                while end < len(lo) and total < PART:
                    if of[end] != kept:
                        kept, text = of[end], texts[of[end]].as_py()
                    pieces.append(text[lo[end] : lo[end] + n[end] + least - 1])
                    total += n[end] + least
                    end += 1
                codes, starts = code_points(pieces)
                count = np.array(n[at:end])
                row = np.repeat(np.arange(end - at), count)
                k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = np.minimum(starts[row] + k, len(codes) - least)
                sums = prefix_sums(codes)
                hashed = span_hash(sums, first, first + least).view(np.int64)
                # of several texts of one key, a chunk is in one
                its = span_hash(sums, starts, np.minimum(starts + count + least - 1, len(codes))).view(np.int64) == flat.field("digest").slice(at, end - at).to_numpy()
                take = pa.array(row[its[row]] + at)
                yield pa.RecordBatch.from_arrays([pa.array(hashed[its[row]]), flat.field("low").take(take), flat.field("digest").take(take), pa.array(k[its[row]].astype(np.int32)), flat.field("owner").take(take)], names=["hash", "low", "digest", "k", "owner"])
                at = end

    return df.select("text", "chunks").mapInArrow(compute, "hash long, low long, digest long, k int, owner long")


def _merged(ranges: DataFrame) -> DataFrame:
    """Ranges (doc, a, b) with those that overlap or touch made one."""
    before = Window.partitionBy("doc").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    apart = F.when(F.col("a") <= F.max("b").over(before), 0).otherwise(1)
    return ranges.withColumn("apart", apart).withColumn("island", F.sum("apart").over(upto)).groupBy("doc", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def shared_spans(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """(key, span_start, span_end): the maximal stretches of each text in which every character lies in a run of at
    least ``least`` characters that stands verbatim in a text of another key.

    Positions count characters from 0, the end is exclusive. ``least`` is ``GEAR`` or more. Texts shorter than ``least``,
    null texts and rows without a key have no stretches; rows of one key are one document's. Other columns are not read.
    """
    if least < GEAR:
        raise ValueError(f"least must be at least {GEAR}")
    docs = df.select(df[key].cast("long").alias("doc"), df[text].alias("text")).where(F.col("doc").isNotNull() & (F.char_length("text") >= least))
    every = stage(_chunk_rows(docs, least), "spans-every")
    two = F.min("doc") != F.max("doc")
    met = every.groupBy("low").agg(two.alias("two")).where("two").select("low")
    held = stage(every.join(met, "low", "left_semi"), "spans-chunks")
    # one row per distinct chunk, told by its digest and its lowest value together; owner is null where it stands in several documents
    distinct = stage(
        held.groupBy("low", "digest").agg(F.min(F.struct("doc", "lo", "n")).alias("at"), F.when(~two, F.min("doc")).alias("owner")),
        "spans-distinct",
    )
    chunk = ["low", "digest"]
    whole = held.join(distinct.where("owner is null").select(chunk), chunk, "left_semi").select("doc", F.col("lo").alias("a"), (F.col("lo") + F.col("n") + least - 1).alias("b"))
    # chunks that share their lowest value with another chunk, unless all of these are shared as a whole
    kin = distinct.groupBy("low").agg(F.count(F.lit(1)).alias("kinds"), F.count("owner").alias("single")).where("kinds > 1 and single > 0").select("low")
    open_ = distinct.join(kin, "low", "left_semi").select("at.doc", F.struct("low", "digest", "owner", "at.lo", "at.n").alias("chunk"))
    by_doc = open_.groupBy("doc").agg(F.collect_list("chunk").alias("chunks"))  # no more than the document has
    stretches = stage(_stretch_rows(by_doc.join(docs, "doc"), least), "spans-stretches")
    # equal stretches have equal lowest values, so hash and value together tell them
    several = F.max(F.col("owner").isNull()) | (F.min("owner") != F.max("owner"))
    common = stretches.groupBy("hash", "low").agg(several.alias("several"), F.count("owner").alias("single")).where("several and single > 0").select("hash", "low")
    found = stretches.where("owner is not null").join(common, ["hash", "low"], "left_semi").select(*chunk, "k").distinct()
    number = Window.partitionBy(chunk).orderBy("k")
    runs = found.withColumn("run", F.col("k") - F.row_number().over(number)).groupBy(*chunk, "run").agg(F.min("k").alias("k0"), F.max("k").alias("k1"))
    partly = held.join(runs, chunk).select("doc", (F.col("lo") + F.col("k0")).alias("a"), (F.col("lo") + F.col("k1") + least).alias("b"))
    return _merged(whole.unionByName(partly)).select(F.col("doc").alias(key), F.col("a").cast("long").alias("span_start"), F.col("b").cast("long").alias("span_end"))


def shared_part(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """(key, n_chars, shared_chars): how many characters of each key's text stand elsewhere too; 0 of a null text.

    Rows without a key do not count; of rows with one key, the longest text counts.
    """
    spans = shared_spans(df, key, text, least).groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = df.where(df[key].isNotNull()).groupBy(df[key].alias(key)).agg(F.coalesce(F.max(F.char_length(df[text])), F.lit(0)).cast("long").alias("n_chars"))
    return sizes.join(spans, key, "left").select(key, "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))
