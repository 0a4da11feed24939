"""Occurrences and record counts of all word n-grams by suffix arrays with common-prefix intervals.

Blocks of whole records are sorted by suffix where they lie; their counts add up, so no n-gram, however
frequent, meets in one task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliodex.session import stage

RARE_RECORDS = 2
COMMON_SHARE = 0.06
#: Words of values that are sorted at once.
BLOCK = 300_000
#: A record with more than one in so many rows, and more than a block, is spread over so many tasks.
SHARES = 200
START, END = 1, 2


@F.pandas_udf(T.StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v.isascii() else unicodedata.normalize("NFC", v), na_action="ignore")


def normal_term(value: Column) -> Column:
    """Composed (NFC), lower-cased, runs of white space made one space, trimmed; only composing needs Python."""
    return F.trim(F.regexp_replace(F.lower(_composed(value)), r"[ \t\r\n\f]+", " "))


def suffix_array(codes: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the values in order, and each one's common prefix with the one before, in words.

    ``codes``: words from 1 on; ``ends``: where the value of each position ends. Suffixes are told apart by
    their first ``most`` words at least.
    """
    n = len(codes)
    here, ranks, k = np.arange(n), [np.append(codes, 0)], 1
    while k < most:
        after = np.where(here + k < ends, ranks[-1][np.minimum(here + k, n)], 0)
        keys = ranks[-1][:n] * (int(ranks[-1].max()) + 1) + after
        ranks.append(np.append(np.unique(keys, return_inverse=True)[1] + 1, 0))
        k *= 2
    order = np.argsort(ranks[-1][:n], kind="stable")
    i, j = order[1:].copy(), order[:-1].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = (i < ends[order[1:]]) & (j < ends[order[:-1]])
        same = inside & (ranks[level][np.minimum(i, n)] == ranks[level][np.minimum(j, n)])
        common += same * (1 << level)
        i, j = i + same * (1 << level), j + same * (1 << level)
    common = np.minimum(common, np.minimum(ends[order[1:]] - order[1:], ends[order[:-1]] - order[:-1]))
    return order, np.concatenate([[0], common]) if n else common


def block_counts(values: list[str], records: np.ndarray, n_most: int, whole: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """N-grams of the values with their occurrences and numbers of distinct records; with ``whole``, whole values only.

    An interval of common prefixes of n words has as many suffixes as the n-gram occurs; in the order of records inside it, each
    neighbour of the same record is one too many for the number of records, and is subtracted.
    """
    words = [v.split(" ") for v in values]
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    names, codes = pd.factorize(np.array([x for w in words for x in ("\x00", *w, "\x01")], dtype=object))[::-1]
    code_of = {x: i for i, x in enumerate(names)}
    codes = codes + 3
    codes[codes == code_of["\x00"] + 3] = START
    codes[codes == code_of["\x01"] + 3] = END
    value = np.repeat(np.arange(len(values)), sizes)
    stop = np.cumsum(sizes)[value]
    most = int(sizes.max()) if whole else min(n_most, int(sizes.max()))
    order, common = suffix_array(codes, stop, most)
    length, row = stop[order] - order, value[order]
    grams: list[str] = []
    counts, held = [], []
    for n in range(1, most + 1):
        fits = length >= n
        if whole:
            fits &= (codes[order] == START) & (length == n)
        else:
            fits &= (codes[order] != START) & (length > n)  # neither mark is a word
        if not fits.any():
            continue
        interval = np.cumsum(common < n)[fits]
        of, rows = np.unique(interval, return_inverse=True)
        at = order[fits][np.unique(interval, return_index=True)[1]]
        r = row[fits]
        counts.append(np.bincount(rows, minlength=len(of)))
        by = np.lexsort((records[r], rows))
        a, b = rows[by], records[r][by]
        twice = (a[1:] == a[:-1]) & (b[1:] == b[:-1])  # neighbours of one record in an interval
        held.append(np.bincount(a, minlength=len(of)) - np.bincount(a[1:][twice], minlength=len(of)))
        first = at - (np.cumsum(sizes) - sizes)[value[at]]
        if whole:
            grams += [values[v] for v in value[at].tolist()]
        else:
            grams += [" ".join(words[v][f - 1 : f - 1 + n]) for v, f in zip(value[at].tolist(), first.tolist())]
    if not grams:
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    return grams, np.concatenate(counts), np.concatenate(held)


def term_counts(df: DataFrame, record: str, value: str, n_most: int = 0) -> DataFrame:
    """``term``, ``occurrences`` and ``records``: how often each term occurs and in how many records.

    Terms are whole values, or with ``n_most`` all n-grams of up to so many words (parted by single spaces)
    inside values. Rows with a null record or a null or empty value do not count; repeated rows do. Other
    columns are not read. Rows go to the suffix arrays as they are; a record with more than one in ``SHARES`` of all
    rows is spread over many tasks, whose results for it are brought together by record.
    """
    kind = df.schema[record].dataType.simpleString()
    out = "bigint" if kind == "bigint" else "string"
    rows = df.select(df[record].cast(out).alias("record"), df[value].alias("value")).where("record is not null and value <> ''")
    sizes = rows.groupBy("record").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = [r["record"] for r in sizes.where(F.col("n") > max(BLOCK, total // SHARES)).collect()] if total > BLOCK else []  # fewer than SHARES
    schema = pa.schema([("term", pa.string()), ("record", pa.int64() if out == "bigint" else pa.string()), ("n", pa.int64()), ("d", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(part: pd.DataFrame, under_id: bool) -> pa.RecordBatch:
            grams, n, d = block_counts(part["value"].tolist(), pd.factorize(part["record"])[0], n_most, not n_most)
            owner = [part["record"].iloc[0] if under_id else None] * len(grams)
            return pa.RecordBatch.from_pandas(pd.DataFrame({"term": grams, "record": pd.Series(owner, dtype=object), "n": n, "d": d}), schema=schema, preserve_index=False)

        def emit_all(part: pd.DataFrame, cut) -> Iterator[pa.RecordBatch]:
            own = part["record"].isin([*hot, *([] if cut is None else [cut])])
            for _, one in part[own].groupby("record"):
                yield emit(one, True)
            if not own.all():
                yield emit(part[~own], False)

        kept, cut = pd.DataFrame(), None
        for batch in batches:
            kept = pd.concat([kept, batch.to_pandas()], ignore_index=True)
            if len(kept) + kept["value"].str.count(" ").sum() < BLOCK:
                continue
            last = kept["record"].iloc[-1]  # may go on in the next batch
            own = kept["record"] == last
            if own.all():  # a record larger than a block comes out under its own id
                cut = last
                yield emit(kept, True)
                kept = kept.iloc[:0]
                continue
            yield from emit_all(kept[~own], cut)
            kept, cut = kept[own], cut if cut == last else None
        if len(kept):
            yield from emit_all(kept, cut)

    spread = F.when(F.col("record").isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(SHARES))).otherwise(0) if hot else F.lit(0)
    placed = rows.withColumn("spread", spread).repartition("record", "spread").sortWithinPartitions("record").select("record", "value")
    parts = placed.mapInArrow(count, f"term string, record {out}, n long, d long")
    by_record = parts.groupBy("term", "record").agg(F.sum("n").alias("n"), F.when(F.col("record").isNull(), F.sum("d")).otherwise(F.max("d")).alias("d"))
    return by_record.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum("d").alias("records"))


def marked_terms(df: DataFrame, record: str, value: str, rare: int = RARE_RECORDS, share: float = COMMON_SHARE) -> DataFrame:
    """``term``, ``occurrences``, ``records`` and ``mark``: ``rare`` in at most ``rare`` records, ``common`` in at least
    ``share`` of the records that have a term, else null. A term that is both is rare.

    Values are normalised by ``normal_term``; nulls, blanks and rows without a record do not count.
    """
    # written before blanks are left out: each value is normalised once
    kept = stage(df.select(df[record].alias("record"), normal_term(df[value]).alias("value")).where("record is not null"), "terms").where("value <> ''")
    total = kept.select("record").distinct().count()
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") >= share * total, "common")
    return term_counts(kept, "record", "value").withColumn("mark", mark)
