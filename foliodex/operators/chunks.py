"""Texts in chunks for a model with a token limit, and the chunks' summaries merged."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters taken for a token, tokens that ask for one repeated sentence, keywords and characters of a merged summary.
TOKEN, PER_SENTENCE, MOST_KEYWORDS, LONG_SUMMARY = 4, 50, 15, 500
#: The sentence that stands for many summaries.
MANY, REST = "Multi-part document covering: ", " additional topics."

_sentence_end = re.compile(r"\. +|\n\s*\n")
_space = re.compile(r"\s+")


def tokens_of(text: str) -> int:
    return len(text) // TOKEN


def chunk_spans(text: str, limit: int, overlap: int = PER_SENTENCE) -> list[tuple[int, int, int]]:
    """(start with what is repeated, start, end) of each chunk, none over ``limit`` tokens; the stretches from start to end make up the text.

    A text over the limit is cut at nine tenths of it. A cut is at the last sentence end (". " or a blank line) that fits, where
    there is none at the last white space, else where the chunk is full. A chunk repeats the last sentences of the one before, one
    for each 50 tokens of ``overlap`` and one at least, as many of them as leave room for a sentence.
    """
    n = len(text)
    if tokens_of(text) <= limit:
        return [(0, 0, n)] if n else []
    room = TOKEN * (limit - limit // 10)
    ends = [m.end() for m in _sentence_end.finditer(text) if m.end() < n] + [n]
    gaps: list[int] | None = None
    back = max(1, overlap // PER_SENTENCE)
    out: list[tuple[int, int, int]] = []
    start = before = 0
    while start < n:
        own = bisect_right(ends, start)  # ends[own] is the first end of a sentence after the start
        # sentences of the chunk before, the longest repetition first
        for first in (*(ends[i - 1] if i else 0 for i in range(max(0, own - back), own)), start):
            if before <= first <= start and (to := bisect_right(ends, first + room) - 1) >= own:
                end = ends[to]
                break
        else:
            first = start
            if gaps is None:
                gaps = [m.end() for m in _space.finditer(text)]
            at = bisect_right(gaps, start + room) - 1
            end = gaps[at] if at >= 0 and gaps[at] > start else start + room
        out.append((first, start, min(end, n)))
        before, start = start, end
    return out


def chunked(df: DataFrame, key: str, text: str, limit: int, overlap: int = PER_SENTENCE, drop_oversize: bool = False, most: int | None = None, largest: int | None = None) -> DataFrame:
    """(key, chunk_no, n_chunks, overlap_start, start, end, tokens, chunk, error) of each text; numbers count from 0.

    A chunk is the text from ``overlap_start`` to ``end``; the stretches from ``start`` to ``end`` are the whole text. Null, empty and
    blank texts give one row with the error ``empty`` and no chunk. Three switches, off by default, leave something out as small models need
    it: ``drop_oversize`` leaves out sentences that are over nine tenths of the limit (positions then are those of the rest; ``no chunk`` if
    nothing is left), ``most`` and ``largest`` give texts of more chunks, or of so many tokens, only an error (``too many
    chunks``, ``too long``). Repeated rows are chunked again; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def fit(text_: str) -> str:
        return ". ".join(s for s in text_.split(". ") if tokens_of(s) <= limit - limit // 10)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                spans, error = [], None
                if not t or t.isspace():
                    error = "empty"
                elif largest is not None and tokens_of(t) >= largest:
                    error = "too long"
                else:
                    if drop_oversize and tokens_of(t) > limit:
                        t = fit(t)
                    spans = chunk_spans(t, limit, overlap)
                    error = "no chunk" if not spans else "too many chunks" if most is not None and len(spans) > most else None
                if error:
                    rows.append((i, None, len(spans), None, None, None, None, None, error))
                else:
                    rows += [(i, at, len(spans), a, b, c, tokens_of(t[a:c]), t[a:c], None) for at, (a, b, c) in enumerate(spans)]
            of, *columns = zip(*rows) if rows else ((),) * 9
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=list("kabcdefgh"))

    rows = df.select(df[key].alias("k"), df[text].alias("t"))
    schema = f"key {kind}, chunk_no int, n_chunks int, overlap_start long, start long, end long, tokens long, chunk string, error string"
    return rows.mapInArrow(cut, schema).withColumnRenamed("key", key)


def merged_keywords(keywords: Column) -> Column:
    """The first ``MOST_KEYWORDS`` keywords of an array that differ by more than case, in order."""
    first = lambda done, k: F.when(F.exists(done, lambda d: F.lower(d) == F.lower(k)), done).otherwise(F.concat(done, F.array(k)))
    return F.slice(F.aggregate(keywords, F.array().cast("array<string>"), first), 1, MOST_KEYWORDS)


def merged_summaries(parts: DataFrame, key: str, order: str, summary: str) -> DataFrame:
    """(key, parts, merged): the summaries of each key's parts in order as one.

    One part is taken as it is. Several are joined by spaces; if that is over ``LONG_SUMMARY`` characters, the first three
    are named and the others counted. No more rows of a key are gathered than a short summary can have. Parts without a
    summary are left out.
    """
    numbered = Window.partitionBy(key).orderBy(order)
    rows = parts.where(F.col(summary).isNotNull()).select(key, order, F.col(summary).alias("s"))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("parts"), (F.sum(F.char_length("s")) + F.count(F.lit(1)) - 1).alias("size"))
    leading = rows.withColumn("i", F.row_number().over(numbered)).where(F.col("i") <= LONG_SUMMARY + 1)
    texts = leading.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("all"))
    more = F.when(F.col("parts") > 3, F.concat(F.lit(" and "), F.col("parts") - 3, F.lit(REST))).otherwise("")
    named = F.concat(F.lit(MANY), F.array_join(F.slice("all", 1, 3), "; "), more)
    merged = F.when(F.col("parts") == 1, F.get("all", F.lit(0))).when(F.col("size") > LONG_SUMMARY, named).otherwise(F.array_join("all", " "))
    return sizes.join(texts, key).select(key, "parts", merged.alias("merged"))
