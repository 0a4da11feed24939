"""Oversized texts into pieces: atomic segments, merged at their weakest boundaries first."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
SPACE = " \t\r\n\f"
#: Strength of a boundary, weakest first.
INSIDE, WORD, SENTENCE, PARAGRAPH = range(4)
FINEST = ("none", "word", "sentence", "paragraph")

_paragraph = re.compile(r"\n(?:[ \t\r\f]*\n)+[ \t\r\f]*")
_sentence = re.compile(r"(?<=[.!?])[ \t\r\n\f]+")
_word = re.compile(r"[ \t\r\n\f]+")


def _cut(text: str, start: int, end: int, at: re.Pattern) -> list[tuple[int, int]]:
    """Stretches between matches, each with the match that follows it."""
    found, last = [], start
    for m in at.finditer(text, start, end):
        if m.end() < end:
            found.append((last, m.end()))
            last = m.end()
    return [*found, (last, end)]


def _fitting(text: str, start: int, end: int, limit: int, step: int) -> list[tuple[int, int]]:
    """A unit in one stretch; one that is over the limit only by white space at its ends, or over it anyway, without that white space, which
    comes in stretches of its own."""
    if end - start <= limit:
        return [(start, end)]
    first = start + len(text[start:end]) - len(text[start:end].lstrip(SPACE))
    last = max(first, start + len(text[start:end].rstrip(SPACE)))
    blank = lambda a, b: [(k, min(k + step, b)) for k in range(a, b, step)]
    return [*blank(start, first), *([(first, last)] if last > first else []), *blank(last, end)]


def atoms(text: str, limit: int, overlap: int = 0) -> tuple[list[int], list[int], list[bool]]:
    """Starts of the atomic segments, the strength of the boundary before each, and whether that boundary is inside a paragraph that fits.

    Sentences are atoms; one over the limit is cut at words, and a run without white space over it where it and the overlap are full.
    """
    starts: list[int] = []
    strength: list[int] = []
    free: list[bool] = []

    step = limit - overlap

    def put(at: int, level: int, inside: bool = False) -> None:
        starts.append(at), strength.append(level), free.append(inside)

    for paragraph in _cut(text, 0, len(text), _paragraph):
        for a, b in _fitting(text, *paragraph, limit, step):
            level = PARAGRAPH
            for sentence in _cut(text, a, b, _sentence):
                for c, d in _fitting(text, *sentence, limit, step):
                    if d - c <= limit:
                        put(c, level, b - a <= limit and level == SENTENCE)
                        level = SENTENCE
                        continue
                    for word in _cut(text, c, d, _word):
                        for e, f in _fitting(text, *word, limit, step):
                            for k in [e] if f - e <= limit else range(e, f, step):
                                put(k, level)
                                level = INSIDE
                            level = WORD
                    level = SENTENCE
    return starts, strength, free


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int, int]]]:
    """The coarsest unit at whose ends all cuts lie, and (start with overlap, start, end) of each piece; the stretches from start to end make up the text.

    Adjacent segments lie in a heap by the strength of the boundary between them, then by their joint size; a pair is
    merged while its size plus the overlap fits the limit. A paragraph that fits is made whole without room for the overlap;
    what it repeats is then shorter. Merging only makes neighbours larger, so a pair that does not fit once never will.
    Weaker boundaries go first, so what the cuts that are left are weakest at is the coarsest unit of which every one fits.
    """
    if len(text) <= limit:
        return FINEST[PARAGRAPH], [(0, 0, len(text))]
    starts, strength, free = atoms(text, limit, overlap)
    n = len(starts)
    end = [*starts[1:], len(text)]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strength[i + 1], end[i + 1] - starts[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or end[j] - starts[i] != size or size + (0 if free[j] else overlap) > limit:
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if (k := after[i]) < n:
            before[k] = i
            heapq.heappush(heap, (strength[k], end[k] - starts[i], i, k))
        if (h := before[i]) >= 0:
            heapq.heappush(heap, (strength[i], end[i] - starts[h], h, i))
    kept = [i for i in range(n) if alive[i]]
    out = [(_back(text, starts[i], min(overlap, limit - (end[i] - starts[i]))) if i else 0, starts[i], end[i]) for i in kept]
    return FINEST[min((strength[i] for i in kept[1:]), default=PARAGRAPH)], out


def _back(text: str, start: int, overlap: int) -> int:
    """Where the repeated part before ``start`` begins: at a sentence if one begins there, else at a word, else ``overlap`` back."""
    low = max(0, start - overlap)
    for at in (_sentence, _word):
        for m in at.finditer(text, low, start):
            if low < m.end() < start:
                return m.end()
    return low


def split_pieces(df: DataFrame, key: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``key`` columns, ``finest`` (paragraph, sentence, word or none: the weakest boundary that was cut), ``piece`` (from 0), ``overlap_start``, ``start``, ``end`` and ``piece_text``, of texts over the limit.

    A piece is the text from ``overlap_start`` to ``end``, at most ``limit`` characters; the stretches from ``start`` to
    ``end`` are the whole text. Texts within the limit, empty and null ones give no rows. Repeated rows are split
    again; columns other than key and text are not read.
    """
    names = [f"k{i}" for i in range(len(key))]
    fields = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, key))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(key)).to_pylist()
            cuts = [pieces(t, limit, overlap) for t in texts]
            found = [(i, unit, p, *x, texts[i][x[0] : x[2]]) for i, (unit, own) in enumerate(cuts) for p, x in enumerate(own)]
            if found:
                i, *columns = zip(*found)
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                keys = [batch.column(c).take(pa.array(i)) for c in range(len(key))]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*names, *"abcdef"])

    rows = df.select(*(df[k].alias(n) for n, k in zip(names, key)), df[text].alias("text")).where(F.char_length("text") > limit)
    return rows.mapInArrow(cut, f"{fields}, finest string, piece int, overlap_start long, start long, end long, piece_text string").withColumnsRenamed(dict(zip(names, key)))
