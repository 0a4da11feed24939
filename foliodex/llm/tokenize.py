"""Token ids of a public byte-level BPE vocabulary, by speculation and verification.

Longest matches are proposed for each distinct word; a proposal is the word's encoding exactly if every
adjacent pair of its tokens is compatible, which is tested for all distinct pairs at once on arrays.
Only words with an incompatible pair go through the merges one by one.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabularies of public tokenizers lie; a parameter of every function that reads one.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Distinct words a worker remembers; beyond it the memory is emptied, which costs time only.
REMEMBERED = 400_000
#: Characters tokenized at once.
SLICE = 2_000_000

NEVER = np.int64(1) << 40


def _byte_of_symbol() -> dict[str, int]:
    """The bytes that the vocabulary's printable symbols stand for: printable Latin-1 for themselves, the rest from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and the pair test of one byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        symbol = _byte_of_symbol()
        spelled = {t: bytes(map(symbol.__getitem__, t)) for t in model["vocab"] if all(c in symbol for c in t)}
        self.ids = {spelled[t]: i for t, i in model["vocab"].items() if t in spelled}
        self.longest = max(map(len, self.ids))
        size = max(self.ids.values()) + 1
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        vocab = model["vocab"]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges)))
        self.rank, self.first, self.last = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
        order = np.arange(len(made))[::-1]  # of two merges that make one token, the earlier counts
        self.rank[made[order]], self.first[made[order]], self.last[made[order]] = order + 1, left[order], right[order]
        keys = left << 32 | right
        by = np.argsort(keys)
        self._keys, self._ranks = np.append(keys[by], np.int64(2**62)), np.append(by + 1, NEVER)
        self.merge = {(int(a), int(b)): (k, int(m)) for k, (a, b, m) in enumerate(zip(left, right, made))}

    def propose(self, word: bytes) -> list[int]:
        """Longest matches from the left."""
        ids, at, n, found = self.ids, 0, len(word), []
        while at < n:
            end = min(n, at + self.longest)
            while (t := ids.get(word[at:end])) is None:
                end -= 1
            found.append(t)
            at = end
        return found

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge ever joins the touching edges of tokens ``a`` and ``b``.

        The parts at the edge are taken back in time, the later made one first. While two parts stand side
        by side, a merge of them must not come before either goes into a larger part; of two equal merges
        the left one comes first.
        """
        x, y, good = a.copy(), b.copy(), np.ones(len(a), bool)
        until, live = np.full(len(a), NEVER), np.arange(len(a))
        while len(live):
            keys = x[live] << 32 | y[live]
            at = np.searchsorted(self._keys, keys)
            rank = np.where(self._keys[at] == keys, self._ranks[at], NEVER)
            bad = rank < until[live]
            good[live[bad]] = False
            live = live[~bad]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            more = (rx > 0) | (ry > 0)
            live, rx, ry = live[more], rx[more], ry[more]
            of_x = rx > ry
            i, j = live[of_x], live[~of_x]
            until[i], x[i] = rx[of_x], self.last[x[i]]
            until[j], y[j] = ry[~of_x] + 1, self.first[y[j]]
        return good

    def exact(self, word: bytes) -> list[int]:
        """The merges one by one, lowest rank first, leftmost of equal ones first; n log n in the word's length."""
        ids = [self.ids[bytes([b])] for b in word]
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = merge[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := merge.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]


class Encoder:
    """Encodes slices of texts; remembers distinct words between slices."""

    def __init__(self, path: str) -> None:
        import regex

        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(PATTERN).findall
        self.seam = regex.compile(r"(?<=\S)(?=\s)").search
        self.pairs: dict[int, bool] = {}
        self.failed = self.seen = 0
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.lengths = [np.empty(0, np.int32)], [np.empty(0, np.int64)]

    def _learn(self, words: list[str]) -> None:
        """Encode distinct new words and append them to the memory."""
        v = self.vocabulary
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        known = v.ids.get
        proposals = [[t] if (t := known(r)) is not None else v.propose(r) for r in raw]
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False  # the last token of a word has no partner
        left = np.flatnonzero(inside)
        keys, back = np.unique(flat[left] << 32 | flat[left + 1], return_inverse=True)
        good = v.compatible(keys >> 32, keys & 0xFFFFFFFF)[back]
        owner = np.repeat(np.arange(len(words)), lengths)
        failing = np.unique(owner[left[~good]])
        if len(failing):
            for i in failing.tolist():
                proposals[i] = v.exact(raw[i])
            lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
            flat = np.fromiter((t for p in proposals for t in p), np.int64, int(lengths.sum()))
        self.seen, self.failed = self.seen + len(words), self.failed + len(failing)
        self.flat.append(flat.astype(np.int32))
        self.lengths.append(lengths)

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a text; those of a long one in parts, cut before white space, where a word always ends."""
        start = 0
        while len(text) - start > SLICE and (cut := self.seam(text, start + SLICE)):
            yield self.split(text[start : cut.start()])
            start = cut.start()
        yield self.split(text[start:] if start else text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and each text's number of ids; none for a null or empty text."""
        if len(self.index) > REMEMBERED:
            self._forget()
        index, found, counts, new = self.index, [], [], []
        for text in texts:
            before = len(found)
            for words in self._words(text) if text else ():
                for w in words:
                    if w not in index:
                        index[w] = len(index)
                        new.append(w)
                found.extend(map(index.__getitem__, words))
            counts.append(len(found) - before)
        if new:
            self._learn(new)
            self.flat, self.lengths = [np.concatenate(self.flat)], [np.concatenate(self.lengths)]
        flat, lengths = self.flat[0], self.lengths[0]
        starts = np.cumsum(lengths) - lengths
        of = np.array(found, np.int64)
        n = lengths[of]
        total = int(n.sum())
        ids = flat[np.repeat(starts[of] - (np.cumsum(n) - n), n) + np.arange(total)] if total else np.empty(0, np.int32)
        sums = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(np.array(counts, np.int64))
        upto = sums[np.concatenate([[0], ends])]
        return ids, np.diff(upto)


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE`` characters; a longer text is a range of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= SLICE:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def token_ids(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and ``ids``, the token ids of the column ``text``, for each row of ``df``.

    A null and an empty text give the empty list; strings that look like special tokens are ordinary
    text. Rows keep their number, whatever repeats in ``key`` or ``text``; other columns are not read.
    ``path`` names the vocabulary file, which every executor must be able to read.
    """
    path = path or f"{TOKENIZERS}/{VOCABULARY}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids, n = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[text].cast("string").alias("text")).mapInArrow(encode, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens``, the number of tokens of the column ``text``; 0 for null and empty texts."""
    path = path or f"{TOKENIZERS}/{VOCABULARY}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(encoder.encode(texts[a:b])[1], pa.int64())], names=["key", "n"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[text].cast("string").alias("text")).mapInArrow(count, f"key {kind}, n long").toDF(key, "n_tokens")
