"""Slots for models: summaries, keywords, vectors; with defaults that need no model and no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliodex.functions.text import fold, parsed_response, strip
from foliodex.operators.chunks import PER_SENTENCE, chunked, merged_keywords, merged_summaries
from foliodex.session import stage

Embed = Callable[[list[str]], np.ndarray]
Summarise = Callable[[list[str]], list[str]]


def hashed_embedding(dims: int = 64) -> Embed:
    """An embedder by signed hashing of words, the same everywhere; texts without words give zeros."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dims), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                out[i, h % dims] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return embed


def first_working(providers: Sequence[Callable[[], Callable]]) -> Callable:
    """A function that calls the models of the providers in order until one works; each model is made once."""
    made: dict[int, Callable] = {}

    def call(texts: list[str]):
        failure: Exception | None = None
        for i, provider in enumerate(providers):
            try:
                if i not in made:
                    made[i] = provider()
                return made[i](texts)
            except Exception as e:  # the next provider may work
                failure = e
        raise RuntimeError("no provider works") from failure

    return call


def embedded(df: DataFrame, text: str, providers: Sequence[Callable[[], Embed]], dims: int, name: str = "embedding") -> DataFrame:
    """``df`` with the column ``name``: the vector of ``text`` by the first provider that works, cut to ``dims``; null for null and blank texts.

    A provider makes its model once for each worker. Dimensions from 32 to 1536 are allowed.
    """
    if not 32 <= dims <= 1536:
        raise ValueError(f"dimensions must be from 32 to 1536, not {dims}")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = first_working(providers)
        for texts in batches:
            live = [i for i, t in enumerate(texts) if t and t.strip()]
            out: list = [None] * len(texts)
            if live:
                found = np.asarray(model([texts.iloc[i] for i in live]))[:, :dims]
                for i, v in zip(live, found):
                    out[i] = v.astype(np.float32).tolist()
            yield pd.Series(out)

    return df.withColumn(name, vectors(F.col(text)))


def extracted_title(text: Column, words: int = 5) -> Column:
    """The first words of a text."""
    return F.concat_ws(" ", F.slice(F.split(strip(text), r"\s+"), 1, words))


def extracted_summary(text: Column, most: int = 200) -> Column:
    """The first sentence, or the first characters."""
    s = strip(text)
    sentence = F.regexp_extract(s, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    return F.when((sentence != "") & (F.char_length(sentence) <= most), sentence).otherwise(F.substring(s, 1, most))


def extracted_keywords(df: DataFrame, key: str, text: str, most: int = 12) -> DataFrame:
    """(key, keywords): each text's most frequent words of more than three characters, ties in order."""
    words = df.select(key, F.explode(F.split(fold(F.col(text)), r"[^\p{L}\p{N}]+")).alias("word")).where(F.char_length("word") > 3)
    counted = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    listed = counted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("all"))
    return listed.select(key, F.transform(F.slice("all", 1, most), lambda x: x["word"]).alias("keywords"))


def extractive_summariser() -> Summarise:
    """A summariser that answers as a language model is asked to, with the text's own first words, first sentence and frequent words."""
    import json
    import re
    from collections import Counter

    def summarise(texts: list[str]) -> list[str]:
        out = []
        for text in texts:
            s = text.strip()
            sentence = re.match(r"(?s).*?[.!?](?=\s|$)", s)
            counts = Counter(w for w in re.findall(r"[^\W_]{4,}", s.lower()))
            words = sorted(counts, key=lambda w: (-counts[w], w))[:12]
            summary = sentence[0] if sentence and len(sentence[0]) <= 200 else s[:200]
            out.append(json.dumps({"title": " ".join(s.split()[:5]), "summary": summary, "keywords": words}, ensure_ascii=False))
        return out

    return summarise


def summarised(df: DataFrame, key: str, text: str, providers: Sequence[Callable[[], Summarise]], limit: int = 8_192, overlap: int = PER_SENTENCE, **left_out: object) -> DataFrame:
    """(key, title, summary, keywords, n_chunks, error) of each text: chunks are summarised by the first provider that works, and merged.

    The title is that of the first chunk. A text that cannot be chunked, and one of whose responses cannot be read, has an error and
    no summary. ``left_out`` are the switches of ``chunked`` that leave something out, all off by default. ``key`` is unique.
    """

    @F.pandas_udf(T.StringType())
    def respond(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = first_working(providers)
        for texts in batches:
            live = [i for i, t in enumerate(texts) if t]
            out: list = [None] * len(texts)
            if live:
                for i, response in zip(live, model([texts.iloc[i] for i in live])):
                    out[i] = response
            yield pd.Series(out, dtype=object)

    cut = chunked(df, key, text, limit, overlap, **left_out)
    answers = cut.withColumn("r", F.when(F.col("error").isNull(), parsed_response(respond("chunk"))))
    rows = stage(answers.select(key, "chunk_no", "n_chunks", F.coalesce("error", "r.error").alias("error"), "r.title", "r.summary", "r.keywords"), "summaries")
    whole = rows.groupBy(key).agg(
        F.min("error").alias("error"),
        F.max("n_chunks").alias("n_chunks"),
        F.min_by("title", "chunk_no").alias("title"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "keywords"))), lambda x: F.coalesce(x["keywords"], F.array().cast("array<string>")))).alias("all"),
    )
    merged = merged_summaries(rows.where("error is null"), key, "chunk_no", "summary").withColumnRenamed("merged", "summary")
    keywords = F.when(F.col("n_chunks") > 1, merged_keywords(F.col("all"))).otherwise(F.array_distinct("all"))
    ok = F.col("error").isNull()
    return whole.join(merged, key, "left").select(key, F.when(ok, F.col("title")).alias("title"), F.when(ok, F.col("summary")).alias("summary"), F.when(ok, keywords).alias("keywords"), "n_chunks", "error")
