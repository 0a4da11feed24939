"""Keyword, vector and hybrid search over a file index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliodex.functions.text import n_tokens, phrase_count, token_line, under
from foliodex.functions.vectors import distance_to
from foliodex.session import stage

#: The BM25 constants and the floor of a term's weight; how many more rows than asked each side of a hybrid search brings.
K1, B, FLOOR = 1.2, 0.75, 1e-6
MORE_VECTORS, MORE_WORDS = 2, 4
SEARCHED = ("file_path", "title", "summary", "keywords")


def with_keywords(files: DataFrame, keywords: DataFrame, separator: str = " ") -> DataFrame:
    """``files`` with ``keywords``, its distinct keywords in order, joined; null where it has none."""
    kept = keywords.where("file_id is not null and keyword is not null")
    joined = kept.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("keyword")), separator).alias("keywords"))
    return files.join(joined, files["id"] == joined["file_id"], "left").drop("file_id")


def text_index(files: DataFrame, keywords: DataFrame) -> DataFrame:
    """id, file_path, a token line of each searched column, and ``dl``, the tokens of all."""
    rows = with_keywords(files, keywords).select("id", "file_path", *(token_line(F.col(c)).alias(f"line_{c}") for c in SEARCHED))
    return rows.withColumn("dl", sum((n_tokens(F.col(f"line_{c}")) for c in SEARCHED), F.lit(0)))


def bm25(index: DataFrame, phrase: str, limit: int | None = 20, directory: str | None = None) -> DataFrame:
    """id, file_path, score of the rows that hold the phrase within one column, best first; ties by id.

    Corpus figures are those of the whole index; ``directory`` only narrows the result, before ``limit``. A phrase
    without tokens has no result. The index is gone through once: each row's counts are kept in a table of their own.
    """
    counted = stage(index.select("id", "file_path", "dl", sum((phrase_count(F.col(f"line_{c}"), phrase) for c in SEARCHED), F.lit(0)).alias("f")), "bm25-counts")
    corpus = counted.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("f") > 0).alias("df"), F.avg("dl").alias("avgdl"))
    hits = counted.where("f > 0")
    if directory:
        hits = hits.where(under(F.col("file_path"), directory))
    scored = hits.crossJoin(F.broadcast(corpus)).select("id", "file_path", F.round(_weight(), 6).alias("score"))  # one row is broadcast
    return scored.orderBy(F.desc("score"), "id").limit(limit) if limit is not None else scored


def _weight() -> Column:
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.when(idf > 0, idf).otherwise(FLOOR) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def _pairs(tokens: Column) -> Column:
    zipped = F.arrays_zip(tokens.alias("a"), F.slice(tokens, 2, 1 << 30).alias("b"))
    return F.transform(F.filter(zipped, lambda x: x["b"].isNotNull()), lambda x: F.concat_ws(" ", x["a"], x["b"]))


def _grams(index: DataFrame, n: int) -> DataFrame:
    """id, dl, column, at, gram: every token (``n`` 1) or pair of neighbouring tokens (2) of (id, dl, lines), columns by number; in one pass."""
    one = lambda line, c: F.transform(F.split(F.trim(line), " ") if n == 1 else _pairs(F.split(F.trim(line), " ")), lambda g, at: F.struct(c.alias("column"), at.alias("at"), g.alias("gram")))
    return index.select("id", "dl", F.explode(F.flatten(F.transform("lines", one))).alias("x")).select("id", "dl", "x.*")


def bm25_batch(index: DataFrame, phrases: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, id, score, place of the best rows for each of many phrases (query_id, phrase) of any length; those without tokens have none.

    Tokens and pairs of neighbouring tokens meet in an equi-join, so no query scans all texts; a longer phrase meets by
    its rarest pair and is compared as a whole where that stands. Equal phrases are scored once. The index is made once and kept.
    """
    index = stage(index.select("id", "dl", F.array(*(f"line_{c}" for c in SEARCHED)).alias("lines")), "bm25-index")
    asked = stage(phrases.select("query_id", F.trim(token_line(F.col("phrase"))).alias("phrase")).where("phrase <> ''"), "bm25-asked")
    words = F.split("phrase", " ")
    sought = asked.select("phrase").distinct()
    lengths = {r["n"] for r in sought.select(F.least(F.size(words), F.lit(3)).alias("n")).distinct().collect()}  # at most three
    parts = [_grams(index, n).withColumnRenamed("gram", "phrase").join(sought.where(F.size(words) == n), "phrase").select("phrase", "id", "dl") for n in (1, 2) if n in lengths]
    if 3 in lengths or not parts:
        own = sought.where(F.size(words) > 2).select("phrase", F.posexplode(_pairs(words)).alias("offset", "gram"))
        # only where pairs of some phrase stand; how often each does says which is the rarest
        met = stage(_grams(index, 2).join(own.select("gram").distinct(), "gram", "left_semi").select("id", "column", "at", "gram"), "bm25-pairs")
        seen = met.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        rarest = own.join(seen, "gram").groupBy("phrase").agg(F.min(F.struct("n", "offset", "gram")).alias("x"), F.count(F.lit(1)).alias("pairs"))
        rarest = rarest.where(F.col("pairs") == F.size(words) - 1).select("phrase", "x.offset", "x.gram")  # a phrase with a pair that stands nowhere is nowhere
        hits = met.join(rarest, "gram").where("at >= offset").select("id", "column", "phrase", (F.col("at") - F.col("offset") + 1).alias("start"))
        whole = F.slice(F.split(F.trim(F.get("lines", F.col("column"))), " "), F.col("start"), F.size(words)) == words
        parts.append(hits.join(index, "id").where(whole).select("phrase", "id", "dl"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    counts = stage(found.groupBy("phrase", "id", "dl").agg(F.count(F.lit(1)).alias("f")), "bm25-hits")
    of_phrase = counts.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    corpus = index.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    scored = counts.join(of_phrase, "phrase").crossJoin(F.broadcast(corpus)).select("phrase", "id", F.round(_weight(), 6).alias("score"))
    best = Window.partitionBy("phrase").orderBy(F.desc("score"), "id")
    top = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
    return asked.join(top, "phrase").select("query_id", "id", "score", "place")


def knn(vectors: DataFrame, query: list[float], k: int = 10, threshold: float | None = None, directory: str | None = None, prefilter: bool = False) -> DataFrame:
    """id, file_path, distance of the ``k`` nearest of (id, file_path, embedding), nearest first; ties by id.

    The threshold and the directory narrow the ``k`` found, unless ``prefilter``: then the ``k`` nearest of the directory.
    """
    rows = vectors.select("id", "file_path", F.round(distance_to(query)("embedding"), 6).alias("distance")).where("distance is not null")
    if directory and prefilter:
        rows = rows.where(under(F.col("file_path"), directory))
    near = rows.orderBy("distance", "id").limit(k)
    if threshold is not None:
        near = near.where(F.col("distance") <= threshold)
    if directory and not prefilter:
        near = near.where(under(F.col("file_path"), directory))
    return near.orderBy("distance", "id")


def merged(semantic: DataFrame, keyword: DataFrame, limit: int = 20, semantic_weight: float = 0.5, keyword_weight: float = 0.5) -> DataFrame:
    """Search results of the two sides as one list: weighted closeness and keyword score, best first; ties by id."""
    near = semantic.select("id", F.col("file_path").alias("near_path"), "distance")
    both = near.join(keyword.withColumnRenamed("score", "keyword_score"), "id", "full_outer")
    close = F.coalesce(F.exp(-F.col("distance")) * semantic_weight, F.lit(0.0))
    words = F.coalesce(F.col("keyword_score") * keyword_weight, F.lit(0.0))
    kind = F.when((close > 0) & (words > 0), "hybrid").when(words > 0, "keyword").when(close > 0, "semantic").otherwise("none")
    rows = both.select("id", F.coalesce("near_path", "file_path").alias("file_path"), F.col("distance").alias("semantic_score"), "keyword_score", F.round(close + words, 6).alias("combined_score"), kind.alias("match_type"))
    return rows.orderBy(F.desc("combined_score"), "id").limit(limit)


def hybrid(index: DataFrame, vectors: DataFrame, phrase: str, query: list[float], limit: int = 20, threshold: float | None = 2.0, directory: str | None = None, weights: tuple[float, float] | None = None) -> DataFrame:
    """Vector and keyword search merged. ``weights`` of the two sides are brought to a sum of one; by default both count half."""
    total = sum(weights) if weights else 0.0
    a, b = (w / total for w in weights) if weights and total > 0 else (0.5, 0.5)
    return merged(knn(vectors, query, limit * MORE_VECTORS, threshold, directory), bm25(index, phrase, limit * MORE_WORDS, directory), limit, a, b)


def search(index: DataFrame, vectors: DataFrame, phrase: str, query: list[float], limit: int = 20, mode: str = "hybrid", directory: str | None = None) -> DataFrame:
    """Search by ``mode``: hybrid, semantic or keyword."""
    if mode == "semantic":
        return knn(vectors, query, limit, 1.5, directory)
    if mode == "keyword":
        return bm25(index, phrase, limit, directory)
    if mode != "hybrid":
        raise ValueError(f"no such search: {mode}")
    return hybrid(index, vectors, phrase, query, limit, 1.5, directory)


def similar_to(vectors: DataFrame, file_id: int, query: list[float], limit: int = 10, threshold: float = 0.8) -> DataFrame:
    """The files nearest to one file, without itself; score 1 - distance, 0 at least."""
    near = knn(vectors, query, limit + 1, threshold).where(F.col("id") != file_id)
    return near.withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - F.col("distance")), 6)).orderBy("distance", "id").limit(limit)


def as_json(results: DataFrame) -> DataFrame:
    """``json``: each search result as the object a client gets."""
    return results.select(F.to_json(F.struct("id", "file_path", "semantic_score", "keyword_score", "combined_score", "match_type"), {"ignoreNullFields": "false"}).alias("json"))


def single_score(distance: Column, keyword: Column) -> Column:
    """One score of a result: seven tenths closeness and three tenths keyword score where it has both, else the one it has."""
    close = F.when(distance.isNotNull(), F.greatest(F.lit(0.0), 1 - distance))
    return F.when(distance.isNotNull() & keyword.isNotNull(), 0.7 * close + 0.3 * keyword).otherwise(F.coalesce(close, keyword, F.lit(0.0)))


def suggestions(files: DataFrame, keywords: DataFrame, prefix: str, limit: int | None = 5) -> DataFrame:
    """Keywords, and title words over two characters, that begin with ``prefix`` whatever the case; in order."""
    low = prefix.lower()
    words = files.select(F.explode(F.split("title", r"\s+")).alias("suggestion")).where(F.char_length("suggestion") > 2)
    both = keywords.where("keyword is not null").select(F.col("keyword").alias("suggestion")).unionByName(words)
    found = both.where(F.lower("suggestion").startswith(low)).distinct()
    return found.orderBy("suggestion").limit(limit) if limit is not None else found


def keyword_search(files: DataFrame, keywords: DataFrame, wanted: list[str], match_all: bool = False, limit: int | None = None) -> DataFrame:
    """id, file_path, matches of files that hold any, or all, of the wanted keywords; most matches first, ties by id."""
    wanted = list(dict.fromkeys(wanted))
    hits = keywords.where(F.col("keyword").isin(wanted)).groupBy("file_id").agg(F.countDistinct("keyword").alias("matches"))
    if match_all:
        hits = hits.where(F.col("matches") == len(wanted))
    rows = files.join(hits, files["id"] == hits["file_id"]).select("id", "file_path", "matches")
    return rows.orderBy(F.desc("matches"), "id").limit(limit) if limit is not None else rows
