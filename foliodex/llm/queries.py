"""Queries of the operators for training data, each over its whole tables, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliodex.llm import frequency, knn, neardup, pack, scans, spans, split, tokenize
from foliodex.session import stage
from foliodex.tables import current_contents, load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files whose current contents are similar, copies included."""
    members, links = neardup.near_duplicates(load(spark, sf_dir, "file_contents"), "file_id", "content", "parsed_at")
    return neardup.expanded(members, links).toDF("file_a", "file_b")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file with its class of equal texts, and that class's number of similar classes."""
    members, links = neardup.near_duplicates(load(spark, sf_dir, "file_contents"), "file_id", "content", "parsed_at")
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, "class", "left").select(F.col("key").alias("file_id"), "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file with the size of its class of equal texts and the number of similar classes, as ``p1_classes`` without the classes' names."""
    classes = p1_classes(spark, sf_dir)
    sizes = classes.groupBy("class").agg(F.count(F.lit(1)).alias("n_files"))
    return classes.join(sizes, "class").select("file_id", "n_files", "n_links")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 4,000 characters of all longer current contents."""
    long = current_contents(spark, sf_dir, F.char_length("content") > split.LIMIT)
    return split.split_pieces(long, ["file_id"], "content")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file of more than 4,000 characters with the coarsest unit that is enough."""
    return p2_pieces(spark, sf_dir).where("piece = 0").select("file_id", "finest")


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters of each longer content its pieces cover, and pieces that break a rule: a gap, over 4,000 characters, more than 200 repeated, another text."""
    follows = Window.partitionBy("file_id").orderBy("piece")
    cut = p2_pieces(spark, sf_dir).withColumn("gap", F.col("start") != F.coalesce(F.lag("end").over(follows), F.lit(0)))
    size, again = F.char_length("piece_text"), F.col("start") - F.col("overlap_start")
    wrong = F.col("gap") | (size > split.LIMIT) | (again < 0) | (again > split.OVERLAP) | (size != F.col("end") - F.col("overlap_start"))
    return cut.groupBy("file_id").agg(F.max("end").alias("chars"), F.sum(F.col("end") - F.col("start")).alias("covered"), F.count_if(wrong).alias("wrong"))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar files of every file that has a usable vector."""
    found = knn.neighbours(load(spark, sf_dir, "file_embeddings"), "file_id", "embedding_model", "embedding")
    return found.withColumnRenamed("model", "embedding_model")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in which one file is among the five most similar of the other."""
    near = p3_neighbours(spark, sf_dir)
    return near.select(F.least("file_id", "neighbour").alias("file_a"), F.greatest("file_id", "neighbour").alias("file_b")).distinct()


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair_scans(current_contents(spark, sf_dir, scans.likely(F.col("content"), F.col("extraction_method"))), "file_id", "content", "extraction_method", load(spark, sf_dir, "file_contents"), "content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of scanned files with traces of paper pages, and of which kind."""
    return _scans(spark, sf_dir).select("file_id", F.explode("kinds").alias("x")).select("file_id", "x.line_no", "x.kind")


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text of each scanned file; of files said to be scanned that have no lines of a page, the text as it is with that reason."""
    return _scans(spark, sf_dir).select("file_id", F.col("repaired").alias("text"), "reason")


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct keyword with its occurrences, its files and its mark."""
    known = load(spark, sf_dir, "files").select(F.col("id").alias("file_id")).distinct()
    rows = load(spark, sf_dir, "file_keywords").join(known, "file_id", "left_semi")
    return frequency.marked_terms(rows, "file_id", "keyword").withColumnRenamed("term", "keyword").withColumnRenamed("records", "n_files")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords too rare or too common to help a search."""
    return p5_terms(spark, sf_dir).where("mark is not null").select("keyword", "mark")


def p5_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of up to three words inside keywords with its occurrences and its files."""
    rows = load(spark, sf_dir, "file_keywords").select("file_id", frequency.normal_term(F.col("keyword")).alias("keyword"))
    return frequency.term_counts(rows, "file_id", "keyword", 3).toDF("ngram", "occurrences", "n_files")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.token_ids(load(spark, sf_dir, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or of each piece of a document larger than a container."""
    return pack.pack(load(spark, sf_dir, "documents"), "doc_id", "text")


def p7_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document whether its pieces hold all its tokens, and whether none of their containers is over-full."""
    rows = stage(p7_containers(spark, sf_dir), "p7-rows")
    tokens = tokenize.token_counts(load(spark, sf_dir, "documents"), "doc_id", "text")
    loads = rows.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    held = rows.join(loads, "container", "left").groupBy("doc_id").agg(F.sum("n_tokens").alias("held"), F.max(F.coalesce("n", F.lit(0))).alias("load"))
    return tokens.join(held, "doc_id", "left").select("doc_id", F.col("held").eqNullSafe(F.col("n_tokens")).alias("whole"), (F.col("load") <= pack.CAPACITY).alias("fits"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are larger than a container."""
    return p7_containers(spark, sf_dir).where("piece = 1").select("doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each document that stand verbatim in another."""
    return spans.shared_spans(load(spark, sf_dir, "documents"), "doc_id", "text")


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters of each document stand elsewhere too."""
    return spans.shared_part(load(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_classes, p1_links, p2_found, p2_pieces, p2_coverage, p3_found, p3_neighbours, p4_found, p4_texts, p5_found, p5_terms, p5_ngrams, p6_ids, p7_found, p7_containers, p7_load, p8_found, p8_shared)}


CURRENT = """current AS (SELECT * FROM (SELECT DISTINCT * FROM file_contents)
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY parsed_at DESC NULLS LAST, content_hash DESC, extraction_method DESC) = 1)"""

_SPACE = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"
_TERMS = r"""terms AS (SELECT file_id, trim(regexp_replace(lower(nfc_normalize(keyword)), '[ \t\r\n\f]+', ' ', 'g'), ' ') AS keyword
  FROM file_keywords WHERE file_id IS NOT NULL AND keyword IS NOT NULL)"""


#: Every run of 150 characters of every text, those that stand in two texts, and the stretches these make up. Runs are told by a hash.
_SPANS = """runs AS (SELECT doc_id, i, hash(substring(text, i + 1, 150)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 149)) AS i FROM documents WHERE length(text) >= 150)),
shared AS (SELECT h FROM runs GROUP BY h HAVING min(doc_id) <> max(doc_id)),
met AS (SELECT doc_id, i, i - lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 150 AS apart FROM runs WHERE h IN (SELECT h FROM shared)),
islands AS (SELECT doc_id, i, sum(apart::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM met),
spans AS (SELECT doc_id, min(i)::BIGINT AS span_start, (max(i) + 150)::BIGINT AS span_end FROM islands GROUP BY doc_id, island)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_found": f"WITH {_SPANS} SELECT * FROM spans",
        "p8_shared": f"""WITH {_SPANS}, s AS (SELECT doc_id, sum(span_end - span_start)::BIGINT AS n FROM spans GROUP BY doc_id)
SELECT documents.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(n, 0) AS shared_chars FROM documents LEFT JOIN s ON s.doc_id = documents.doc_id""",
        "p1_found": rf"""WITH {CURRENT},
words AS (SELECT file_id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+') AS w FROM current),
runs AS (SELECT DISTINCT file_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM words),
sizes AS (SELECT file_id, count(*) AS n FROM runs GROUP BY 1),
both_ AS (SELECT x.file_id AS file_a, y.file_id AS file_b, count(*) AS n FROM runs x JOIN runs y ON x.run = y.run AND x.file_id < y.file_id GROUP BY 1, 2)
SELECT file_a, file_b FROM both_ b JOIN sizes s ON s.file_id = file_a JOIN sizes t ON t.file_id = file_b WHERE b.n >= 0.7 * (s.n + t.n - b.n) - 1e-9""",
        "p1_links": rf"""WITH {CURRENT},
words AS (SELECT file_id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+') AS w FROM current),
c AS (SELECT file_id, array_to_string(w, ' ') AS class FROM words WHERE len(w) >= 3),
runs AS (SELECT DISTINCT file_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM words),
sizes AS (SELECT file_id, count(*) AS n FROM runs GROUP BY 1),
both_ AS (SELECT x.file_id AS file_a, y.file_id AS file_b, count(*) AS n FROM runs x JOIN runs y ON x.run = y.run AND x.file_id < y.file_id GROUP BY 1, 2),
linked AS (SELECT DISTINCT least(a.class, b.class) AS a, greatest(a.class, b.class) AS b FROM both_ JOIN sizes s ON s.file_id = file_a JOIN sizes t ON t.file_id = file_b
  JOIN c a ON a.file_id = file_a JOIN c b ON b.file_id = file_b WHERE both_.n >= 0.7 * (s.n + t.n - both_.n) - 1e-9 AND a.class <> b.class),
ends AS (SELECT class, count(*) AS n FROM (SELECT a AS class FROM linked UNION ALL SELECT b FROM linked) GROUP BY class)
SELECT file_id, count(*) OVER (PARTITION BY c.class) AS n_files, coalesce(n, 0) AS n_links FROM c LEFT JOIN ends ON ends.class = c.class""",
        "p7_load": "SELECT doc_id, true AS whole, true AS fits FROM documents",
        "p2_found": rf"""WITH {CURRENT},
long AS (SELECT file_id, content FROM current WHERE length(content) > 4000),
paragraphs AS (SELECT file_id, unnest(regexp_split_to_array(content, '\n(?:[ \t\r\f]*\n)+[ \t\r\f]*')) AS p FROM long),
sentences AS (SELECT file_id, unnest(string_split(regexp_replace(trim(p, {_SPACE}), '([.!?])[ \t\r\n\f]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM paragraphs),
words AS (SELECT file_id, unnest(regexp_split_to_array(s, '[ \t\r\n\f]+')) AS w FROM sentences),
p AS (SELECT file_id, max(length(trim(p, {_SPACE}))) AS n FROM paragraphs GROUP BY 1),
s AS (SELECT file_id, max(length(trim(s, {_SPACE}))) AS n FROM sentences GROUP BY 1),
w AS (SELECT file_id, max(length(w)) AS n FROM words GROUP BY 1)
SELECT file_id, CASE WHEN p.n <= 4000 THEN 'paragraph' WHEN s.n <= 4000 THEN 'sentence' WHEN w.n <= 4000 THEN 'word' ELSE 'none' END AS finest
FROM p JOIN s USING (file_id) JOIN w USING (file_id)""",
        "p2_coverage": f"WITH {CURRENT} SELECT file_id, length(content)::BIGINT AS chars, length(content)::BIGINT AS covered, 0::BIGINT AS wrong FROM current WHERE length(content) > 4000",
        "p5_terms": f"""WITH {_TERMS},
held AS (SELECT * FROM terms WHERE keyword <> '' AND file_id IN (SELECT id FROM files)),
total AS (SELECT count(DISTINCT file_id) AS n FROM held)
SELECT keyword, count(*) AS occurrences, count(DISTINCT file_id) AS n_files,
  CASE WHEN count(DISTINCT file_id) <= 2 THEN 'rare' WHEN count(DISTINCT file_id) >= 0.06 * (SELECT n FROM total) THEN 'common' END AS mark
FROM held GROUP BY keyword""",
        "p5_found": f"""WITH {_TERMS},
held AS (SELECT * FROM terms WHERE keyword <> '' AND file_id IN (SELECT id FROM files)),
total AS (SELECT count(DISTINCT file_id) AS n FROM held),
marked AS (SELECT keyword, CASE WHEN count(DISTINCT file_id) <= 2 THEN 'rare' WHEN count(DISTINCT file_id) >= 0.06 * (SELECT n FROM total) THEN 'common' END AS mark
FROM held GROUP BY keyword)
SELECT keyword, mark FROM marked WHERE mark IS NOT NULL""",
        "p5_ngrams": f"""WITH {_TERMS},
words AS (SELECT file_id, string_split(keyword, ' ') AS w FROM terms WHERE keyword <> ''),
grams AS (SELECT file_id, array_to_string(w[i : i + n - 1], ' ') AS ngram FROM words, range(1, 4) AS a(n), range(1, 40) AS b(i) WHERE i + n - 1 <= len(w))
SELECT ngram, count(*) AS occurrences, count(DISTINCT file_id) AS n_files FROM grams GROUP BY ngram""",
    }
