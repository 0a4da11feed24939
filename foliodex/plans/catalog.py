"""All registered queries over the file-index tables, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliodex.functions import text, vectors
from foliodex.operators import chunks, models, search, state, views, watch
from foliodex.plans.batch import knn_batch
from foliodex.plans.oracles import ORACLES
from foliodex.session import stage
from foliodex.streaming import events, updates
from foliodex.tables import current_contents, current_files, load, newest

#: The lengths of the vectors of each model.
MODELS = {"local-small-64": 64, "online-mid-96": 96}
TERM, PHRASE, DIRECTORY, SINCE = "regional", "every report", "/data/share", "2023-01-15"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "file_keywords").where("file_id is not null and keyword is not null").distinct()


def _vectors(spark: SparkSession, sf_dir: str, model: str, files: DataFrame | None = None) -> DataFrame:
    """id, file_path, embedding of the current files that have a usable vector of the model, cut or filled to its length."""
    rows = load(spark, sf_dir, "file_embeddings").where(F.col("embedding_model") == model).select("file_id", vectors.fitted(F.col("embedding"), MODELS[model]).alias("embedding"))
    rows = rows.where(vectors.usable(F.col("embedding"))).groupBy("file_id").agg(F.max("embedding").alias("embedding"))
    files = (current_files(spark, sf_dir, "file_path") if files is None else files).select("id", "file_path")
    return files.join(rows, files["id"] == rows["file_id"]).select("id", "file_path", "embedding")


def _each_model(spark: SparkSession, sf_dir: str, ask: Callable[[DataFrame, int, list[float]], DataFrame], files: DataFrame | None = None) -> DataFrame:
    """What ``ask`` finds among the vectors of each model, for the vector of the smallest id, with the model's name."""
    found = []
    for model, dims in MODELS.items():
        rows = stage(_vectors(spark, sf_dir, model, files), "vectors")
        own = rows.orderBy("id").select("id", "embedding").first()
        first, vector = (own["id"], own["embedding"]) if own else (-1, [1.0] + [0.0] * (dims - 1))
        found.append(ask(rows, first, vector).withColumn("embedding_model", F.lit(model)))
    return reduce(DataFrame.unionByName, found)


def _hybrid(spark: SparkSession, sf_dir: str, limit: int, directory: str | None = None, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Hybrid searches with each model; files are brought to current rows, and words counted, once for all."""
    files = stage(current_files(spark, sf_dir, "file_path", "title", "summary"), "files")
    words = stage(search.bm25(search.text_index(files, _keywords(spark, sf_dir)), TERM, limit * search.MORE_WORDS, directory), "words")
    return _each_model(spark, sf_dir, lambda rows, _, vector: search.merged(search.knn(rows, vector, limit * search.MORE_VECTORS, 2.0, directory), words, limit, *weights), files)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_index(current_files(spark, sf_dir, "file_path", "title", "summary"), _keywords(spark, sf_dir))


# scans and views


@query
def files_scan(spark, sf_dir):
    """The current row of every file, as a client sees it."""
    rows = views.responses(current_files(spark, sf_dir, "filename", "extension", "file_path", "created", "modified", "title", "summary"))
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created", "modified")})


@query
def file_kinds(spark, sf_dir):
    return views.kinds(current_files(spark, sf_dir, "file_path"))


@query
def files_by_event_path(spark, sf_dir):
    """Point lookups by path, for all paths of the event table at once."""
    paths = load(spark, sf_dir, "fs_events").select(F.col("src_path").alias("file_path")).distinct()
    return current_files(spark, sf_dir, "file_path", "status").join(paths, "file_path", "left_semi").select("id", "file_path", "status")


@query
def content_hash_dupes(spark, sf_dir):
    return views.hash_groups(current_contents(spark, sf_dir))


@query
def files_by_hash(spark, sf_dir):
    """Point lookups by content hash: files whose recorded hash, whatever its case and spaces, is that of their current content."""
    files = current_files(spark, sf_dir, "content_hash").select("id", F.lower(F.trim("content_hash")).alias("recorded"))
    held = current_contents(spark, sf_dir).where("content is not null").select(F.col("file_id").alias("id"), F.sha2("content", 256).alias("sha256"))
    return files.join(held, "id").select("id", "sha256", F.coalesce(F.col("recorded") == F.col("sha256"), F.lit(False)).alias("agrees"))


@query
def file_types(spark, sf_dir):
    """The kind of content of every file by its extension, beside the one recorded."""
    rows = current_files(spark, sf_dir, "extension", "content_type")
    return rows.select("id", text.mime_type(F.col("extension")).alias("by_extension"), "content_type")


@query
def files_page(spark, sf_dir):
    """The second page of thirty Markdown files."""
    rows = views.page(current_files(spark, sf_dir, "filename", "extension", "file_path", "created", "modified", "title", "summary"), 2, 30, ".md")
    return rows.select("id", "filename", "extension", "title")


@query
def size_errors(spark, sf_dir):
    """Files over a size of 100,000 bytes, which are not read."""
    return views.too_large(current_files(spark, sf_dir, "file_path", "file_size"), 100_000).select("id", "file_path", "file_size", "error")


@query
def checked_statuses(spark, sf_dir):
    """Files by status, after a check that no other status is there."""
    rows = views.checked(current_files(spark, sf_dir, "status"), "status", ["DISCOVERED", "PARSED", "SUMMARIZED", "COMPLETE", "FAILED"])
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@query
def dir_scope(spark, sf_dir):
    return current_files(spark, sf_dir, "file_path", "file_size").where(text.under(F.col("file_path"), DIRECTORY)).select("id", "file_path", "file_size")


@query
def files_with_keywords(spark, sf_dir):
    return views.files_with_keywords(current_files(spark, sf_dir, "file_path", "title", "status"), _keywords(spark, sf_dir)).select("id", "file_path", "title", "status", "keywords")


@query
def files_searchable(spark, sf_dir):
    return views.files_searchable(current_files(spark, sf_dir, "file_path", "title", "summary"), _keywords(spark, sf_dir)).select("id", "file_path", "title", "summary", "keywords")


@query
def processing_summary(spark, sf_dir):
    return views.processing_summary(current_files(spark, sf_dir, "status", "file_size"))


@query
def recent_activity(spark, sf_dir):
    return views.recent_activity(current_files(spark, sf_dir, "filename", "status", "created_at"))


@query
def file_stats(spark, sf_dir):
    return views.file_stats(current_files(spark, sf_dir, "file_size"))


@query
def extension_counts(spark, sf_dir):
    return views.extension_counts(current_files(spark, sf_dir, "extension", "file_size"))


@query
def extraction_counters(spark, sf_dir):
    return views.extraction_counters(current_contents(spark, sf_dir))


@query
def token_statistics(spark, sf_dir):
    return views.token_statistics(current_contents(spark, sf_dir))


@query
def session_stats(spark, sf_dir):
    return views.session_stats(load(spark, sf_dir, "processing_stats"))


@query
def image_infos(spark, sf_dir):
    """Images by what their description says: read back from the text and written anew."""
    rows = current_contents(spark, sf_dir, F.col("content").startswith("Image file: ")).select("file_id", "content")
    part = lambda group: F.regexp_extract("content", r"^Image file: (\S+) \((\d+)x(\d+), mode (\w+)\), Size: (\d+) bytes, Type: (\w+)", group)
    named = rows.select("file_id", part(1).alias("name"), *(F.try_to_number(part(g), F.lit("9999999999999")).cast("long").alias(n) for g, n in ((2, "width"), (3, "height"), (5, "bytes"))), part(4).alias("mode"), part(6).alias("kind"))
    return named.select("file_id", "name", "width", "height", "bytes", text.image_description(F.col("name"), F.col("width"), F.col("height"), F.col("mode"), F.col("bytes"), F.col("kind")).alias("description"))


# text functions


@query
def embedding_texts(spark, sf_dir):
    listed = _keywords(spark, sf_dir).groupBy("file_id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    files = current_files(spark, sf_dir, "title", "summary")
    return files.join(listed, files["id"] == listed["file_id"], "left").select("id", text.embedding_text(F.col("title"), F.col("summary"), F.col("keywords")).alias("embedding_text"))


@query
def model_responses(spark, sf_dir):
    """Titles, summaries and keywords as a fenced response, and read back from it."""
    listed = _keywords(spark, sf_dir).groupBy("file_id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    files = current_files(spark, sf_dir, "title", "summary")
    rows = files.join(listed, files["id"] == listed["file_id"], "left")
    response = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct("title", "summary", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))), F.lit("\n```"))
    parsed = rows.select("id", text.parsed_response(response).alias("x"))
    return parsed.select("id", "x.title", "x.summary", F.array_join("x.keywords", "|").alias("keywords"), "x.error")


@query
def keyword_merge(spark, sf_dir):
    """Keywords of each file that differ by more than case, fifteen at most."""
    listed = _keywords(spark, sf_dir).groupBy("file_id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    return listed.select("file_id", F.array_join(chunks.merged_keywords(F.col("keywords")), "|").alias("keywords"))


@query
def directory_summaries(spark, sf_dir):
    """The summaries of each directory's files merged as those of chunks are."""
    files = current_files(spark, sf_dir, "file_path", "summary").select("id", text.parent(F.col("file_path")).alias("directory"), "summary")
    return chunks.merged_summaries(files, "directory", "id", "summary")


@query
def chunk_contents(spark, sf_dir):
    """Chunks of all current contents, none of it left out, for a model of 512 tokens."""
    return chunks.chunked(current_contents(spark, sf_dir), "file_id", "content", 512).select("file_id", "chunk_no", "n_chunks", "tokens", "error")


@query
def chunk_coverage(spark, sf_dir):
    """How many characters of each current content its chunks cover, chunks that do not begin where the one before ends, and chunks over 512 tokens."""
    cut = chunks.chunked(current_contents(spark, sf_dir), "file_id", "content", 512).where("error is null")
    follows = Window.partitionBy("file_id").orderBy("chunk_no")
    marked = cut.withColumn("gap", F.col("start") != F.coalesce(F.lag("end").over(follows), F.lit(0)))
    return marked.groupBy("file_id").agg(F.max("end").alias("chars"), F.sum(F.col("end") - F.col("start")).alias("covered"), F.count_if("gap").alias("gaps"), F.count_if((F.col("tokens") > 512) | (F.char_length("chunk") != F.col("end") - F.col("overlap_start"))).alias("over_limit"))


@query
def keyword_strings(spark, sf_dir):
    """Keywords of each file written in one string, every other one after two bars, and read back."""
    listed = _keywords(spark, sf_dir).where(~F.col("keyword").rlike(r"[,|]")).groupBy("file_id").agg(F.array_sort(F.collect_set("keyword")).alias("k"))
    written = F.aggregate("k", F.lit(""), lambda done, k: F.concat(done, F.when(F.length(done) % 2 == 0, " || ").otherwise(" , "), k))
    return listed.select("file_id", F.array_join(text.split_keywords(written), "|").alias("keywords"))


@query
def embedded_documents(spark, sf_dir):
    """Every document through the embedder slot: the length of its vector, null of blank texts, which are not sent."""
    found = models.embedded(load(spark, sf_dir, "documents").select("doc_id", "text"), "text", [models.hashed_embedding], 64)
    return found.select("doc_id", F.size("embedding").alias("dimensions"))


@query
def extracted_keywords(spark, sf_dir):
    """The most frequent words of every document."""
    found = models.extracted_keywords(load(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.array_join("keywords", " ").alias("keywords"))


@query
def extractive_summaries(spark, sf_dir):
    rows = current_contents(spark, sf_dir, text.long_enough(F.col("content")))
    return rows.select("file_id", models.extracted_title(F.col("content")).alias("title"), F.char_length(models.extracted_summary(F.col("content"))).alias("summary_chars"))


@query
def summarised_contents(spark, sf_dir):
    """All current contents through the summariser slot: in chunks of 1,024 tokens, merged."""
    found = models.summarised(current_contents(spark, sf_dir), "file_id", "content", [models.extractive_summariser], 1_024)
    return found.select("file_id", "title", F.char_length("summary").alias("summary_chars"), F.array_join("keywords", " ").alias("keywords"), "n_chunks", "error")


# vectors


@query
def vector_quality(spark, sf_dir):
    """Vectors by model: rows, usable ones, those of another length than recorded."""
    rows = load(spark, sf_dir, "file_embeddings").distinct()
    return rows.groupBy("embedding_model").agg(
        F.count(F.lit(1)).alias("vectors"), F.count_if(vectors.usable(F.col("embedding"))).alias("usable"), F.count_if(~F.col("embedding_dimensions").eqNullSafe(F.size("embedding")) | F.col("embedding").isNull()).alias("other_length")
    )


@query
def pad_truncate(spark, sf_dir):
    """Vectors brought to 80 values and to length one: their sum of squares and last value."""
    rows = load(spark, sf_dir, "file_embeddings").distinct().where(vectors.usable(F.col("embedding")))
    fitted = rows.select("file_id", "embedding_model", vectors.unit(vectors.fitted(F.col("embedding"), 80)).alias("v"))
    return fitted.select("file_id", "embedding_model", F.round(vectors.norm(F.col("v")), 4).alias("length"), F.round(F.get("v", F.lit(0)).cast("double"), 4).alias("first_value"))


@query
def knn_l2(spark, sf_dir):
    return _each_model(spark, sf_dir, lambda rows, _, vector: search.knn(rows, vector, 40))


@query
def knn_threshold(spark, sf_dir):
    return _each_model(spark, sf_dir, lambda rows, _, vector: search.knn(rows, vector, 200, threshold=1.0))


@query
def knn_dir_postfilter(spark, sf_dir):
    return _each_model(spark, sf_dir, lambda rows, _, vector: search.knn(rows, vector, 200, directory=DIRECTORY))


@query
def knn_dir_prefilter(spark, sf_dir):
    return _each_model(spark, sf_dir, lambda rows, _, vector: search.knn(rows, vector, 50, directory=DIRECTORY, prefilter=True))


@query
def similar_to_file(spark, sf_dir):
    return _each_model(spark, sf_dir, lambda rows, first, vector: search.similar_to(rows, first, vector, 10, threshold=1.2).select("id", "file_path", "distance", "score"))


@query
def knn_all_hundredths(spark, sf_dir):
    """The ten nearest files of every file whose id is divisible by 100, against all, in blocks."""
    found = [knn_batch(stage(_vectors(spark, sf_dir, m).select("id", "embedding"), "vectors"), F.col("id") % 100 == 0, 10).withColumn("embedding_model", F.lit(m)) for m in MODELS]
    return reduce(DataFrame.unionByName, found)


# keyword and hybrid search


@query
def bm25_term(spark, sf_dir):
    return search.bm25(_index(spark, sf_dir), TERM, 50)


@query
def bm25_phrase(spark, sf_dir):
    return search.bm25(_index(spark, sf_dir), PHRASE, None)


@query
def bm25_dir(spark, sf_dir):
    return search.bm25(_index(spark, sf_dir), TERM, None, DIRECTORY)


@query
def bm25_title_batch(spark, sf_dir):
    """For every file whose id is divisible by 100, the twenty best files for the first two tokens of its title."""
    line = F.split(F.trim(text.token_line(F.col("title"))), " ")
    phrases = current_files(spark, sf_dir, "title").where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), F.array_join(F.slice(line, 1, 2), " ").alias("phrase")).where(F.contains("phrase", F.lit(" ")))
    return search.bm25_batch(_index(spark, sf_dir), phrases)


@query
def bm25_whole_title_batch(spark, sf_dir):
    """For every file whose id is divisible by 100, the twenty best files for its whole title."""
    phrases = current_files(spark, sf_dir, "title").where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), F.col("title").alias("phrase"))
    return search.bm25_batch(_index(spark, sf_dir), phrases)


@query
def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir, 20)


@query
def hybrid_json(spark, sf_dir):
    """The results of the hybrid search as objects, read back."""
    told = search.as_json(_hybrid(spark, sf_dir, 20))
    return told.select(F.from_json("json", "id LONG, file_path STRING, combined_score DOUBLE, match_type STRING").alias("x")).select("x.*")


@query
def single_scores(spark, sf_dir):
    """Results of the hybrid search by the one score of a result."""
    rows = _hybrid(spark, sf_dir, 50)
    return rows.select("id", "embedding_model", F.round(search.single_score(F.col("semantic_score"), F.col("keyword_score")), 6).alias("score"))


@query
def hybrid_weighted(spark, sf_dir):
    return _hybrid(spark, sf_dir, 50, weights=(0.7, 0.3))


@query
def hybrid_dir(spark, sf_dir):
    return _hybrid(spark, sf_dir, 20, DIRECTORY)


@query
def suggest_prefix(spark, sf_dir):
    return search.suggestions(current_files(spark, sf_dir, "title"), load(spark, sf_dir, "file_keywords"), "re", None)


@query
def keyword_any(spark, sf_dir):
    return search.keyword_search(current_files(spark, sf_dir, "file_path"), _keywords(spark, sf_dir), ["report", "summary", "budget", "invoice"])


@query
def keyword_all(spark, sf_dir):
    return search.keyword_search(current_files(spark, sf_dir, "file_path"), _keywords(spark, sf_dir), ["bibliothèque", "certificat"], match_all=True)


# state


@query
def upsert_latest(spark, sf_dir):
    """Older and newer rows of the file table brought to one per path."""
    rows = load(spark, sf_dir, "files").select("file_path", "id", "status", "file_size", "updated_at")
    cut = F.lit("2023-06-01").cast("timestamp")
    merged = state.upserted(rows.where(F.col("updated_at") < cut), rows.where(F.col("updated_at") >= cut))
    return merged.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query
def replaced_keywords(spark, sf_dir):
    """Keywords of files, with those of files that have a keyword in capitals replaced by these."""
    stored = _keywords(spark, sf_dir)
    incoming = stored.where(F.upper("keyword") == F.col("keyword"))
    return state.replaced_children(stored, incoming).groupBy("file_id").agg(F.count(F.lit(1)).alias("keywords"), F.min("keyword").alias("first_keyword"))


@query
def stale_sweep(spark, sf_dir):
    return state.stale(current_files(spark, sf_dir, "file_path"), F.lit(SINCE).cast("timestamp"), DIRECTORY).select("id", "file_path")


@query
def unseen_files(spark, sf_dir):
    """Stored files that no event names."""
    seen = load(spark, sf_dir, "fs_events").select(F.col("src_path").alias("file_path"))
    return state.unseen(current_files(spark, sf_dir, "file_path"), seen).select("id", "file_path")


@query
def scan_decisions(spark, sf_dir):
    """What a scan does with each file, its newest row against its oldest."""
    rows = load(spark, sf_dir, "files").select("id", "file_path", "extension", "modified", "content_hash", "status", "updated_at")
    oldest = rows.groupBy("id").agg(F.min_by(F.struct("status", "modified", "content_hash"), "updated_at").alias("x")).select("id", "x.*")
    return state.decisions(newest(rows, "id", "updated_at"), oldest)


@query
def pipeline_counters(spark, sf_dir):
    """How many files a scan processes, skips and leaves."""
    return state.counted(scan_decisions(spark, sf_dir))


@query
def snapshot_changes(spark, sf_dir):
    """What is created, modified, deleted and moved between the files as they were at first and the current ones that an event names."""
    rows = load(spark, sf_dir, "files").select("id", "file_path", "content_hash", "modified", "updated_at")
    seen = load(spark, sf_dir, "fs_events").select(F.coalesce("dest_path", "src_path").alias("file_path")).distinct()
    first = rows.groupBy("id").agg(F.min_by(F.struct("file_path", "content_hash", "modified"), "updated_at").alias("x")).select("x.*")
    shown = newest(rows, "id", "updated_at").join(seen, "file_path", "left_semi").select("file_path", "content_hash", "modified")
    moved = shown.withColumn("file_path", F.when(F.col("file_path").endswith(".pdf"), F.concat("file_path", F.lit(".old"))).otherwise(F.col("file_path")))
    return state.snapshot_changes(first, moved)


@query
def touched_files(spark, sf_dir):
    """Days of the last update, after all files that an event names are touched."""
    seen = load(spark, sf_dir, "fs_events").select(F.col("src_path").alias("file_path"))
    rows = state.touched(current_files(spark, sf_dir, "file_path"), seen, F.lit("2030-01-01").cast("timestamp"))
    return rows.groupBy(F.date_format("updated_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("files"))


@query
def cascade_delete(spark, sf_dir):
    """Keywords of the files that are left after all deletions."""
    gone = events.folded(load(spark, sf_dir, "fs_events")).where("action = 'delete'").select(F.col("path").alias("file_path"))
    left, _ = state.deleted(current_files(spark, sf_dir, "file_path"), gone)
    return state.live_children(_keywords(spark, sf_dir), left).groupBy("file_id").agg(F.count(F.lit(1)).alias("keywords"))


# watched directories and events


@query
def watch_jobs(spark, sf_dir):
    rows = watch.jobs(load(spark, sf_dir, "watched_directories"))
    return rows.select("id", "path", "recursive", "file_pattern", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query
def watch_sizes(spark, sf_dir):
    return watch.watch_sizes(current_files(spark, sf_dir, "file_path", "file_size"), watch.jobs(load(spark, sf_dir, "watched_directories")))


@query
def watch_overlaps(spark, sf_dir):
    """Directories of files that are watched already, themselves or from above."""
    asked = current_files(spark, sf_dir, "file_path").select(text.parent(F.col("file_path")).alias("path")).distinct()
    return watch.overlaps(watch.jobs(load(spark, sf_dir, "watched_directories")), asked)


@query
def event_fold(spark, sf_dir):
    return events.folded(load(spark, sf_dir, "fs_events"))


@query
def event_actions(spark, sf_dir):
    """What the events mean for each stored or named file."""
    return events.applied(current_files(spark, sf_dir, "file_path"), load(spark, sf_dir, "fs_events"))


@query
def events_hourly(spark, sf_dir):
    rows = events.hourly(load(spark, sf_dir, "fs_events").distinct())
    return rows.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query
def update_messages(spark, sf_dir):
    """Each event's update in words and as an event of a text stream, and read back."""
    rows = events.clean_events(load(spark, sf_dir, "fs_events"))
    moved = F.col("kind") == "moved"
    rows = rows.select("seq", F.concat(F.lit("file_"), F.col("kind")).alias("code"), F.when(~moved, F.col("src_path")).alias("p"), F.when(moved, F.col("src_path")).alias("s"), F.when(moved, F.col("dest_path")).alias("d"))
    sent = updates.update_rows(rows, F.col("code"), path="p", src_path="s", dest_path="d")
    whole = F.to_json(F.struct("opcode", F.from_json("data", "map<string,string>").alias("data")))
    back = sent.select("seq", "opcode", updates.message(F.col("opcode"), F.col("data")).alias("message"), updates.parsed_event(updates.event_text(F.lit("update"), whole, F.col("seq"))).alias("x"))
    return back.select("seq", "message", F.col("x.opcode").alias("opcode"), updates.message(F.col("x.opcode"), F.col("x.data")).alias("again"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in ORACLES.items() if name in QUERIES}
