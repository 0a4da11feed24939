"""A file index kept in a folder: index directories, follow events, watch, search."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from foliodex.functions import text, vectors
from foliodex.operators import models, search, state, views, watch
from foliodex.session import stage, staging
from foliodex.snapshots import Snapshots
from foliodex.sources import scan
from foliodex.sources.config import Settings
from foliodex.streaming import events, updates
from foliodex.tables import EMBEDDINGS, FILES, KEYWORDS, WATCHED, newest

_TABLES = {"files": FILES, "file_keywords": KEYWORDS, "file_embeddings": EMBEDDINGS, "watched_directories": WATCHED}
_KEYS = {"files": "id", "file_keywords": "file_id", "file_embeddings": "file_id", "watched_directories": "id"}
_OF_FILES = ("files", "file_keywords", "file_embeddings")
STATUSES = ["DISCOVERED", "PARSED", "SUMMARIZED", "COMPLETE", "FAILED"]
UPDATE = "opcode string, data string, at timestamp"


class FileIndex:
    """Tables of files, keywords, vectors and watched directories below ``root``.

    A change writes only the buckets of rows it touches, and all tables change together. Each change also appends update rows
    (opcode, data, at), which any number of subscribers can read as a stream. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, providers: Sequence | None = None, summarisers: Sequence | None = None) -> None:
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings()
        self.dims = self.settings.embedding_dimensions
        self.providers = providers or [partial(models.hashed_embedding, self.dims)]
        self.summarisers = summarisers or [models.extractive_summariser]
        self.model = f"hashed-{self.dims}"
        self.tables = Snapshots(spark, self.root, _TABLES, _KEYS)
        self.following: dict[str, StreamingQuery] = {}

    def table(self, name: str) -> DataFrame:
        """A table as of the last change; empty before the first."""
        return self.tables.table(name)

    # updates

    def _tell(self, rows: DataFrame) -> None:
        """Append updates (opcode, data)."""
        rows.select("opcode", "data", F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.root}/updates")

    def _say(self, opcode: str, **data: str) -> None:
        row = self.spark.createDataFrame([(opcode, *data.values())], ", ".join(["code string", *(f"{k} string" for k in data)]))
        self._tell(updates.update_rows(row, F.col("code"), **{k: k for k in data}) if data else row.select(F.col("code").alias("opcode"), F.lit("{}").alias("data")))

    def updates(self) -> DataFrame:
        """All updates so far, oldest first."""
        return self.spark.read.schema(UPDATE).parquet(f"{self.root}/updates").orderBy("at") if scan.exists(self.spark, f"{self.root}/updates") else self.spark.createDataFrame([], UPDATE)

    def update_stream(self) -> DataFrame:
        """Updates as a stream; each query started on it is a subscriber of its own."""
        if not scan.exists(self.spark, f"{self.root}/updates"):
            self.spark.createDataFrame([], UPDATE).write.mode("append").parquet(f"{self.root}/updates")
        return self.spark.readStream.schema(UPDATE).parquet(f"{self.root}/updates")

    # changes

    def process_directory(self, directory: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
        """Index what is new or changed below a directory, and drop stored files that are gone from it; (file_path, decision) of all found.

        With ``pattern``, only files of such names are indexed; stored files of other names stay as long as they are on disk. Unreadable and
        too short files are kept as failed with the reason. Of a directory that is not there nothing is dropped: it may only be out of reach.
        """
        directory = directory.rstrip("/") or "/"
        stored = self.table("files")
        there = scan.scan(self.spark, directory)
        found = there.where(_matches(F.col("filename"), pattern)) if pattern else there
        if not recursive:
            found = found.where(text.parent(F.col("file_path")) == directory)
        rows = found.select(F.xxhash64("file_path").alias("id"), "file_path", "filename", "extension", "modified", F.lit(None).cast("string").alias("content_hash"))
        saved = stored.select(F.xxhash64("file_path").alias("id"), "status", "modified", F.lit("").alias("content_hash"))
        decided = stage(state.decisions(rows, saved, self.settings.retry_failed), "decisions")
        with staging(self.spark):
            if not scan.exists(self.spark, directory):
                self._say("error", message=f"{directory} is not there")
                return decided.select("file_path", "decision")
            self._say("directory_processing_started", path=directory)
            gone = state.unseen(stored, there, directory)
            self._change(decided.where("decision = 'process'").select("file_path"), gone.select("file_path"), "left_directory")
            skipped = decided.where("decision <> 'process'").select(text.file_name(F.col("file_path")).alias("filename"), F.col("decision").alias("reason"))
            self._tell(updates.update_rows(skipped, F.lit("file_skipped"), filename="filename", reason="reason"))
            self._say("directory_processing_completed", path=directory)
        return decided.select("file_path", "decision")

    def process_file(self, path: str) -> None:
        """Index one file anew, whatever is known of it; drop it if it is gone."""
        with staging(self.spark):
            self._change(self.spark.createDataFrame([(path,)], "file_path string"), None, "file_deleted")

    def _change(self, paths: DataFrame, gone: DataFrame | None, why: str) -> None:
        """Read, describe and embed the files at ``paths``, and drop those that are gone, with keywords and vectors."""
        now = F.current_timestamp()
        stored = self.table("files")
        body, ok = F.col("text"), F.col("text").isNotNull()
        read = scan.read_files(paths.distinct().repartition("file_path"))
        named = read.withColumns({"filename": text.file_name(F.col("file_path")), "extension": text.extension(F.col("file_path"))})
        done = stored.where("status = 'COMPLETE' and content_hash is not null").select("file_path", F.col("content_hash").alias("old_hash"))
        taken = scan.extracted(named.where("found"), scan.by_strategy(self.settings.extraction_strategy), least=10)
        missing = named.where("not found").select("file_path")
        files = stage(taken.join(done, "file_path", "left").withColumn("same", ok & F.sha2(body, 256).eqNullSafe(F.col("old_hash"))), "read")
        lost = missing.select("file_path") if gone is None else missing.unionByName(gone.select("file_path"))
        lost = stage(stored.select("id", "file_path").join(lost.distinct(), "file_path", "left_semi"), "lost")
        fresh = files.where("not same").withColumn("id", F.xxhash64("file_path"))
        summed = stage(models.summarised(fresh.where(ok), "id", "text", self.summarisers, self.settings.chunk_tokens, self.settings.chunk_overlap).withColumnRenamed("error", "not_summed"), "summed")
        good = ok & F.col("not_summed").isNull()
        described = stage(
            fresh.join(summed, "id", "left")
            .withColumn("content_hash", F.when(ok, F.sha2(body, 256)))
            .withColumn("content_type", text.mime_type(F.col("extension")))
            .withColumn("status", F.when(good, "COMPLETE").otherwise("FAILED"))
            .withColumn("processing_error", F.coalesce("error", "not_summed"))
            .withColumn("parsed_at", F.when(ok, now))
            .withColumns({c: F.when(good, now) for c in ("summarized_at", "embedded_at")})
            .withColumns({c: now for c in ("created_at", "updated_at")}),
            "described",
        )
        new_words = described.where("status = 'COMPLETE'").select(F.col("id").alias("file_id"), F.explode(F.array_distinct("keywords")).alias("keyword"))
        fed = described.where("status = 'COMPLETE'").select("id", text.embedding_text(F.col("title"), F.col("summary"), F.col("keywords")).alias("t"))
        embedded = models.embedded(fed, "t", self.providers, self.dims).where("embedding is not null")
        new_vectors = embedded.select(F.col("id").alias("file_id"), F.lit(self.model).alias("embedding_model"), F.size("embedding").alias("embedding_dimensions"), "embedding")
        # the same content under a new time keeps its description
        later = files.where("same").select("file_path", F.col("modified").alias("new_modified"))
        touched = self.tables.touched(described.select("id").unionByName(lost.select("id")).unionByName(later.select(F.xxhash64("file_path").alias("id"))))
        if not touched:
            return
        old = self.tables.table("files", touched).join(later, "file_path", "left").withColumn("modified", F.coalesce("new_modified", "modified")).select(*FILES.fieldNames())
        incoming = described.select(*(F.col(f.name) if f.name in described.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in FILES))
        was = stored.select("file_path", F.col("created_at").alias("was_at"))
        incoming = incoming.join(was, "file_path", "left").withColumn("created_at", F.coalesce("was_at", "created_at")).select(*FILES.fieldNames())
        kept = stage(state.upserted(old, incoming).join(lost.select("file_path"), "file_path", "left_anti").select(*FILES.fieldNames()), "files")
        changes = {"files": (views.checked(kept, "status", STATUSES), touched)}
        for name, rows in (("file_keywords", new_words), ("file_embeddings", new_vectors)):
            rest = self.tables.table(name, touched).join(described.select(F.col("id").alias("file_id")), "file_id", "left_anti")
            changes[name] = (state.live_children(rest.unionByName(rows), kept), touched)
        self.tables.commit(changes)
        told = described.select("filename", F.col("processing_error").alias("problem"), "status")
        stages = F.when(F.col("status") == "COMPLETE", F.array(*(F.lit(f"file_{x}") for x in ("parsed", "summarized", "embedded", "complete")))).otherwise(F.array(F.lit("file_failed")))
        self._tell(updates.update_rows(told.withColumn("code", F.explode(stages)), F.col("code"), filename="filename", error="problem"))
        self._tell(updates.update_rows(lost, F.lit("file_deleted"), path="file_path"))

    def apply_events(self, batch: DataFrame) -> None:
        """Follow a batch of file-system events, raw or folded (path, action): deleted paths go, created, changed and moved-to ones are indexed.

        Where directories are watched, only what an active one holds and its pattern names is indexed; without any, all is. Files of
        other kinds than can be read are left alone. A path that is gone again goes.
        """
        last = batch if "action" in batch.columns else events.folded(batch)
        with staging(self.spark):
            last = stage(last.select(F.col("path").alias("file_path"), "action"), "actions")
            wanted = last.where("action = 'upsert'").where(text.is_supported(text.extension(F.col("file_path"))))
            watched = newest(self.table("watched_directories"), "id", "updated_at").where("is_active")
            if not watched.isEmpty():
                held = watch.directory_of_files(wanted.select(F.xxhash64("file_path").alias("id"), "file_path"), watched)
                held = held.join(watched.select(F.col("id").alias("watch_id"), "file_pattern"), "watch_id")
                named = wanted.withColumn("id", F.xxhash64("file_path")).join(held, "id")
                patterns = [r["file_pattern"] for r in watched.select("file_pattern").distinct().collect()]  # as many as there are watched directories
                fits = F.col("file_pattern").isNull()
                for p in patterns:
                    if p is not None:
                        fits |= (F.col("file_pattern") == p) & _matches(text.file_name(F.col("file_path")), p)
                wanted = named.where(fits)
            self._change(wanted.select("file_path"), last.where("action = 'delete'").select("file_path"), "file_deleted")

    def delete_file(self, path: str) -> None:
        """Drop a file with its keywords and vector."""
        with staging(self.spark):
            self._drop(self.table("files").where(F.col("file_path") == path))

    def _drop(self, gone: DataFrame) -> None:
        gone = stage(gone.select("id", "file_path"), "gone")
        touched = self.tables.touched(gone.select("id"))
        if touched:
            kept = stage(self.tables.table("files", touched).join(gone.select("id"), "id", "left_anti").select(*FILES.fieldNames()), "kept")
            children = {name: (state.live_children(self.tables.table(name, touched), kept), touched) for name in _OF_FILES[1:]}
            self.tables.commit({"files": (kept, touched), **children})
            self._tell(updates.update_rows(gone, F.lit("file_deleted"), path="file_path"))

    # watched directories

    def start_watching(self, path: str, recursive: bool = True, file_pattern: str | None = None) -> bool:
        """Keep a directory among the watched ones and index what is in it; False if it is watched already, itself or from above.

        Events that come later are followed through ``follow`` or ``apply_events``.
        """
        path = path.rstrip("/")
        known = self.table("watched_directories")
        asked = self.spark.createDataFrame([(path,)], "path string")
        if not watch.overlaps(newest(known, "id", "updated_at").where("is_active"), asked).isEmpty():
            return False
        kind = T.StructType([f for f in WATCHED if f.name in ("path", "is_active", "recursive", "file_pattern")])
        row = self.spark.createDataFrame([(path, True, recursive, file_pattern)], kind)
        self._say("watch_added", path=path)
        now = F.current_timestamp()
        with staging(self.spark):
            rows = stage(known.unionByName(row.select(F.xxhash64("path").alias("id"), "*", now.alias("last_scan"), now.alias("created_at"), now.alias("updated_at"))), "watched")
            self.tables.commit({"watched_directories": (rows, None)})
        self._say("watch_started", path=path)
        if scan.exists(self.spark, path):
            self.process_directory(path, file_pattern, recursive)
        return True

    def follow(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Apply a stream of file-system events batch by batch, until ``stop``; started again with its checkpoint it goes on where it was.

        Applying a batch twice, as after a failure, changes nothing.
        """
        found = events.watch(stream, lambda batch, _: self.apply_events(batch), checkpoint, once)
        self.following[checkpoint] = found
        return found

    def restore(self, streams: dict[str, DataFrame] | None = None) -> list[str]:
        """After a restart: index anew what the active watched directories hold, as far as these are there, and follow the ``streams`` by their checkpoints; the paths."""
        done = []
        for r in self.watched().select("path", "recursive", "file_pattern").collect():
            if scan.exists(self.spark, r["path"]):
                self.process_directory(r["path"], r["file_pattern"], r["recursive"])
                done.append(r["path"])
        for checkpoint, stream in (streams or {}).items():
            self.follow(stream, checkpoint)
        return done

    def stop(self) -> None:
        """Follow no stream any longer; watched directories stay."""
        for query in self.following.values():
            query.stop()
        self.following.clear()
        self._say("shutting_down")

    def watched(self) -> DataFrame:
        return watch.jobs(self.table("watched_directories"))

    def stop_watching(self, path: str, drop_files: bool = False) -> None:
        """Watch a directory no longer; with ``drop_files``, files that no other directory holds go too."""
        known = newest(self.table("watched_directories"), "id", "updated_at")
        row = known.where(F.col("path") == path.rstrip("/")).select("id").first()
        if row is None:
            return
        with staging(self.spark):
            left, files = watch.without_directory(known, self.table("files"), row["id"])
            left = stage(left, "watched")
            if drop_files:
                self._drop(self.table("files").join(files.select("id"), "id", "left_anti"))
            self.tables.commit({"watched_directories": (left, None)})
        self._say("watch_removed", path=path)

    # queries

    def text_index(self) -> DataFrame:
        return search.text_index(self.table("files"), self.table("file_keywords"))

    def vectors(self) -> DataFrame:
        files = self.table("files").select("id", "file_path")
        rows = self.table("file_embeddings").where((F.col("embedding_model") == self.model) & vectors.usable(F.col("embedding")))
        return files.join(rows, files["id"] == rows["file_id"]).select("id", "file_path", "embedding")

    def embed_query(self, query: str) -> list[float]:
        row = models.embedded(self.spark.createDataFrame([(query,)], "q string"), "q", self.providers, self.dims).first()
        return row["embedding"] or [0.0] * self.dims

    def search(self, query: str, limit: int | None = None, mode: str = "hybrid", directory: str | None = None, weights: tuple[float, float] | None = None) -> DataFrame:
        """Files for a query; hybrid by default, or ``semantic`` or ``keyword``."""
        limit = limit or self.settings.search_limit
        if mode == "hybrid":
            weights = weights or (self.settings.semantic_weight, self.settings.keyword_weight)
            return search.hybrid(self.text_index(), self.vectors(), query, self.embed_query(query), limit, self.settings.semantic_threshold, directory, weights)
        return search.search(self.text_index(), self.vectors(), query, self.embed_query(query), limit, mode, directory)

    def similar(self, file_id: int, limit: int = 10, threshold: float = 0.8) -> DataFrame:
        """Files like one file; none if it has no vector."""
        rows = self.vectors()
        own = rows.where(F.col("id") == file_id).select("embedding").first()
        return search.similar_to(rows, file_id, own["embedding"] if own else [0.0], limit, threshold if own else -1.0)

    def suggest(self, prefix: str, limit: int = 5) -> DataFrame:
        return search.suggestions(self.table("files"), self.table("file_keywords"), prefix, limit)

    def by_keywords(self, keywords: list[str], match_all: bool = False, limit: int | None = None) -> DataFrame:
        return search.keyword_search(self.table("files"), self.table("file_keywords"), keywords, match_all, limit)

    def page(self, page: int = 1, per_page: int = 50, extension: str | None = None) -> DataFrame:
        """A page of files by id, of one extension or all."""
        return views.page(self.table("files"), page, per_page, extension)

    def find(self, condition: Column) -> DataFrame:
        """Files that meet a condition, as by path, id or content hash."""
        return self.table("files").where(condition)

    def stats(self) -> DataFrame:
        return views.file_stats(self.table("files"))

    def register_views(self) -> None:
        """The views files_searchable, files_with_keywords, processing_summary and recent_activity for SQL."""
        files, keywords = self.table("files"), self.table("file_keywords")
        views.files_searchable(files, keywords).createOrReplaceTempView("files_searchable")
        views.files_with_keywords(files, keywords).createOrReplaceTempView("files_with_keywords")
        views.processing_summary(files).createOrReplaceTempView("processing_summary")
        views.recent_activity(files).createOrReplaceTempView("recent_activity")

    def active_streams(self) -> int:
        return len(self.spark.streams.active)


def _matches(name: Column, pattern: str) -> Column:
    """Whether a file name fits a pattern with ``*``, ``?`` and ``[...]``."""
    return name.rlike(re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"(?s)^(?:\1)$", fnmatch.translate(pattern)))
