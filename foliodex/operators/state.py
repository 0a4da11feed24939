"""Changes of the file tables: upsert, deletion, sweeps, and what a scan must do anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliodex.functions.text import is_supported, under
from foliodex.tables import newest


def upserted(stored: DataFrame, incoming: DataFrame, key: str = "file_path", version: str = "updated_at") -> DataFrame:
    """Both tables' rows, of each ``key`` that with the greatest ``version``; the key is unique afterwards."""
    return newest(stored.unionByName(incoming), key, version)


def replaced_children(stored: DataFrame, incoming: DataFrame, key: str = "file_id") -> DataFrame:
    """Child rows (keywords, vectors) with those of every key in ``incoming`` replaced by its rows, repeated rows once."""
    kept = stored.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(incoming).distinct()


def deleted(stored: DataFrame, keys: DataFrame, key: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """What is left after the rows with ``keys`` are gone, and those rows."""
    gone = keys.select(key).distinct()
    return stored.join(gone, key, "left_anti"), stored.join(gone, key, "left_semi")


def stale(files: DataFrame, since: Column, directory: str) -> DataFrame:
    """Rows in or below a directory that have not been updated since then."""
    return files.where(under(F.col("file_path"), directory) & (F.col("updated_at") < since))


def unseen(files: DataFrame, seen: DataFrame, directory: str | None = None) -> DataFrame:
    """Stored rows whose path a scan (file_path) has not met, in one directory or everywhere."""
    scope = files.where(under(F.col("file_path"), directory)) if directory else files
    return scope.join(seen.select("file_path").distinct(), "file_path", "left_anti")


def touched(files: DataFrame, paths: DataFrame, now: Column) -> DataFrame:
    """All rows, with ``updated_at`` set to now where the path is among ``paths``."""
    hit = paths.select("file_path", F.lit(True).alias("_hit")).distinct()
    return files.join(hit, "file_path", "left").withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))).drop("_hit")


def live_children(children: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Child rows whose file is still there."""
    return children.join(files.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def decisions(scan: DataFrame, saved: DataFrame, retry_failed: bool = False) -> DataFrame:
    """id, file_path and ``decision`` for each scanned row (id, file_path, extension, modified, content_hash).

    ``unsupported`` by its extension; ``skip`` if it was complete (or failed, unless ``retry_failed``) and its time of
    modification is the same to the second; ``unchanged`` if it was complete with the same content; else ``process``.
    A null hash is equal to a null hash.
    """
    old = saved.select("id", F.col("status").alias("old_status"), F.col("modified").alias("old_modified"), F.col("content_hash").alias("old_hash"))
    done = ["COMPLETE"] if retry_failed else ["COMPLETE", "FAILED"]
    same_time = F.date_trunc("second", "modified") == F.date_trunc("second", "old_modified")
    decision = (
        F.when(~is_supported(F.col("extension")), "unsupported")
        .when(F.col("old_status").isin(done) & same_time, "skip")
        .when((F.col("old_status") == "COMPLETE") & F.col("content_hash").eqNullSafe(F.col("old_hash")), "unchanged")
        .otherwise("process")
    )
    return scan.join(old, "id", "left").select("id", "file_path", decision.alias("decision"))


def counted(decided: DataFrame) -> DataFrame:
    """(decision, files): the counters of a run."""
    return decided.groupBy("decision").agg(F.count(F.lit(1)).alias("files"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_path, ``change`` (created, modified, deleted, moved) and ``moved_from`` between two scans (file_path, content_hash, modified).

    A path that is gone and one that is new with the same content hash are a move, if the hash was at just one path before and
    is at just one new path.
    """
    a = before.select("file_path", F.col("content_hash").alias("h0"), F.col("modified").alias("m0"), F.lit(True).alias("was"))
    b = after.select("file_path", F.col("content_hash").alias("h1"), F.col("modified").alias("m1"), F.lit(True).alias("is"))
    both = a.join(b, "file_path", "full_outer")
    gone = both.where("`is` is null and h0 is not null").groupBy("h0").agg(F.min("file_path").alias("old_path"), F.count(F.lit(1)).alias("n")).where("n = 1")
    new = both.where("was is null and h1 is not null").groupBy("h1").agg(F.min("file_path").alias("new_path"), F.count(F.lit(1)).alias("n")).where("n = 1")
    moves = gone.join(new, gone["h0"] == new["h1"]).select("old_path", "new_path")
    kept = both.withColumn(
        "change", F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "deleted").when(~F.col("h0").eqNullSafe(F.col("h1")) | ~F.col("m0").eqNullSafe(F.col("m1")), "modified")
    ).where("change is not null")
    to = moves.select(F.col("new_path").alias("file_path"), F.col("old_path").alias("moved_from"))
    named = kept.join(to, "file_path", "left").join(moves.select(F.col("old_path").alias("file_path")), "file_path", "left_anti")
    return named.select("file_path", F.when(F.col("moved_from").isNotNull(), "moved").otherwise(F.col("change")).alias("change"), "moved_from")
