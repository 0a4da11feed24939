"""Watched directories and what lies in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliodex.functions.text import ancestors, parent
from foliodex.tables import newest


def jobs(watched: DataFrame, active_only: bool = True) -> DataFrame:
    """The current row of each watched directory, in order of creation."""
    rows = newest(watched, "id", "updated_at")
    return (rows.where("is_active") if active_only else rows).orderBy("created_at", "id")


def directory_of_files(files: DataFrame, watched: DataFrame) -> DataFrame:
    """(id, watch_id) of each file and each watched directory it lies in; a directory that is not recursive has its own files only.

    A path is spread into its ancestors, as many as it is deep, which meet the directories in an equi-join.
    """
    paths = files.select("id", parent(F.col("file_path")).alias("own"), F.explode(ancestors(F.col("file_path"))).alias("path"))
    rows = paths.join(watched.select(F.col("id").alias("watch_id"), "path", "recursive"), "path")
    return rows.where(F.col("recursive") | (F.col("own") == F.col("path"))).select("id", "watch_id")


def watch_sizes(files: DataFrame, watched: DataFrame) -> DataFrame:
    """Files and bytes in each watched directory; zero in an empty one."""
    inside = directory_of_files(files, watched).join(files.select("id", "file_size"), "id")
    sums = inside.groupBy("watch_id").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))
    return watched.join(sums, watched["id"] == sums["watch_id"], "left").select("id", "path", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def overlaps(watched: DataFrame, asked: DataFrame) -> DataFrame:
    """(path, watch_id, reason) where an asked path is watched already: ``exact``, or ``inside`` a recursive directory."""
    up = asked.select(F.col("path").alias("asked"), F.explode(ancestors(F.col("path"))).alias("path"))
    rows = up.join(watched.select(F.col("id").alias("watch_id"), "path", "recursive"), "path")
    reason = F.when(F.col("asked") == F.col("path"), "exact").when(F.col("recursive"), "inside")
    return rows.select(F.col("asked").alias("path"), "watch_id", reason.alias("reason")).where("reason is not null")


def without_directory(watched: DataFrame, files: DataFrame, watch_id: int) -> tuple[DataFrame, DataFrame]:
    """Watched directories and files after one directory is no longer watched; files that another directory holds stay."""
    left = watched.where(F.col("id") != watch_id)
    held = directory_of_files(files, watched.where(F.col("id") == watch_id)).select("id").distinct()
    elsewhere = directory_of_files(files.join(held, "id", "left_semi"), left).select("id").distinct()
    return left, files.join(held.join(elsewhere, "id", "left_anti"), "id", "left_anti")
