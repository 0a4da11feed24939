"""Views and statistics of the file tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliodex.functions.text import extension, file_name, is_supported, long_enough, media_type, token_estimate
from foliodex.operators.search import with_keywords


def responses(files: DataFrame) -> DataFrame:
    """The columns a client sees of a file."""
    return files.select("id", "filename", "extension", "file_path", "created", "modified", "title", "summary")


def kinds(files: DataFrame) -> DataFrame:
    """Name, extension, kind of media and readability, from the path alone."""
    suffix = extension(F.col("file_path"))
    return files.select("id", file_name(F.col("file_path")).alias("name"), suffix.alias("suffix"), media_type(suffix).alias("media"), is_supported(suffix).alias("supported"))


def files_with_keywords(files: DataFrame, keywords: DataFrame) -> DataFrame:
    return with_keywords(files.select("id", "file_path", "title", "status"), keywords, ", ")


def files_searchable(files: DataFrame, keywords: DataFrame) -> DataFrame:
    return with_keywords(files.select("id", "file_path", "title", "summary"), keywords, " ")


def processing_summary(files: DataFrame) -> DataFrame:
    """Files, mean and total size by status."""
    by = files.where("status is not null").groupBy("status")
    return by.agg(F.count(F.lit(1)).alias("files"), F.round(F.avg("file_size"), 4).alias("mean_size"), F.sum("file_size").alias("total_size"))


def recent_activity(files: DataFrame, limit: int = 100) -> DataFrame:
    """The files created last, newest first; ties by id."""
    return files.orderBy(F.desc("created_at"), "id").limit(limit).select("id", "filename", "status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


def file_stats(files: DataFrame) -> DataFrame:
    """One row: files, total size, last update."""
    return files.agg(F.count(F.lit(1)).alias("total_files"), F.sum("file_size").alias("total_size"), F.date_format(F.max("updated_at"), "yyyy-MM-dd HH:mm:ss").alias("last_indexed"))


def extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.lower("extension").alias("suffix")).agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("total_size"))


def extraction_counters(contents: DataFrame) -> DataFrame:
    """Extractions by method, and how many gave more than ten characters."""
    ok = long_enough(F.col("content"))
    return contents.groupBy("extraction_method").agg(F.count(F.lit(1)).alias("extractions"), F.count_if(ok).alias("successes"))


def token_statistics(contents: DataFrame) -> DataFrame:
    """Estimated tokens by extraction method: sum, whole mean, most."""
    tokens = token_estimate(F.coalesce(F.col("content"), F.lit("")))
    by = contents.groupBy("extraction_method")
    return by.agg(F.sum(tokens).cast("long").alias("tokens"), F.floor(F.sum(tokens) / F.count(F.lit(1))).cast("long").alias("mean_tokens"), F.max(tokens).cast("long").alias("most_tokens"))


def session_stats(sessions: DataFrame) -> DataFrame:
    """Sessions by status; rows sent twice count once."""
    return (
        sessions.distinct()
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("sessions"), *(F.sum(c).alias(c) for c in ("total_files", "processed_files", "failed_files", "skipped_files")), F.round(F.avg("processing_time_seconds"), 6).alias("mean_seconds"))
    )


def page(files: DataFrame, number: int = 1, per_page: int = 50, suffix: str | None = None) -> DataFrame:
    """A page of files by id, of one extension or all; pages count from 1."""
    rows = responses(files)
    if suffix:
        rows = rows.where(F.lower("extension") == suffix.lower())
    return rows.orderBy("id").offset((number - 1) * per_page).limit(per_page)


def too_large(files: DataFrame, most: int) -> DataFrame:
    """Files of more than so many bytes, with that error."""
    return files.where(F.col("file_size") > most).withColumn("error", F.lit("too large"))


def hash_groups(contents: DataFrame, least: int = 2) -> DataFrame:
    """Hashes of contents, computed anew, that several files share."""
    hashed = contents.where("content is not null").select(F.sha2("content", 256).alias("sha256"), "file_id")
    return hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("files"), F.min("file_id").alias("first_file")).where(F.col("files") >= least)


def checked(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """``df``, failing on a value that is not allowed; null is."""
    good: Column = F.col(column).isNull() | F.col(column).isin(allowed)
    return df.withColumn(column, F.when(good, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} is "), F.col(column)))))
