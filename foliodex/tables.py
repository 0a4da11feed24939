"""The file-index tables: schemas, readers, and the current row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in ("file_path", "filename", "extension")),
        T.StructField("file_size", T.LongType()),
        *(T.StructField(c, T.TimestampType()) for c in ("created", "modified", "accessed")),
        *(T.StructField(c, T.StringType()) for c in ("content_type", "content_hash")),
        T.StructField("parsed_at", T.TimestampType()),
        *(T.StructField(c, T.StringType()) for c in ("summary", "title")),
        *(T.StructField(c, T.TimestampType()) for c in ("summarized_at", "embedded_at")),
        *(T.StructField(c, T.StringType()) for c in ("status", "processing_error", "owner", "permissions")),
        *(T.StructField(c, T.TimestampType()) for c in ("created_at", "updated_at")),
    ]
)
KEYWORDS = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("keyword", T.StringType())])
EMBEDDINGS = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("embedding_dimensions", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
WATCHED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("path", T.StringType()),
        *(T.StructField(c, T.BooleanType()) for c in ("is_active", "recursive")),
        T.StructField("file_pattern", T.StringType()),
        *(T.StructField(c, T.TimestampType()) for c in ("last_scan", "created_at", "updated_at")),
    ]
)
EVENTS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("src_path", T.StringType()),
        T.StructField("dest_path", T.StringType()),
    ]
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def newest(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per ``key``: that with the greatest ``version``; of equal versions, the greatest row.

    ``max_by`` aggregates on the map side, so a hot key costs one row per task in the shuffle.
    A null key is a group of its own; a null version loses against any other.
    """
    rest = [c for c in df.columns if c != key]
    order = F.struct(F.col(version).isNotNull(), F.col(version), *(F.col(c) for c in rest if c != version))
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(
        *(F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns)
    )


def current_files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The current row of each file; with ``columns``, only these besides ``id`` and ``updated_at``."""
    df = load(spark, sf_dir, "files")
    if columns:
        df = df.select(*dict.fromkeys(["id", *columns, "updated_at"]))
    return newest(df, "id", "updated_at")


def current_contents(spark: SparkSession, sf_dir: str, condition: Column | None = None) -> DataFrame:
    """``file_id``, ``content``, ``content_hash`` and ``extraction_method`` of the current row of each file in
    ``file_contents``, if it meets ``condition``.

    The current version is found from narrow columns; contents are shuffled only for rows that meet the
    condition, and rows sent twice collapse there. The latest ``parsed_at`` is current, of equal ones the
    greatest hash and method; a null ``parsed_at`` comes before any other.
    """
    base = load(spark, sf_dir, "file_contents")
    version = F.struct("parsed_at", "content_hash", "extraction_method")
    latest = base.groupBy("file_id").agg(F.max(version).alias("_latest"))
    rows = base.withColumn("_version", version)
    if condition is not None:
        rows = rows.where(condition)
    return (
        rows.join(latest, "file_id")
        .where(F.col("_version").eqNullSafe(F.col("_latest")))
        .select("file_id", "content", "content_hash", "extraction_method")
        .dropDuplicates(["file_id"])
    )
