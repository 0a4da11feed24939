"""File-system events folded into the state of the file tables, in batches and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KINDS = ("created", "modified", "deleted", "moved")


def clean_events(events: DataFrame, once: bool = True) -> DataFrame:
    """Events of files, kinds in lower case; rows of directories, unknown kinds, and without number or path left out; rows sent twice come once unless ``once`` is false."""
    rows = events.withColumn("kind", F.lower(F.trim("kind"))).where(F.col("kind").isin(list(KINDS)) & F.col("src_path").isNotNull() & F.col("seq").isNotNull() & ~F.coalesce("is_dir", F.lit(False)))
    rows = rows.select("seq", "ts", "kind", "src_path", "dest_path")
    return rows.dropDuplicates(["seq", "kind", "src_path", "dest_path"]) if once else rows


def path_events(events: DataFrame) -> DataFrame:
    """(path, seq, step, action) of clean events: a move deletes its source, then makes its destination; others are one action."""
    moved = (F.col("kind") == "moved") & F.col("dest_path").isNotNull()
    one = F.struct(F.col("src_path").alias("path"), F.lit(0).alias("step"), F.when(F.col("kind").isin("deleted", "moved"), "delete").otherwise("upsert").alias("action"))
    two = F.struct(F.col("dest_path").alias("path"), F.lit(1).alias("step"), F.lit("upsert").alias("action"))
    return events.select("seq", F.explode(F.when(moved, F.array(one, two)).otherwise(F.array(one))).alias("x")).select("x.path", "seq", "x.step", "x.action")


def folded(events: DataFrame) -> DataFrame:
    """(path, action, seq): the last action on each path, in the order of arrival.

    ``max_by`` keeps one row per path and task before the shuffle, so a path with very many events is no hot spot; rows sent twice make no difference.
    """
    steps = path_events(clean_events(events, once=False))
    return steps.groupBy("path").agg(F.max_by("action", F.struct("seq", "step")).alias("action"), F.max("seq").alias("seq"))


def applied(files: DataFrame, events: DataFrame) -> DataFrame:
    """(file_path, known, action) after the events: ``kept``, ``deleted``, or ``process`` where a file is new or changed; ``known`` if a row of it was stored."""
    last = folded(events).select(F.col("path").alias("file_path"), "action")
    stored = files.select("file_path", F.lit(True).alias("known")).distinct()
    both = stored.join(last, "file_path", "full_outer")
    action = F.when(F.col("action").isNull(), "kept").when(F.col("action") == "delete", "deleted").otherwise("process")
    return both.select("file_path", F.coalesce("known", F.lit(False)).alias("known"), action.alias("action"))


def watch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Fold each micro-batch of an event stream and hand the last actions (path, action, seq) to ``apply`` with the batch's number.

    ``apply`` may see a batch again after a failure and should act by that number. With ``once``, what is there now is worked off.
    """

    def each(batch: DataFrame, number: int) -> None:
        apply(folded(batch), number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, kind, n): events by hour and kind, of a batch or a stream; a stream waits so long for late rows. Rows without a time do not count."""
    rows = stream.where(F.col("ts").isNotNull()).withColumn("kind", F.lower(F.trim("kind")))
    if stream.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "kind", "n")
