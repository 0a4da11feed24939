"""Directories of files as tables, and text out of files."""

from __future__ import annotations

import html
import os
import re
import struct
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliodex.functions.text import IMAGE, IMAGE_WORDS, extension, file_name
from foliodex.session import stage

#: Bytes above which no file is read.
LARGEST = 50 * 1024 * 1024

Extract = Callable[[str, bytes], str | None]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, on the file system that Spark would read it from."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def scan(spark: SparkSession, root: str, pattern: str | None = None, content: bool = False) -> DataFrame:
    """file_path, filename, extension, file_size, modified of all files below ``root`` or of that one file; with ``content``, their bytes.

    Spark's file listing leaves out names that begin with a dot or an underscore; ``walk`` has these too. A root that does not exist gives no rows. Without ``content`` no file is opened.
    """
    if not exists(spark, root):
        kinds = "file_path string, filename string, extension string, file_size long, modified timestamp" + (", content binary" if content else "")
        return spark.createDataFrame([], kinds)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    path = F.regexp_replace("path", "^file:(//)?", "")
    rows = reader.load(root).select(path.alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return rows.select("file_path", file_name(F.col("file_path")).alias("filename"), extension(F.col("file_path")).alias("extension"), "file_size", "modified", *(["content"] if content else []))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """file_path, filename, extension, file_size, modified of all files below a folder every executor can reach, hidden ones included.

    One step goes down one level, all folders of a level at once; links to folders are not followed, folders that cannot be
    read are left out.
    """
    kind = "path string, folder boolean, file_size long, modified timestamp"

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for folder in rows["path"]:
                try:
                    entries = list(os.scandir(folder))
                except OSError:
                    continue
                for e in entries:
                    folder_ = e.is_dir(follow_symlinks=False)
                    if folder_ or e.is_file():
                        s = e.stat()
                        found.append((e.path, folder_, s.st_size, pd.Timestamp(s.st_mtime_ns, unit="ns", tz="UTC").floor("us")))
            out = pd.DataFrame(found, columns=["path", "folder", "file_size", "modified"])
            yield out.astype({"folder": bool, "file_size": "int64", "modified": "datetime64[ns, UTC]"})

    level = spark.createDataFrame([(os.path.realpath(root),)], "path string")
    everything = None
    while True:
        level = stage(level.select("path").repartition("path").mapInPandas(listed, kind), "walk")
        everything = level if everything is None else everything.unionByName(level)
        level = level.where("folder")
        if level.isEmpty():
            break
    files = everything.where("not folder").withColumnRenamed("path", "file_path")
    return files.select("file_path", file_name(F.col("file_path")).alias("filename"), extension(F.col("file_path")).alias("extension"), "file_size", "modified")


def read_files(paths: DataFrame) -> DataFrame:
    """file_path, found, file_size, created, modified, accessed, content of paths every executor can reach, each read in the task that holds it.

    ``content`` is null of files over ``LARGEST`` bytes, which are not opened; of paths that are gone or no files, ``found`` is false and all else null.
    """
    kind = "file_path string, found boolean, file_size long, created timestamp, modified timestamp, accessed timestamp, content binary"
    columns = ["file_path", "found", "file_size", "created", "modified", "accessed", "content"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 64):  # few at a time: contents may be large
                out = []
                for path in rows["file_path"].iloc[at : at + 64]:
                    local = path.removeprefix("file://")
                    try:
                        s = os.stat(local)
                        data = None
                        if s.st_size <= LARGEST:
                            with open(local, "rb") as f:
                                data = f.read()
                        out.append((path, True, s.st_size, *(pd.Timestamp(t, unit="ns", tz="UTC").floor("us") for t in (s.st_ctime_ns, s.st_mtime_ns, s.st_atime_ns)), data))
                    except OSError:
                        out.append((path, False, None, pd.NaT, pd.NaT, pd.NaT, None))
                found = pd.DataFrame(out, columns=columns).astype({"file_size": "Int64"})
                for c in ("created", "modified", "accessed"):
                    found[c] = pd.to_datetime(found[c], utc=True)
                yield found

    return paths.select("file_path").mapInPandas(read, kind)


def stat_rows(paths: DataFrame) -> DataFrame:
    """file_path (links resolved), created, accessed of paths every executor can reach; null times of paths that are gone."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for p in rows["file_path"]:
                try:
                    s = os.stat(p)
                    found.append((os.path.realpath(p), *(pd.Timestamp(t, unit="ns", tz="UTC").floor("us") for t in (s.st_ctime_ns, s.st_atime_ns))))
                except OSError:
                    found.append((p, pd.NaT, pd.NaT))
            yield pd.DataFrame(found, columns=["file_path", "created", "accessed"])

    return paths.select("file_path").mapInPandas(look, "file_path string, created timestamp, accessed timestamp")


_dropped = re.compile(r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->")
_breaks = re.compile(r"(?i)<(?:br|hr)\b[^>]*>|</?(?:p|div|li|ul|ol|tr|table|h[1-6]|section|article|blockquote|pre)\b[^>]*>")


def html_text(source: str) -> str:
    """The readable text of a page: a line per block, no scripts and styles."""
    text = _breaks.sub("\n", _dropped.sub(" ", source))
    text = html.unescape(re.sub(r"<[^>]+>", "", text))
    lines = (re.sub(r"[ \t\r\f\xa0]+", " ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def plain_extractor(name: str, data: bytes) -> str | None:
    """Text of text-like files; None of others, for the next extractor to try."""
    suffix = os.path.splitext(name)[1].lower()
    if suffix in (".html", ".htm"):
        return html_text(data.decode("utf-8", "replace"))
    if suffix in (".txt", ".md", ".csv", ".json", ".xml", ".log", ".eml", ".py"):
        return data.decode("utf-8", "replace")
    return None


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """Kind, width and height of an image by the first bytes of its file; None of what is no PNG, GIF, BMP or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "PNG", *struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return "GIF", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return "BMP", width, abs(height)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data):
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] in (*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):  # a start of frame
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return "JPEG", width, height
        at += 2 + max(size, 2)
    return None


def image_extractor(name: str, data: bytes) -> str | None:
    """What can be said of an image without a model: its name, size and kind; None of files that are no images by name."""
    if os.path.splitext(name)[1].lower() not in IMAGE:
        return None
    label, of_pixels, of_bytes = IMAGE_WORDS
    found = image_size(data)
    if found is None:
        return label + name
    kind, width, height = found
    return label + name + of_pixels % (width, height, "unknown") + of_bytes % (len(data), kind)


#: Extractors by name, and their order by strategy.
EXTRACTORS: dict[str, Extract] = {"plain": plain_extractor, "image": image_extractor}
STRATEGIES = {"plain_first": ["plain", "image"], "image_first": ["image", "plain"], "plain_only": ["plain"]}


def by_strategy(strategy: str) -> list[tuple[str, Extract]]:
    """The extractors of a strategy, in order."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    return [(name, EXTRACTORS[name]) for name in STRATEGIES[strategy]]


def extracted(files: DataFrame, extractors: Sequence[tuple[str, Extract]] = (("plain", plain_extractor),), least: int = 10) -> DataFrame:
    """``files`` (with filename, file_size and content) with ``text``, ``extraction_method`` and ``error`` instead of the bytes.

    The extractors are tried in order until one gives more than ``least`` characters; a file over ``LARGEST`` bytes, one that
    no extractor reads and one that makes them fail has an error.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for name, size, data in zip(rows["filename"], rows["file_size"], rows["content"]):
                text = method = error = None
                if size > LARGEST:
                    error = "too large"
                elif data is None:
                    error = "cannot be read"
                else:
                    for label, extract in extractors:
                        try:
                            found = extract(name, bytes(data))
                        except Exception as e:
                            error = f"{label}: {e}"
                            continue
                        if found and len(found.strip()) > least:
                            text, method, error = found, label, None
                            break
                    else:
                        error = error or "no text"
                out.append((text, method, error))
            yield rows.drop(columns="content").assign(**pd.DataFrame(out, columns=["text", "extraction_method", "error"], index=rows.index))

    kept = [f for f in files.schema if f.name != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", text string, extraction_method string, error string"
    return files.select(*(f.name for f in kept), "content").mapInPandas(read, schema)


def images(spark: SparkSession, root: str) -> DataFrame:
    """file_path, width, height, channels of the images below ``root`` or of that one; null sizes of what cannot be read."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root).select("image.*")
    known = F.col("width") > 0
    path = F.regexp_replace("origin", "^file:(//)?", "")
    return rows.select(path.alias("file_path"), *(F.when(known, F.col(c)).alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "channels"))))


def attached(content: Column) -> Column:
    """Bytes as base64 text, as models take images."""
    return F.base64(content)
