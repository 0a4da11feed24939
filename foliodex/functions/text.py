"""Column functions on text: tokens, phrases, paths, embedding text, model responses."""

from __future__ import annotations

import mimetypes
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Accented Latin lower-case letters and their bases, from their canonical decompositions."""
    pairs = [(chr(c), d[0]) for c in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)] if chr(c).islower() and (d := unicodedata.normalize("NFD", chr(c))) != chr(c) and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()
SPACE = r" \t\r\n\f"


def fold(text: Column) -> Column:
    """Lower case without diacritics; letters that have no base letter stay."""
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"\p{M}+", "")


def token_line(text: Column) -> Column:
    """The tokens (runs of letters and digits, folded) with one space before, between and after; two spaces if there are none; null gives that too."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def n_tokens(line: Column) -> Column:
    """The number of tokens of a ``token_line``."""
    return F.when(line == "  ", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) - 1)


def phrase_tokens(phrase: str) -> list[str]:
    """The tokens of a query phrase, as ``token_line`` makes them."""
    kept = "".join(c for c in unicodedata.normalize("NFD", phrase.lower()) if not unicodedata.combining(c))
    return "".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFC", kept)).split()


def phrase_count(line: Column, phrase: str) -> Column:
    """How often the phrase stands in a ``token_line``; overlapping hits count, a phrase without tokens never does."""
    tokens = phrase_tokens(phrase)
    if not tokens:
        return F.lit(0)
    # tokens hold letters and digits only, so none needs quoting; the look-ahead keeps overlaps
    return F.regexp_count(line, F.lit(f"(?= {' '.join(tokens)} )"))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def long_enough(text: Column, least: int = 10) -> Column:
    """Whether more than ``least`` characters are left without white space at the ends; false of null."""
    return F.coalesce(F.char_length(strip(text)) > least, F.lit(False))


def token_estimate(text: Column) -> Column:
    """Roughly four characters a token."""
    return F.floor(F.char_length(text) / 4)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def extension(path: Column) -> Column:
    """The last suffix with its dot, or nothing; a leading dot begins no suffix."""
    return F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """The path itself and all directories it lies in, as an array."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))


def under(path: Column, directory: str) -> Column:
    """Whether a path is the directory or lies in it."""
    directory = directory.rstrip("/")
    return (path == directory) | path.startswith(directory + "/")


#: File name extensions of the kinds of media, and all that can be read.
AUDIO = [".mp3", ".wav", ".aac", ".m4a", ".flac", ".ogg"]
VIDEO = [".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".webm"]
IMAGE = [".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".heic", ".gif", ".webp"]
SUPPORTED = [
    *(".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".heic", ".gif", ".webp"),
    *(".mp3", ".wav", ".aac", ".mp4", ".avi", ".mov", ".mkv", ".html", ".htm", ".txt", ".csv", ".json", ".xml", ".md", ".zip", ".epub"),
]


def media_type(suffix: Column) -> Column:
    """audio, video, image or null, by extension."""
    s = F.lower(suffix)
    return F.when(s.isin(AUDIO), "audio").when(s.isin(VIDEO), "video").when(s.isin(IMAGE), "image")


#: Kinds of content that have no entry in Python's table.
OTHER_TYPES = {".md": "text/markdown", ".heic": "image/heic", ".webp": "image/webp", ".epub": "application/epub+zip", ".flac": "audio/flac", ".ogg": "audio/ogg", ".m4a": "audio/mp4"}


def mime_types() -> dict[str, str]:
    """The kind of content of each extension that can be read or is of a known medium."""
    return {e: OTHER_TYPES.get(e) or mimetypes.types_map[e] for e in sorted({*SUPPORTED, *AUDIO, *VIDEO, *IMAGE}) if e in OTHER_TYPES or e in mimetypes.types_map}


def mime_type(suffix: Column) -> Column:
    """The kind of content by extension, whatever its case; null of others."""
    table = F.create_map(*(F.lit(x) for pair in mime_types().items() for x in pair))
    return F.try_element_at(table, F.lower(suffix))


def split_keywords(listed: Column) -> Column:
    """Keywords written in one string, parted by commas or two bars, trimmed and without blanks; null of null."""
    return F.filter(F.transform(F.split(listed, r",|\|\|"), strip), lambda k: k != "")


def is_supported(suffix: Column) -> Column:
    return F.coalesce(F.lower(suffix).isin(SUPPORTED), F.lit(False))


def embedding_text(title: Column, summary: Column, keywords: Column) -> Column:
    """Title, summary and keywords in one line; empty parts are left out."""
    part = lambda label, c: F.when(c != "", F.concat(F.lit(label + ": "), c))
    return F.concat_ws(" ", part("Title", title), part("Summary", summary), part("Keywords", F.array_join(keywords, ", ")))


def unfenced(response: Column) -> Column:
    """What stands between the first two code fences of a model's response, without a language name; the response itself if it has no two."""
    parts = F.split(response, "`{3}")
    inside = F.regexp_replace(F.get(parts, F.lit(1)), "^[a-z]+(?=[^a-z])", "")
    return F.when((F.size(parts) > 2) & (strip(inside) != ""), inside).otherwise(response)


NOT_READ, NO_SUMMARY = "cannot be read as JSON", "no summary"


def parsed_response(response: Column) -> Column:
    """title, summary, keywords and error of a model's JSON response.

    Parts are trimmed, blank keywords dropped, keywords that are no list are none; without a summary, or where the
    JSON cannot be read, error says so.
    """
    text = strip(unfenced(response))
    parts = F.from_json(text, "title STRING, summary STRING, keywords STRING")
    listed = F.from_json(parts["keywords"], "ARRAY<STRING>")
    keywords = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), strip), lambda k: k != "")
    summary = F.coalesce(strip(parts["summary"]), F.lit(""))
    error = F.when(parts.isNull() | F.coalesce(F.json_object_keys(text).isNull(), F.lit(True)), NOT_READ).when(summary == "", NO_SUMMARY)
    return F.struct(F.coalesce(strip(parts["title"]), F.lit("")).alias("title"), summary.alias("summary"), keywords.alias("keywords"), error.alias("error"))


#: The words an image is described in.
IMAGE_WORDS = ("Image file: ", " (%dx%d, %s mode)", ", Size: %d bytes, Type: %s")


def image_description(name: Column, width: Column, height: Column, mode: Column, size: Column, kind: Column) -> Column:
    """An image in words; without a size in pixels, only by name."""
    label, of_pixels, of_bytes = IMAGE_WORDS
    named = F.concat(F.lit(label), name)
    pixels = F.when(width.isNull(), "").otherwise(F.coalesce(F.format_string(of_pixels, width, height, F.coalesce(mode, F.lit("unknown"))), F.lit("")))
    return F.when(width.isNull() & size.isNull(), named).otherwise(F.concat(named, pixels, F.format_string(of_bytes, size, kind)))
