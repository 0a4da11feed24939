from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from foliodex.functions import text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "said, line",
    [("Café", " cafe "), ("Café", " cafe "), ("foo_bar", " foo bar "), ("straße", " straße "), ("", "  "), ("?!", "  "), (None, "  "), ("a1 \n B", " a1 b ")],
)
def test_token_line(spark, said, line):
    assert one(spark, text.token_line(F.lit(said).cast("string"))) == line


@pytest.mark.parametrize("said, phrase, n", [("cat cat cat", "cat cat", 2), ("a cat", "CAT", 1), ("concat", "cat", 0), ("x", "", 0), ("x", "!?", 0), ("crème brûlée", "creme brulee", 1)])
def test_phrase_count(spark, said, phrase, n):
    assert one(spark, text.phrase_count(text.token_line(F.lit(said)), phrase)) == n


def test_n_tokens(spark):
    assert [one(spark, text.n_tokens(text.token_line(F.lit(s)))) for s in ("", "a", "a b  c")] == [0, 1, 3]


@pytest.mark.parametrize("path, name, suffix, parent", [("/a/b.tar.gz", "b.tar.gz", ".gz", "/a"), ("/a/.hidden", ".hidden", "", "/a"), ("/x", "x", "", ""), ("/a/b.", "b.", "", "/a")])
def test_paths(spark, path, name, suffix, parent):
    p = F.lit(path)
    assert (one(spark, text.file_name(p)), one(spark, text.extension(p)), one(spark, text.parent(p))) == (name, suffix, parent)


def test_ancestors_and_scope(spark):
    assert one(spark, text.ancestors(F.lit("/a/b/c"))) == ["/a", "/a/b", "/a/b/c"]
    assert [one(spark, text.under(F.lit(p), "/a/")) for p in ("/a/x", "/a", "/ab/x")] == [True, True, False]


@pytest.mark.parametrize(
    "response, title, summary, keywords, error",
    [
        ('```json\n{"title": " T ", "summary": " S ", "keywords": ["a", " ", "b "]}\n```', "T", "S", ["a", "b"], None),
        ('Said: ```{"summary": "S"}``` and ```more```', "", "S", [], None),
        ('{"summary": "S", "keywords": "none"}', "", "S", [], None),
        ('{"title": "T"}', "T", "", [], text.NO_SUMMARY),
        ("no JSON", "", "", [], text.NOT_READ),
        (None, "", "", [], text.NOT_READ),
    ],
)
def test_parsed_response(spark, response, title, summary, keywords, error):
    x = one(spark, text.parsed_response(F.lit(response).cast("string")))
    assert (x["title"], x["summary"], x["keywords"], x["error"]) == (title, summary, keywords, error)


def test_embedding_text_leaves_out_empty_parts(spark):
    assert one(spark, text.embedding_text(F.lit("T"), F.lit(""), F.array(F.lit("a"), F.lit("b")))) == "Title: T Keywords: a, b"


def test_events_of_a_text_stream(spark):
    from foliodex.streaming import updates

    data = json.dumps({"opcode": "file_moved", "data": {"src_path": "/a", "dest_path": "/b"}})
    sent = updates.event_text(F.lit("update"), F.lit(data), F.lit(7))
    assert one(spark, sent) == f"event: update\nid: 7\ndata: {data}\n\n"
    back = one(spark, updates.parsed_event(sent))
    assert back["opcode"] == "file_moved" and one(spark, updates.message(F.lit(back["opcode"]), F.lit(back["data"]))) == "Moved /a -> /b"
    odd = one(spark, updates.parsed_event(F.lit("data: what\n\n")))
    assert odd["opcode"] == "info" and json.loads(odd["data"]) == {"message": "what"}
    assert one(spark, updates.message(F.lit("status_update"), F.lit("{}"))) == "Status: Status update"
    assert one(spark, updates.message(F.lit("x"), F.lit("{}"))) == "Unknown update: x"
