from __future__ import annotations

import datetime as dt
import json
import random


import numpy as np
import pytest
from pyspark.sql import functions as F

from foliodex.functions import vectors
from foliodex.functions.text import NOT_READ
from foliodex.operators import chunks, models, search, state, watch
from foliodex.plans.batch import knn_batch
from foliodex.sources import config, scan
from foliodex.streaming import events
from foliodex.tables import EVENTS, newest


def day(n):
    return dt.datetime(2024, 1, n)


def test_newest_with_ties_nulls_and_copies(spark):
    rows = [(1, day(1), "a"), (1, day(2), "b"), (1, day(2), "c"), (1, day(2), "c"), (2, None, "x"), (2, day(1), "y"), (None, day(1), "n")]
    found = newest(spark.createDataFrame(rows, "k int, v timestamp, x string"), "k", "v").collect()
    assert sorted((r["k"] or 0, r["x"]) for r in found) == [(0, "n"), (1, "c"), (2, "y")]


def test_distance_of_lengths_and_nulls(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0]), (3, None), (4, []), (5, [0.0, 0.0, 2.0])], "id int, v array<float>")
    got = {r["id"]: r["d"] for r in df.select("id", vectors.distance_to([0.0, 1.0])("v").alias("d")).collect()}
    assert got[3] is None
    assert np.allclose([got[i] for i in (1, 2, 4, 5)], [np.sqrt(18), np.sqrt(2), 1, np.sqrt(5)])


def test_knn_takes_k_before_the_filters(spark):
    df = spark.createDataFrame([(i, f"/{'a' if i % 2 else 'b'}/{i}", [float(i)]) for i in range(10)], "id long, file_path string, embedding array<float>")
    assert [r["id"] for r in search.knn(df, [0.0], 4, directory="/a").collect()] == [1, 3]
    assert [r["id"] for r in search.knn(df, [0.0], 4, directory="/a", prefilter=True).collect()] == [1, 3, 5, 7]
    assert [r["id"] for r in search.knn(df, [0.0], 4, threshold=2.0).collect()] == [0, 1, 2]
    assert [r["id"] for r in search.similar_to(df, 3, [3.0], 2, threshold=5.0).collect()] == [2, 4]


def test_knn_batch_against_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(0, 3, (60, 4)).astype(float)  # many ties and equal vectors
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id long, embedding array<float>")
    got = {(r["query_id"], r["place"]): r["id"] for r in knn_batch(df, F.col("id") % 7 == 0, 5).collect()}
    for q in range(0, 60, 7):
        want = sorted((round(float(np.sqrt(((m[i] - m[q]) ** 2).sum())), 6), i) for i in range(60) if i != q)[:5]
        assert [got[q, p] for p in range(1, 6)] == [i for _, i in want]


def test_knn_batch_ties_of_many_equal_vectors(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(3_000, 8)) + 3
    m[rng.permutation(np.arange(1, 3_000))[:150]] = m[0] + 0.01  # 150 equal vectors, the nearest of the first
    near = rng.permutation(np.arange(1, 3_000))[:5]
    m[near] = m[0] + 0.01 + 1e-9  # of equal distance after rounding
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id long, embedding array<double>")
    asked = F.col("id").isin(0, *near.tolist())
    got = {(r["query_id"], r["place"]): (r["distance"], r["id"]) for r in knn_batch(df, asked, 10).collect()}
    for q in (0, *near.tolist()):
        want = sorted((round(float(np.sqrt(((m[i] - m[q]) ** 2).sum())), 6), i) for i in range(3_000) if i != q)[:10]
        assert [got[q, p] for p in range(1, 11)] == want


def test_bm25_batch_of_any_length(spark):
    rows = [(i, f"/{'ab'[i % 2]}/{i}", " ".join("xyz"[i * j * j % 3] for j in range(i)), "The Yearly report, the yearly report of all" if i % 4 else None) for i in range(1, 30)]
    files = spark.createDataFrame(rows, "id long, file_path string, title string, summary string")
    index = search.text_index(files, spark.createDataFrame([(3, "of"), (3, "all")], "file_id long, keyword string"))
    phrases = ["x", "report", "yearly report", "The Yearly Report", "x y y x", "x x x", "report of all", "of all the", "report the yearly report of", "none of these", "...", None]
    asked = spark.createDataFrame(list(enumerate(phrases)), "query_id int, phrase string")
    got = sorted((r["query_id"], r["place"], r["id"], r["score"]) for r in search.bm25_batch(index, asked, 5).collect())
    want = [(q, i, r["id"], r["score"]) for q, p in enumerate(phrases) if p for i, r in enumerate(search.bm25(index, p, 5).collect(), 1)]
    assert got == sorted(want) and {q for q, *_ in got} >= {0, 1, 2, 3, 4, 5, 6, 8}
    assert search.bm25_batch(index, asked.limit(0)).count() == 0


def test_merged_sides(spark):
    near = spark.createDataFrame([(1, "/1", 0.0), (2, "/2", 1.0)], "id long, file_path string, distance double")
    words = spark.createDataFrame([(2, "/2", 3.0), (3, "/3", 0.4)], "id long, file_path string, score double")
    rows = search.merged(near, words, 10).collect()
    assert [(r["id"], r["match_type"]) for r in rows] == [(2, "hybrid"), (1, "semantic"), (3, "keyword")]
    assert rows[0]["combined_score"] == round(0.5 * np.exp(-1) + 1.5, 6)
    with pytest.raises(ValueError):
        search.search(near, words, "x", [1.0], mode="other")


def test_common_terms_keep_a_small_weight(spark):
    files = spark.createDataFrame([(i, f"/{i}", "same", None) for i in range(4)], "id long, file_path string, title string, summary string")
    none = spark.createDataFrame([], "file_id long, keyword string")
    index = search.text_index(files, none)
    assert {r["score"] for r in search.bm25(index, "same").collect()} == {round(1e-6 * 2.2 / (1 + 1.2), 6)}
    assert search.bm25(index, "?").count() == 0 and search.bm25(index, "absent").count() == 0


def test_state_changes(spark):
    old = spark.createDataFrame([(1, "/a", day(1)), (2, "/b", day(1))], "id long, file_path string, updated_at timestamp")
    new = spark.createDataFrame([(3, "/b", day(2)), (4, "/c", day(2)), (4, "/c", day(2))], "id long, file_path string, updated_at timestamp")
    assert sorted((r["file_path"], r["id"]) for r in state.upserted(old, new).collect()) == [("/a", 1), ("/b", 3), ("/c", 4)]
    assert [r["file_path"] for r in state.stale(old, F.lit("2024-01-02").cast("timestamp"), "/a").collect()] == ["/a"]
    left, gone = state.deleted(old, new)
    assert [r["id"] for r in left.collect()] == [1] and [r["id"] for r in gone.collect()] == [2]
    kids = spark.createDataFrame([(1, "x"), (2, "y")], "file_id long, keyword string")
    more = spark.createDataFrame([(2, "z"), (2, "z")], "file_id long, keyword string")
    assert sorted(tuple(r) for r in state.replaced_children(kids, more).collect()) == [(1, "x"), (2, "z")]
    assert [r["file_id"] for r in state.live_children(kids, old.where("id = 1")).collect()] == [1]


def test_snapshot_changes(spark):
    kind = "file_path string, content_hash string, modified timestamp"
    a = spark.createDataFrame([("/same", "1", day(1)), ("/old", "2", day(1)), ("/gone", "3", day(1)), ("/edit", "4", day(1))], kind)
    b = spark.createDataFrame([("/same", "1", day(1)), ("/new", "2", day(1)), ("/edit", "5", day(2)), ("/made", "6", day(2))], kind)
    got = {r["file_path"]: (r["change"], r["moved_from"]) for r in state.snapshot_changes(a, b).collect()}
    assert got == {"/new": ("moved", "/old"), "/gone": ("deleted", None), "/edit": ("modified", None), "/made": ("created", None)}


def test_watched_directories(spark):
    files = spark.createDataFrame([(1, "/a/x", 5), (2, "/a/b/y", 7), (3, "/ab/z", 9)], "id long, file_path string, file_size long")
    dirs = spark.createDataFrame([(10, "/a", True), (11, "/a/b", False), (12, "/none", True), (13, "/", False)], "id long, path string, recursive boolean")
    got = {r["id"]: (r["files"], r["bytes"]) for r in watch.watch_sizes(files, dirs).collect()}
    assert got == {10: (2, 12), 11: (1, 7), 12: (0, 0), 13: (0, 0)}
    asked = spark.createDataFrame([("/a/b",), ("/q",)], "path string")
    assert sorted((r["watch_id"], r["reason"]) for r in watch.overlaps(dirs, asked).collect()) == [(10, "inside"), (11, "exact")]
    left, kept = watch.without_directory(dirs, files, 10)
    assert left.count() == 3 and sorted(r["id"] for r in kept.collect()) == [2, 3]


def joined(text, limit, overlap=50):
    """The chunks of a text, after a check that their own stretches make it up."""
    spans = chunks.chunk_spans(text, limit, overlap)
    assert "".join(text[b:c] for _, b, c in spans) == text
    assert all(chunks.tokens_of(text[a:c]) <= limit and a <= b < c for a, b, c in spans)
    return [text[a:c] for a, _, c in spans]


def test_chunks():
    assert joined("short. text", 100) == ["short. text"] and joined("", 10) == []
    text = ". ".join(f"sentence number {i:03d} goes on" for i in range(40))
    found = joined(text, 50)
    assert len(found) > 5 and all(c.startswith("sentence") for c in found)
    assert found[1].startswith(found[0].split(". ")[-2])  # the last sentence again
    assert len(joined(text, 50, 150)[1].split(". ")[0]) and joined(text, 50, 150)[1].startswith(found[0].split(". ")[-4])
    assert "".join(joined("x" * 1000, 50)) == "x" * 1000
    words = " ".join(f"word{i:04d}" for i in range(900))
    assert all(c.startswith("word") and c.rstrip()[-4:].isdigit() for c in joined(words, 50))
    assert joined(" " * 1000, 50)
    rng = random.Random(3)
    for _ in range(200):
        parts = [rng.choice(["a", "bb", "c" * rng.randint(1, 60), "é"]) + rng.choice([". ", " ", "\n\n", "", ".  ", "\n"]) for _ in range(rng.randint(0, 60))]
        joined("".join(parts), rng.randint(3, 20), rng.choice([0, 50, 200]))


def test_chunked_rows(spark):
    df = spark.createDataFrame([(1, "a. b"), (2, None), (3, ""), (4, "x" * 2000), (5, ". ".join(["word " * 20] * 60)), (6, " \n ")], "id long, t string")
    rows = chunks.chunked(df, "id", "t", 60).collect()
    assert {r["id"]: r["error"] for r in rows} == {1: None, 2: "empty", 3: "empty", 4: None, 5: None, 6: "empty"}
    assert sum(len(r["chunk"]) for r in rows if r["id"] == 4) == 2000
    rows = chunks.chunked(df, "id", "t", 60, drop_oversize=True, most=5, largest=1000).collect()
    assert {r["id"]: r["error"] for r in rows} == {1: None, 2: "empty", 3: "empty", 4: "no chunk", 5: "too long", 6: "empty"}
    assert {r["error"] for r in chunks.chunked(df.where("id = 5"), "id", "t", 60, most=5).collect()} == {"too many chunks"}
    assert chunks.chunked(df.limit(0), "id", "t", 60).count() == 0


def test_merged_summaries(spark):
    df = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two"), ("b", 1, "x" * 300), ("b", 2, "y" * 300), ("b", 3, "z"), ("b", 4, "w"), ("c", 1, None), ("d", 1, "only")], "k string, i int, s string")
    got = {r["k"]: r["merged"] for r in chunks.merged_summaries(df, "k", "i", "s").collect()}
    assert got == {"a": "one two", "b": f"Multi-part document covering: {'x' * 300}; {'y' * 300}; z and 1 additional topics.", "d": "only"}


def test_models(spark):
    def broken():
        raise RuntimeError("not here")

    df = spark.createDataFrame([(1, "some words"), (2, " "), (3, None), (4, "some words")], "id long, t string")
    rows = {r["id"]: r["embedding"] for r in models.embedded(df, "t", [broken, lambda: models.hashed_embedding(64)], 64).collect()}
    assert rows[2] is None and rows[3] is None and rows[1] == rows[4] and abs(sum(x * x for x in rows[1]) - 1) < 1e-5
    with pytest.raises(ValueError):
        models.embedded(df, "t", [], 8)
    assert [r["x"] for r in df.select(models.extracted_summary(F.lit(" First one. Second.")).alias("x")).limit(1).collect()] == ["First one."]


def test_summaries(spark):
    def broken():
        raise RuntimeError("not here")

    long = ". ".join(["Many words stand in this sentence about gardens"] * 30)
    df = spark.createDataFrame([(1, "First one. Second one about trees."), (2, None), (3, long), (4, "x" * 4000)], "id long, t string")
    rows = {r["id"]: r for r in models.summarised(df, "id", "t", [broken, models.extractive_summariser], 100).collect()}
    assert rows[1]["summary"] == "First one." and rows[1]["title"] == "First one. Second one about" and rows[1]["error"] is None
    assert rows[2]["error"] == "empty" and rows[2]["summary"] is None and rows[4]["error"] is None
    assert rows[3]["n_chunks"] > 2 and rows[3]["keywords"][0] == "about"
    odd = models.summarised(df.where("id = 1"), "id", "t", [lambda: lambda texts: ["no JSON"] * len(texts)]).first()
    assert odd["error"] == NOT_READ and odd["summary"] is None


def test_single_score(spark):
    rows = [(0.5, 2.0), (0.5, None), (None, 2.0), (None, None), (3.0, None)]
    df = spark.createDataFrame(rows, "d double, k double").select(F.round(search.single_score(F.col("d"), F.col("k")), 6).alias("x"))
    assert [r["x"] for r in df.collect()] == [0.95, 0.5, 2.0, 0.0, 0.0]


def test_images(spark, tmp_path):
    import base64

    dot = "iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg=="
    (tmp_path / "a.png").write_bytes(base64.b64decode(dot))
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {r["file_path"].rsplit("/", 1)[1]: (r["width"], r["height"]) for r in scan.images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (1, 1), "b.png": (None, None)}


def event(seq, kind, src, dest=None, is_dir=False):
    return (seq, day(1), kind, is_dir, src, dest)


EVENT_ROWS = [
    event(1, "created", "/a"),
    event(2, "MOVED", "/a", "/b"),
    event(2, "moved", "/a", "/b"),
    event(3, "modified", "/b"),
    event(4, "deleted", "/c"),
    event(5, "created", "/dir", is_dir=True),
    event(6, "moved", "/d", "/d"),
    event(7, "odd", "/e"),
    event(None, "created", "/f"),
    event(8, "created", None),
]
FOLDED = {"/a": "delete", "/b": "upsert", "/c": "delete", "/d": "upsert"}


def test_folded_events(spark):
    df = spark.createDataFrame(EVENT_ROWS, EVENTS)
    assert {r["path"]: r["action"] for r in events.folded(df).collect()} == FOLDED
    files = spark.createDataFrame([("/c",), ("/z",)], "file_path string")
    got = {r["file_path"]: (r["known"], r["action"]) for r in events.applied(files, df).collect()}
    assert got["/c"] == (True, "deleted") and got["/z"] == (True, "kept") and got["/b"] == (False, "process")


def test_event_stream(spark, tmp_path):
    spark.createDataFrame(EVENT_ROWS, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = {}
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    events.watch(stream, lambda df, n: seen.update({r["path"]: r["action"] for r in df.collect()}), str(tmp_path / "ck"), once=True).awaitTermination(60)
    assert seen == FOLDED


def test_hourly_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 5), "created", False, "/a", None), (2, dt.datetime(2024, 1, 1, 0, 50), "CREATED", False, "/b", None), (3, dt.datetime(2024, 1, 1, 9), "deleted", False, "/a", None), (4, None, "created", False, "/n", None)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.hourly(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly_test").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["kind"], r["n"]) for r in spark.table("hourly_test").collect()) == [("created", 2), ("deleted", 1)]


def test_directory_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("plain text of some length")
    (tmp_path / "sub" / "page.html").write_text("<head><title>x</title></head><p>Some <b>bold</b> words &amp; more</p><script>no()</script>")
    (tmp_path / "sub" / "b.bin").write_bytes(b"\x00\x01")
    rows = scan.extracted(scan.scan(spark, str(tmp_path), content=True)).collect()
    got = {r["filename"]: (r["text"], r["error"]) for r in rows}
    assert got["a.txt"] == ("plain text of some length", None)
    assert got["page.html"] == ("Some bold words & more", None)
    assert got["b.bin"] == (None, "no text")
    assert scan.scan(spark, str(tmp_path / "a.txt")).count() == 1
    assert scan.scan(spark, str(tmp_path / "missing")).count() == 0
    assert scan.scan(spark, str(tmp_path), "*.txt").count() == 1
    (tmp_path / "sub" / ".hidden").write_text("x")
    assert {(r["filename"], r["file_size"]) for r in scan.walk(spark, str(tmp_path)).collect()} >= {(".hidden", 1), ("b.bin", 2), ("a.txt", 25)}
    stat = scan.stat_rows(scan.scan(spark, str(tmp_path / "a.txt"))).first()
    assert stat["created"] is not None


def test_settings():
    s = config.settings({"FOLIODEX_SEARCH_LIMIT": "7", "FOLIODEX_RETRY_FAILED": "Yes", "OTHER": "x"})
    assert (s.search_limit, s.retry_failed, s.semantic_threshold) == (7, True, 2.0)


def test_staged_tables(spark):
    from foliodex.session import drop_staged, stage

    kept = stage(spark.range(5), "five")
    assert kept.count() == 5 and drop_staged(spark) >= 1 and drop_staged(spark) == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], EVENTS)
    assert events.folded(none).count() == 0
    empty = spark.createDataFrame([], "id long, embedding array<float>")
    assert knn_batch(empty, F.col("id") % 2 == 0, 3).count() == 0
    assert json.loads("[]") == []
