from __future__ import annotations

import math
import os

import pytest
from pyspark.sql import functions as F

from foliodex.engine import FileIndex
from foliodex.sources.config import Settings
from foliodex.tables import EVENTS


def test_index_of_a_directory(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "report.txt").write_text("The annual budget report. It describes every expense of the year.")
    (docs / "notes.md").write_text("Kitchen notes about bread and butter. More of them follow.")
    (docs / "tiny.txt").write_text("short")
    (docs / "image.xyz").write_bytes(b"\x00")
    index = FileIndex(spark, str(tmp_path / "index"))
    first = {os.path.basename(r["file_path"]): r["decision"] for r in index.process_directory(str(docs)).collect()}
    assert first == {"report.txt": "process", "notes.md": "process", "tiny.txt": "process", "image.xyz": "unsupported"}
    files = {r["filename"]: r for r in index.table("files").collect()}
    assert files["report.txt"]["status"] == "COMPLETE" and files["report.txt"]["summary"] == "The annual budget report."
    assert files["tiny.txt"]["status"] == "FAILED" and files["tiny.txt"]["processing_error"] == "no text"
    found = index.search("annual budget").collect()
    assert found[0]["file_path"].endswith("report.txt") and found[0]["match_type"] == "hybrid"
    assert index.search("bread", mode="keyword").count() == 1
    assert [r["suggestion"] for r in index.suggest("bu").collect()] == ["budget", "butter"]
    assert index.by_keywords(["bread", "butter"], match_all=True).count() == 1
    assert index.similar(files["report.txt"]["id"], threshold=2.0).count() == 1 and index.similar(-1).count() == 0
    assert index.page(1, 2).count() == 2 and index.page(2, 2).count() == 1 and index.page(extension=".MD").count() == 1

    again = {os.path.basename(r["file_path"]): r["decision"] for r in index.process_directory(str(docs)).collect()}
    assert again["report.txt"] == "skip" and again["tiny.txt"] == "skip"

    os.utime(docs / "report.txt", (1_900_000_000, 1_900_000_000))
    index.process_directory(str(docs))
    same = index.find(F.col("filename") == "report.txt").first()
    assert same["summary"] == files["report.txt"]["summary"] and same["modified"].year == 2030 and same["embedded_at"] == files["report.txt"]["embedded_at"]

    (docs / "report.txt").write_text("A new text about gardens and trees, much longer than it was.")
    os.utime(docs / "report.txt", (2_000_000_000, 2_000_000_000))
    os.remove(docs / "notes.md")
    changed = {os.path.basename(r["file_path"]): r["decision"] for r in index.process_directory(str(docs)).collect()}
    assert changed["report.txt"] == "process"
    assert index.find(F.col("filename") == "notes.md").count() == 0 and index.search("bread", mode="keyword").count() == 0
    assert index.search("gardens", mode="keyword").count() == 1
    assert index.table("file_embeddings").count() == 1

    path = index.find(F.col("filename") == "report.txt").first()["file_path"]
    index.apply_events(spark.createDataFrame([(1, None, "modified", False, path, None)], EVENTS))
    assert index.find(F.col("file_path") == path).first()["status"] == "COMPLETE"
    index.delete_file(path)
    assert index.table("file_keywords").count() == 0
    index.register_views()
    assert spark.sql("SELECT sum(files) AS n FROM processing_summary").first()["n"] == 1
    assert index.stats().first()["total_files"] == 1 and index.active_streams() == 0


def test_patterns_one_after_another(spark, tmp_path):
    docs = tmp_path / "docs"
    (docs / "below").mkdir(parents=True)
    for name in ("a.md", "b.txt", "below/c.txt", "d.csv"):
        (docs / name).write_text(f"Some text about gardens in {name}. More of it follows.")
    index = FileIndex(spark, str(tmp_path / "index"))
    names = lambda: sorted(r["filename"] for r in index.table("files").collect())
    assert {os.path.basename(r["file_path"]) for r in index.process_directory(str(docs), "*.txt").collect()} == {"b.txt", "c.txt"}
    assert index.process_directory(str(docs), "*.md").count() == 1
    assert names() == ["a.md", "b.txt", "c.txt"]
    assert index.table("file_embeddings").count() == 3 and index.search("gardens", mode="keyword").count() == 3
    assert index.table("file_keywords").select("file_id").distinct().count() == 3
    os.remove(docs / "below" / "c.txt")
    index.process_directory(str(docs), "*.md")
    assert names() == ["a.md", "b.txt"] and index.table("file_embeddings").count() == 2
    os.remove(docs / "a.md")
    index.process_directory(str(docs), "*.md")  # nothing of this name is left
    assert names() == ["b.txt"]


def names(index):
    return sorted(r["filename"] for r in index.table("files").collect())


def test_events_are_followed(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    say = lambda name: (docs / name).write_text(f"Some text about gardens in {name}. More of it follows.")
    for name in ("a.txt", "b.txt"):
        say(name)
    index = FileIndex(spark, str(tmp_path / "index"))
    index.process_directory(str(docs))
    created = {r["filename"]: r["created_at"] for r in index.table("files").collect()}
    say("c.txt"), say("pic.xyz"), os.rename(docs / "a.txt", docs / "z.txt"), say("b.txt")
    rows = [(1, "created", "c.txt", None), (2, "moved", "a.txt", "z.txt"), (3, "modified", "b.txt", None), (4, "created", "pic.xyz", None), (5, "created", "never.txt", None)]
    index.apply_events(spark.createDataFrame([(n, None, k, False, str(docs / a), b and str(docs / b)) for n, k, a, b in rows], EVENTS))
    assert names(index) == ["b.txt", "c.txt", "z.txt"]
    found = {r["filename"]: r for r in index.table("files").collect()}
    assert all(r["status"] == "COMPLETE" and r["content_type"] == "text/plain" for r in found.values()) and found["b.txt"]["created_at"] == created["b.txt"]
    assert index.search("gardens", mode="keyword").count() == 3 and index.table("file_embeddings").count() == 3
    os.remove(docs / "c.txt")
    index.apply_events(spark.createDataFrame([(6, None, "deleted", False, str(docs / "c.txt"), None), (7, None, "created", True, str(docs), None)], EVENTS))
    assert names(index) == ["b.txt", "z.txt"] and index.table("file_keywords").select("file_id").distinct().count() == 2
    said = [(r["opcode"]) for r in index.updates().collect()]
    assert said[0] == "directory_processing_started" and "directory_processing_completed" in said and said.count("file_deleted") == 2
    assert said.count("file_complete") == 4 and said.count("file_embedded") == 4  # b.txt has the text it had


def test_a_watch_from_end_to_end(spark, tmp_path):
    docs, arrived = tmp_path / "docs", tmp_path / "events"
    (docs / "below").mkdir(parents=True)
    say = lambda name: (docs / name).write_text(f"Some text about gardens in {name}. More of it follows.")
    say("a.txt"), say("b.md"), say("below/c.txt")
    index = FileIndex(spark, str(tmp_path / "index"))
    assert index.start_watching(str(docs), recursive=False, file_pattern="*.txt")
    assert names(index) == ["a.txt"]  # the first scan
    say("d.txt"), say("e.md"), say("below/f.txt")
    (tmp_path / "g.txt").write_text("Some text about gardens elsewhere. More of it follows.")
    rows = [(i, None, "created", False, p, None) for i, p in enumerate([str(docs / "d.txt"), str(docs / "e.md"), str(docs / "below" / "f.txt"), str(tmp_path / "g.txt")])]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(arrived))
    stream = lambda: spark.readStream.schema(EVENTS).parquet(str(arrived))
    index.follow(stream(), str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert names(index) == ["a.txt", "d.txt"]  # the pattern and the one level hold for events too
    subscribers = [index.update_stream().writeStream.format("memory").queryName(f"told{i}").option("checkpointLocation", str(tmp_path / f"told{i}")).trigger(availableNow=True).start() for i in (1, 2)]
    for query in subscribers:
        query.awaitTermination()
    assert spark.table("told1").count() == spark.table("told2").count() == index.updates().count() > 5
    index.stop()
    os.remove(docs / "a.txt")
    again = FileIndex(spark, str(tmp_path / "index"))
    spark.createDataFrame([(9, None, "deleted", False, str(docs / "d.txt"), None)], EVENTS).write.mode("append").parquet(str(arrived))
    assert again.restore() == [str(docs)] and names(again) == ["d.txt"]
    again.follow(stream(), str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert names(again) == []
    again.stop()


def test_a_missing_root_is_not_swept(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("Some text about gardens. More of it follows.")
    index = FileIndex(spark, str(tmp_path / "index"))
    index.process_directory(str(docs))
    os.rename(docs, tmp_path / "moved")
    assert index.process_directory(str(docs)).count() == 0 and names(index) == ["a.txt"]
    assert index.start_watching(str(docs)) and names(index) == ["a.txt"] and index.restore() == []


def test_only_touched_buckets_are_written(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for i in range(12):
        (docs / f"{i}.txt").write_text(f"Some text about number {i}. More of it follows.")
    index = FileIndex(spark, str(tmp_path / "index"))
    index.process_directory(str(docs))
    before = index.tables.manifest()
    assert len(before["files"]) > 4
    index.delete_file(str(docs / "3.txt"))
    after = index.tables.manifest()
    assert sum(after["files"].get(b) != p for b, p in before["files"].items()) == 1 and index.table("files").count() == 11
    assert index.tables.vacuum() >= 1 and index.table("files").count() == 11 and index.table("file_keywords").count() > 0
    assert index.tables.vacuum() == 0


def test_settings_and_slots(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("One sentence about trees. " * 200)
    (docs / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"))
    seen = tmp_path / "seen"

    def shouting():
        return lambda texts: [f'{{"title": "T", "summary": "{len(t)}", "keywords": ["k"]}}' for t in texts]

    index = FileIndex(spark, str(tmp_path / "index"), Settings(chunk_tokens=300, semantic_weight=0.9, keyword_weight=0.1), summarisers=[shouting])
    index.process_directory(str(docs))
    found = {r["filename"]: r for r in index.table("files").collect()}
    assert found["a.txt"]["title"] == "T" and len(found["a.txt"]["summary"].split()) > 3  # one summary for each chunk
    assert found["p.png"]["status"] == "COMPLETE" and found["p.png"]["content_type"] == "image/png"
    near = index.search("k").first()
    assert near["combined_score"] == pytest.approx(0.9 * math.exp(-near["semantic_score"]) + 0.1 * near["keyword_score"], abs=1e-5)
    plain = FileIndex(spark, str(tmp_path / "plain"), Settings(extraction_strategy="plain_only"))
    plain.process_directory(str(docs))
    assert {r["filename"]: r["status"] for r in plain.table("files").collect()} == {"a.txt": "COMPLETE", "p.png": "FAILED"}
    assert not seen.exists()


def test_watching(spark, tmp_path):
    index = FileIndex(spark, str(tmp_path / "index"))
    assert index.start_watching("/a/") and not index.start_watching("/a") and not index.start_watching("/a/b") and index.start_watching("/ab", recursive=False)
    assert [r["path"] for r in index.watched().collect()] == ["/a", "/ab"]
    index.stop_watching("/a", drop_files=True)
    index.stop_watching("/none")
    assert [r["path"] for r in index.watched().collect()] == ["/ab"]
