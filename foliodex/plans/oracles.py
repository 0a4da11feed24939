"""SQL for DuckDB that must give the rows of the registered queries, written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from foliodex.functions.text import AUDIO, IMAGE, SUPPORTED, VIDEO, mime_types

FILES = "f AS (SELECT * FROM (SELECT DISTINCT * FROM files) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
CONTENTS = """c AS (SELECT * FROM (SELECT DISTINCT * FROM file_contents)
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY parsed_at DESC NULLS LAST, content_hash DESC, extraction_method DESC) = 1)"""
KEYWORDS = "k AS (SELECT DISTINCT file_id, keyword FROM file_keywords WHERE file_id IS NOT NULL AND keyword IS NOT NULL)"
LISTED = "l AS (SELECT file_id, list(keyword ORDER BY keyword) AS words FROM k GROUP BY file_id)"
SPACE = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"
WATCHED = "w AS (SELECT * FROM (SELECT DISTINCT * FROM watched_directories) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _vectors(model: str, dims: int) -> str:
    return f"""v0 AS (SELECT file_id, embedding[1:{dims}] AS e FROM file_embeddings WHERE embedding_model = '{model}' AND len(embedding) > 0),
v1 AS (SELECT file_id, list_concat(e, list_transform(range({dims} - len(e)), lambda x: 0::FLOAT)) AS e FROM v0),
v AS (SELECT f.id, f.file_path, max(e)::DOUBLE[] AS e FROM v1 JOIN f ON f.id = v1.file_id
  WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 GROUP BY ALL),
q AS (SELECT id AS qid, e AS qe FROM v ORDER BY id LIMIT 1),
d AS (SELECT id, file_path, round(list_distance(e, qe), 6) AS distance FROM v, q)"""


def _models(make: Callable[[str], str]) -> str:
    """The rows of what ``make`` says of the vectors of each model."""
    return " UNION ALL ".join(f"SELECT *, '{m}' AS embedding_model FROM ({make(_vectors(m, d))})" for m, d in (("local-small-64", 64), ("online-mid-96", 96)))


def _tokens(column: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({column}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


INDEX = f"""lines AS (SELECT f.id, f.file_path, {_tokens('f.file_path')} AS t1, {_tokens('title')} AS t2, {_tokens('summary')} AS t3,
  {_tokens("array_to_string(words, ' ')")} AS t4 FROM f LEFT JOIN l ON l.file_id = f.id)"""


def _bm25(tokens: list[str]) -> str:
    phrase = "[" + ", ".join(f"'{t}'" for t in tokens) + "]"
    hits = " + ".join(f"len(list_filter(range(1, len(t{i}) - {len(tokens) - 2}), lambda i: t{i}[i : i + {len(tokens) - 1}] = {phrase}))" for i in range(1, 5))
    return f"""{INDEX},
counted AS (SELECT id, file_path, {hits} AS n_hits, len(t1) + len(t2) + len(t3) + len(t4) AS dl FROM lines),
corpus AS (SELECT count(*) AS n, count(*) FILTER (WHERE n_hits > 0) AS df, avg(dl) AS avgdl FROM counted),
b AS (SELECT id, file_path, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * n_hits * 2.2 / (n_hits + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM counted, corpus WHERE n_hits > 0)"""


def _under(path: str, directory: str = "/data/share") -> str:
    return f"({path} = '{directory}' OR starts_with({path}, '{directory}/'))"


def _hybrid(limit: int, a: float, b: float, where: str = "true") -> str:
    return _models(lambda vectors: f"""WITH {FILES}, {KEYWORDS}, {LISTED}, {vectors}, {_bm25(['regional'])},
s AS (SELECT * FROM (SELECT * FROM d ORDER BY distance, id LIMIT {2 * limit}) WHERE distance <= 2.0 AND {where}),
w AS (SELECT * FROM b WHERE {where} ORDER BY score DESC, id LIMIT {4 * limit}),
m AS (SELECT coalesce(s.id, w.id) AS id, coalesce(s.file_path, w.file_path) AS file_path, s.distance AS semantic_score, w.score AS keyword_score,
  coalesce(exp(-s.distance) * {a}, 0) AS x, coalesce(w.score * {b}, 0) AS y FROM s FULL OUTER JOIN w ON s.id = w.id)
SELECT id, file_path, semantic_score, keyword_score, round(x + y, 6) AS combined_score,
  CASE WHEN x > 0 AND y > 0 THEN 'hybrid' WHEN y > 0 THEN 'keyword' WHEN x > 0 THEN 'semantic' ELSE 'none' END AS match_type
FROM m ORDER BY combined_score DESC, id LIMIT {limit}""")


CLEAN = """e AS (SELECT DISTINCT seq, lower(trim(kind)) AS kind, src_path, dest_path FROM fs_events
  WHERE lower(trim(kind)) IN ('created', 'modified', 'deleted', 'moved') AND src_path IS NOT NULL AND seq IS NOT NULL AND NOT coalesce(is_dir, false))"""
FOLD = f"""{CLEAN},
steps AS (SELECT src_path AS path, seq, 0 AS step, CASE WHEN kind IN ('deleted', 'moved') THEN 'delete' ELSE 'upsert' END AS action FROM e
  UNION ALL SELECT dest_path, seq, 1, 'upsert' FROM e WHERE kind = 'moved' AND dest_path IS NOT NULL),
last AS (SELECT path, action, seq FROM steps QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC, step DESC) = 1)"""
UP = "list_transform(range(2, greatest(len(string_split({0}, '/')), 2) + 1), lambda n: array_to_string(string_split({0}, '/')[1 : n], '/'))"
NAME = "regexp_extract(file_path, '[^/]*$')"
SUFFIX = f"regexp_extract({NAME}, '[^.](\\.[^.]+)$', 1)"

ORACLES = {
    "files_scan": f"WITH {FILES} SELECT id, filename, extension, file_path, {TIME.format('created')} AS created, {TIME.format('modified')} AS modified, title, summary FROM f",
    "file_kinds": f"""WITH {FILES}, s AS (SELECT id, {NAME} AS name, {SUFFIX} AS suffix FROM f)
SELECT id, name, suffix, CASE WHEN lower(suffix) IN {_in(AUDIO)} THEN 'audio' WHEN lower(suffix) IN {_in(VIDEO)} THEN 'video' WHEN lower(suffix) IN {_in(IMAGE)} THEN 'image' END AS media,
  lower(suffix) IN {_in(SUPPORTED)} AS supported FROM s""",
    "files_by_event_path": f"WITH {FILES} SELECT id, file_path, status FROM f WHERE file_path IN (SELECT src_path FROM fs_events WHERE src_path IS NOT NULL)",
    "content_hash_dupes": f"WITH {CONTENTS} SELECT sha256(content) AS sha256, count(*) AS files, min(file_id) AS first_file FROM c WHERE content IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "files_by_hash": f"WITH {FILES}, {CONTENTS} SELECT f.id, sha256(content) AS sha256, coalesce(lower(trim(f.content_hash)) = sha256(content), false) AS agrees FROM f JOIN c ON c.file_id = f.id WHERE content IS NOT NULL",
    "file_types": f"WITH {FILES} SELECT id, CASE lower(extension) {' '.join(f"WHEN '{e}' THEN '{t}'" for e, t in mime_types().items())} END AS by_extension, content_type FROM f",
    "files_page": f"WITH {FILES} SELECT id, filename, extension, title FROM f WHERE lower(extension) = '.md' ORDER BY id LIMIT 30 OFFSET 30",
    "size_errors": f"WITH {FILES} SELECT id, file_path, file_size, 'too large' AS error FROM f WHERE file_size > 100000",
    "checked_statuses": f"WITH {FILES} SELECT status, count(*) AS files FROM f GROUP BY status",
    "dir_scope": f"WITH {FILES} SELECT id, file_path, file_size FROM f WHERE {_under('file_path')}",
    "files_with_keywords": f"WITH {FILES}, {KEYWORDS} SELECT id, file_path, title, status, string_agg(keyword, ', ' ORDER BY keyword) AS keywords FROM f LEFT JOIN k ON k.file_id = f.id GROUP BY id, file_path, title, status",
    "files_searchable": f"WITH {FILES}, {KEYWORDS} SELECT id, file_path, title, summary, string_agg(keyword, ' ' ORDER BY keyword) AS keywords FROM f LEFT JOIN k ON k.file_id = f.id GROUP BY id, file_path, title, summary",
    "processing_summary": f"WITH {FILES} SELECT status, count(*) AS files, round(avg(file_size), 4) AS mean_size, sum(file_size)::BIGINT AS total_size FROM f WHERE status IS NOT NULL GROUP BY status",
    "recent_activity": f"WITH {FILES} SELECT id, filename, status, {TIME.format('created_at')} AS created, {TIME.format('updated_at')} AS updated FROM f ORDER BY created_at DESC, id LIMIT 100",
    "file_stats": f"WITH {FILES} SELECT count(*) AS total_files, sum(file_size)::BIGINT AS total_size, {TIME.format('max(updated_at)')} AS last_indexed FROM f",
    "extension_counts": f"WITH {FILES} SELECT lower(extension) AS suffix, count(*) AS files, sum(file_size)::BIGINT AS total_size FROM f GROUP BY 1",
    "extraction_counters": f"WITH {CONTENTS} SELECT extraction_method, count(*) AS extractions, count(*) FILTER (WHERE length(trim(content, {SPACE})) > 10) AS successes FROM c GROUP BY 1",
    "token_statistics": f"""WITH {CONTENTS}, t AS (SELECT extraction_method, length(coalesce(content, '')) // 4 AS n FROM c)
SELECT extraction_method, sum(n)::BIGINT AS tokens, (sum(n) // count(*))::BIGINT AS mean_tokens, max(n) AS most_tokens FROM t GROUP BY 1""",
    "session_stats": """SELECT status, count(*) AS sessions, sum(total_files)::BIGINT AS total_files, sum(processed_files)::BIGINT AS processed_files, sum(failed_files)::BIGINT AS failed_files,
  sum(skipped_files)::BIGINT AS skipped_files, round(avg(processing_time_seconds), 6) AS mean_seconds FROM (SELECT DISTINCT * FROM processing_stats) GROUP BY status""",
    "image_infos": f"""WITH {CONTENTS}, p AS (SELECT file_id, regexp_extract(content, '^Image file: (\\S+) \\((\\d+)x(\\d+), mode (\\w+)\\), Size: (\\d+) bytes, Type: (\\w+)', ['name', 'w', 'h', 'm', 's', 'k']) AS x
FROM c WHERE starts_with(content, 'Image file: '))
SELECT file_id, x.name AS name, try_cast(x.w AS BIGINT) AS width, try_cast(x.h AS BIGINT) AS height, try_cast(x.s AS BIGINT) AS bytes,
  CASE WHEN x.s = '' THEN 'Image file: ' || x.name ELSE 'Image file: ' || x.name || ' (' || x.w || 'x' || x.h || ', ' || x.m || ' mode), Size: ' || x.s || ' bytes, Type: ' || x.k END AS description FROM p""",
    "embedding_texts": f"""WITH {FILES}, {KEYWORDS}, {LISTED}
SELECT id, concat_ws(' ', CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN summary <> '' THEN 'Summary: ' || summary END,
  CASE WHEN array_to_string(words, ', ') <> '' THEN 'Keywords: ' || array_to_string(words, ', ') END) AS embedding_text FROM f LEFT JOIN l ON l.file_id = f.id""",
    "model_responses": f"""WITH {FILES}, {KEYWORDS}, {LISTED},
r AS (SELECT id, trim(coalesce(title, ''), {SPACE}) AS title, trim(coalesce(summary, ''), {SPACE}) AS summary,
  array_to_string(list_filter(list_transform(coalesce(words, []), lambda x: trim(x, {SPACE})), lambda x: x <> ''), '|') AS keywords FROM f LEFT JOIN l ON l.file_id = f.id)
SELECT *, CASE WHEN summary = '' THEN 'no summary' END AS error FROM r""",
    "keyword_merge": f"""WITH {KEYWORDS}, one AS (SELECT file_id, keyword FROM k QUALIFY row_number() OVER (PARTITION BY file_id, lower(keyword) ORDER BY keyword) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY keyword) AS i FROM one)
SELECT file_id, string_agg(keyword, '|' ORDER BY keyword) AS keywords FROM n WHERE i <= 15 GROUP BY file_id""",
    "directory_summaries": f"""WITH {FILES}, p AS (SELECT id, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS directory, summary FROM f WHERE summary IS NOT NULL),
g AS (SELECT directory, count(*) AS parts, list(summary ORDER BY id) AS s FROM p GROUP BY directory)
SELECT directory, parts, CASE WHEN parts = 1 THEN s[1] WHEN length(array_to_string(s, ' ')) > 500
  THEN 'Multi-part document covering: ' || array_to_string(s[1:3], '; ') || CASE WHEN parts > 3 THEN ' and ' || (parts - 3) || ' additional topics.' ELSE '' END
  ELSE array_to_string(s, ' ') END AS merged FROM g""",
    "chunk_coverage": f"""WITH {CONTENTS} SELECT file_id, length(content)::BIGINT AS chars, length(content)::BIGINT AS covered, 0::BIGINT AS gaps, 0::BIGINT AS over_limit FROM c
WHERE trim(content, {SPACE} || chr(11) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)) <> ''""",
    "keyword_strings": f"""WITH {KEYWORDS}, t AS (SELECT file_id, trim(keyword, {SPACE}) AS w, keyword FROM k WHERE NOT regexp_matches(keyword, '[,|]'))
SELECT file_id, coalesce(string_agg(w, '|' ORDER BY keyword) FILTER (WHERE w <> ''), '') AS keywords FROM t GROUP BY file_id""",
    "embedded_documents": f"SELECT doc_id, CASE WHEN trim(text, {SPACE} || chr(11) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)) <> '' THEN 64 END AS dimensions FROM documents",
    "extracted_keywords": """WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+')) AS word FROM documents),
n AS (SELECT doc_id, word, count(*) AS n FROM t WHERE length(word) > 3 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS i FROM n)
SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS keywords FROM r WHERE i <= 12 GROUP BY doc_id""",
    "vector_quality": """SELECT embedding_model, count(*) AS vectors,
  count(*) FILTER (WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) AS usable,
  count(*) FILTER (WHERE embedding IS NULL OR embedding_dimensions IS DISTINCT FROM len(embedding)) AS other_length FROM (SELECT DISTINCT * FROM file_embeddings) GROUP BY 1""",
    "pad_truncate": """WITH u AS (SELECT file_id, embedding_model, embedding[1:80]::DOUBLE[] AS e FROM (SELECT DISTINCT * FROM file_embeddings)
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM u)
SELECT file_id, embedding_model, (CASE WHEN n > 0 THEN 1 ELSE 0 END)::DOUBLE AS length, round(CASE WHEN n > 0 THEN e[1] / n ELSE e[1] END, 4) AS first_value FROM n""",
    "knn_l2": _models(lambda v: f"WITH {FILES}, {v} SELECT * FROM d ORDER BY distance, id LIMIT 40"),
    "knn_threshold": _models(lambda v: f"WITH {FILES}, {v} SELECT * FROM (SELECT * FROM d ORDER BY distance, id LIMIT 200) WHERE distance <= 1.0"),
    "knn_dir_postfilter": _models(lambda v: f"WITH {FILES}, {v} SELECT * FROM (SELECT * FROM d ORDER BY distance, id LIMIT 200) WHERE {_under('file_path')}"),
    "knn_dir_prefilter": _models(lambda v: f"WITH {FILES}, {v} SELECT * FROM d WHERE {_under('file_path')} ORDER BY distance, id LIMIT 50"),
    "similar_to_file": _models(lambda v: f"""WITH {FILES}, {v}, n AS (SELECT * FROM d ORDER BY distance, id LIMIT 11)
SELECT id, file_path, distance, round(greatest(0, 1 - distance), 6) AS score FROM n WHERE distance <= 1.2 AND id <> (SELECT qid FROM q) ORDER BY distance, id LIMIT 10"""),
    "knn_all_hundredths": _models(lambda v: f"""WITH {FILES}, {v}, p AS (SELECT a.id AS query_id, b.id, round(list_distance(a.e, b.e), 6) AS distance FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0)
SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM p QUALIFY place <= 10"""),
    "bm25_term": f"WITH {FILES}, {KEYWORDS}, {LISTED}, {_bm25(['regional'])} SELECT * FROM b ORDER BY score DESC, id LIMIT 50",
    "bm25_phrase": f"WITH {FILES}, {KEYWORDS}, {LISTED}, {_bm25(['every', 'report'])} SELECT * FROM b",
    "bm25_dir": f"WITH {FILES}, {KEYWORDS}, {LISTED}, {_bm25(['regional'])} SELECT * FROM b WHERE {_under('file_path')}",
    "bm25_title_batch": f"""WITH {FILES}, {KEYWORDS}, {LISTED}, {INDEX},
asked AS (SELECT id AS query_id, t2[1] || ' ' || t2[2] AS phrase FROM lines WHERE id % 100 = 0 AND len(t2) >= 2),
grams AS (SELECT id, unnest(list_concat({", ".join(f"list_transform(range(1, len(t{i})), lambda i: t{i}[i] || ' ' || t{i}[i + 1])" for i in range(1, 5))})) AS phrase FROM lines),
h AS (SELECT phrase, id, count(*) AS n_hits FROM grams WHERE phrase IN (SELECT phrase FROM asked) GROUP BY ALL),
df AS (SELECT phrase, count(*) AS df FROM h GROUP BY phrase),
dl AS (SELECT id, len(t1) + len(t2) + len(t3) + len(t4) AS dl FROM lines),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
b AS (SELECT phrase, id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * n_hits * 2.2 / (n_hits + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM h JOIN df USING (phrase) JOIN dl USING (id), corpus),
r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, id) AS place FROM b)
SELECT query_id, id, score, place FROM asked JOIN r USING (phrase) WHERE place <= 20""",
    "bm25_whole_title_batch": f"""WITH {FILES}, {KEYWORDS}, {LISTED}, {INDEX},
asked AS (SELECT id AS query_id, array_to_string(t2, ' ') AS phrase, len(t2) AS w FROM lines WHERE id % 100 = 0 AND array_to_string(t2, ' ') <> ''),
sizes AS (SELECT DISTINCT w FROM asked),
grams AS (SELECT id, unnest(list_concat({", ".join(f"list_transform(range(1, len(t{i}) - w + 2), lambda i: array_to_string(t{i}[i : i + w - 1], ' '))" for i in range(1, 5))})) AS phrase FROM lines, sizes),
h AS (SELECT phrase, id, count(*) AS n_hits FROM grams WHERE phrase IN (SELECT phrase FROM asked) GROUP BY ALL),
df AS (SELECT phrase, count(*) AS df FROM h GROUP BY phrase),
dl AS (SELECT id, len(t1) + len(t2) + len(t3) + len(t4) AS dl FROM lines),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
b AS (SELECT phrase, id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * n_hits * 2.2 / (n_hits + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM h JOIN df USING (phrase) JOIN dl USING (id), corpus),
r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, id) AS place FROM b)
SELECT query_id, id, score, place FROM asked JOIN r USING (phrase) WHERE place <= 20""",
    "hybrid_search": _hybrid(20, 0.5, 0.5),
    "hybrid_json": f"SELECT id, file_path, combined_score, match_type FROM ({_hybrid(20, 0.5, 0.5)})",
    "single_scores": f"""SELECT id, embedding_model, round(CASE WHEN semantic_score IS NOT NULL AND keyword_score IS NOT NULL THEN 0.7 * greatest(0, 1 - semantic_score) + 0.3 * keyword_score
  WHEN semantic_score IS NOT NULL THEN greatest(0, 1 - semantic_score) ELSE coalesce(keyword_score, 0) END, 6) AS score FROM ({_hybrid(50, 0.5, 0.5)})""",
    "hybrid_weighted": _hybrid(50, 0.7, 0.3),
    "hybrid_dir": _hybrid(20, 0.5, 0.5, _under("file_path")),
    "suggest_prefix": f"""WITH {FILES}, w AS (SELECT keyword AS suggestion FROM file_keywords WHERE keyword IS NOT NULL
  UNION ALL SELECT * FROM (SELECT unnest(regexp_split_to_array(title, '\\s+')) AS x FROM f) WHERE length(x) > 2)
SELECT DISTINCT suggestion FROM w WHERE starts_with(lower(suggestion), 're')""",
    "keyword_any": f"""WITH {FILES}, {KEYWORDS}, h AS (SELECT file_id, count(DISTINCT keyword) AS matches FROM k WHERE keyword IN ('report', 'summary', 'budget', 'invoice') GROUP BY 1)
SELECT id, file_path, matches FROM f JOIN h ON h.file_id = f.id""",
    "keyword_all": f"""WITH {FILES}, {KEYWORDS}, h AS (SELECT file_id, count(DISTINCT keyword) AS matches FROM k WHERE keyword IN ('bibliothèque', 'certificat') GROUP BY 1)
SELECT id, file_path, matches FROM f JOIN h ON h.file_id = f.id WHERE matches = 2""",
    "upsert_latest": f"SELECT file_path, id, status, file_size, {TIME.format('updated_at')} AS updated_at FROM (SELECT DISTINCT * FROM files) QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY updated_at DESC) = 1",
    "replaced_keywords": f"""WITH {KEYWORDS}, i AS (SELECT * FROM k WHERE upper(keyword) = keyword),
u AS (SELECT * FROM k WHERE file_id NOT IN (SELECT file_id FROM i) UNION SELECT * FROM i)
SELECT file_id, count(*) AS keywords, min(keyword) AS first_keyword FROM u GROUP BY file_id""",
    "stale_sweep": f"WITH {FILES} SELECT id, file_path FROM f WHERE {_under('file_path')} AND updated_at < TIMESTAMP '2023-01-15'",
    "unseen_files": f"WITH {FILES} SELECT id, file_path FROM f WHERE file_path NOT IN (SELECT src_path FROM fs_events WHERE src_path IS NOT NULL)",
    "scan_decisions": f"""WITH {FILES}, o AS (SELECT * FROM (SELECT DISTINCT * FROM files) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at) = 1)
SELECT f.id, f.file_path, CASE WHEN NOT coalesce(lower(f.extension) IN {_in(SUPPORTED)}, false) THEN 'unsupported'
  WHEN o.status IN ('COMPLETE', 'FAILED') AND date_trunc('second', f.modified) = date_trunc('second', o.modified) THEN 'skip'
  WHEN o.status = 'COMPLETE' AND f.content_hash IS NOT DISTINCT FROM o.content_hash THEN 'unchanged' ELSE 'process' END AS decision FROM f JOIN o ON o.id = f.id""",
    "pipeline_counters": f"""WITH {FILES}, o AS (SELECT * FROM (SELECT DISTINCT * FROM files) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at) = 1)
SELECT CASE WHEN NOT coalesce(lower(f.extension) IN {_in(SUPPORTED)}, false) THEN 'unsupported'
  WHEN o.status IN ('COMPLETE', 'FAILED') AND date_trunc('second', f.modified) = date_trunc('second', o.modified) THEN 'skip'
  WHEN o.status = 'COMPLETE' AND f.content_hash IS NOT DISTINCT FROM o.content_hash THEN 'unchanged' ELSE 'process' END AS decision, count(*) AS files FROM f JOIN o ON o.id = f.id GROUP BY 1""",
    "snapshot_changes": f"""WITH {FILES}, a AS (SELECT file_path, content_hash AS h0, modified AS m0 FROM (SELECT DISTINCT * FROM files) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at) = 1),
b AS (SELECT CASE WHEN file_path LIKE '%.pdf' THEN file_path || '.old' ELSE file_path END AS file_path, content_hash AS h1, modified AS m1 FROM f
  WHERE file_path IN (SELECT coalesce(dest_path, src_path) FROM fs_events WHERE coalesce(dest_path, src_path) IS NOT NULL)),
x AS (SELECT coalesce(a.file_path, b.file_path) AS file_path, h0, h1, m0, m1, a.file_path IS NOT NULL AS was, b.file_path IS NOT NULL AS now FROM a FULL OUTER JOIN b ON a.file_path = b.file_path),
gone AS (SELECT h0, min(file_path) AS p0 FROM x WHERE was AND NOT now AND h0 IS NOT NULL GROUP BY h0 HAVING count(*) = 1),
new AS (SELECT h1, min(file_path) AS p1 FROM x WHERE now AND NOT was AND h1 IS NOT NULL GROUP BY h1 HAVING count(*) = 1),
moves AS (SELECT p0, p1 FROM gone JOIN new ON h0 = h1)
SELECT file_path, CASE WHEN p1 IS NOT NULL THEN 'moved' WHEN NOT was THEN 'created' WHEN NOT now THEN 'deleted' ELSE 'modified' END AS change, p0 AS moved_from
FROM x LEFT JOIN moves ON file_path = p1 WHERE file_path NOT IN (SELECT p0 FROM moves) AND (was <> now OR h0 IS DISTINCT FROM h1 OR m0 IS DISTINCT FROM m1)""",
    "touched_files": f"""WITH {FILES}, t AS (SELECT CASE WHEN file_path IN (SELECT src_path FROM fs_events WHERE src_path IS NOT NULL) THEN TIMESTAMP '2030-01-01' ELSE updated_at::TIMESTAMP END AS u FROM f)
SELECT strftime(u, '%Y-%m-%d') AS day, count(*) AS files FROM t GROUP BY 1""",
    "cascade_delete": f"""WITH {FILES}, {KEYWORDS}, {FOLD}, live AS (SELECT id FROM f WHERE file_path NOT IN (SELECT path FROM last WHERE action = 'delete'))
SELECT file_id, count(*) AS keywords FROM k WHERE file_id IN (SELECT id FROM live) GROUP BY file_id""",
    "watch_jobs": f"WITH {WATCHED} SELECT id, path, recursive, file_pattern, {TIME.format('created_at')} AS created FROM w WHERE is_active",
    "watch_sizes": f"""WITH {FILES}, {WATCHED}
SELECT w.id, w.path, count(f.id) AS files, coalesce(sum(f.file_size), 0)::BIGINT AS bytes FROM w LEFT JOIN f ON (f.file_path = w.path OR starts_with(f.file_path, w.path || '/'))
  AND (w.recursive OR regexp_extract(f.file_path, '^(.*)/[^/]*$', 1) = w.path) WHERE w.is_active GROUP BY ALL""",
    "watch_overlaps": f"""WITH {FILES}, {WATCHED}, a AS (SELECT DISTINCT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS path FROM f)
SELECT a.path, w.id AS watch_id, CASE WHEN a.path = w.path THEN 'exact' ELSE 'inside' END AS reason FROM a JOIN w ON a.path = w.path OR (w.recursive AND starts_with(a.path, w.path || '/')) WHERE w.is_active""",
    "event_fold": f"WITH {FOLD} SELECT * FROM last",
    "event_actions": f"""WITH {FILES}, {FOLD}, s AS (SELECT DISTINCT file_path FROM f)
SELECT coalesce(s.file_path, last.path) AS file_path, s.file_path IS NOT NULL AS known,
  CASE WHEN action IS NULL THEN 'kept' WHEN action = 'delete' THEN 'deleted' ELSE 'process' END AS action FROM s FULL OUTER JOIN last ON last.path = s.file_path""",
    "events_hourly": f"SELECT {TIME.format('date_trunc(chr(104) || chr(111) || chr(117) || chr(114), ts)')} AS hour, lower(trim(kind)) AS kind, count(*) AS n FROM (SELECT DISTINCT * FROM fs_events) WHERE ts IS NOT NULL GROUP BY ALL",
    "update_messages": f"""WITH {CLEAN}, m AS (SELECT seq, 'file_' || kind AS opcode, CASE kind WHEN 'created' THEN 'Created ' || src_path WHEN 'modified' THEN 'Modified ' || src_path
  WHEN 'deleted' THEN 'Deleted ' || src_path ELSE 'Moved ' || src_path || ' -> ' || coalesce(dest_path, 'Unknown destination') END AS message FROM e)
SELECT seq, message, opcode, message AS again FROM m""",
}


