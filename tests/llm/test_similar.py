from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliodex.llm import knn, neardup, spans


def sets(rows, n=3):
    out = {}
    for k, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if k is not None and len(w) >= n:
            out[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return out


def test_near_duplicates_against_brute_force(spark, words):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        base = words(rng.randint(3, 120), i).split()
        for v in range(rng.randint(1, 4)):
            edited = [w for w in base if rng.random() > 0.03 * v]
            if rng.random() < 0.3:
                edited.insert(rng.randrange(len(edited) + 1), "new")
            rows.append((len(rows), " ".join(edited)))
    rows += [(500, None), (501, ""), (502, "two words"), (503, rows[0][1]), (504, rows[0][1].upper().replace(" ", ", ")), (505, words(40_000, 1)), (506, words(40_000, 1) + " end"), (None, rows[0][1])]
    df = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in rows], "k long, t string, a int, b int, class string")
    members, links = neardup.near_duplicates(df.unionByName(df.limit(5)), "k", "t")
    got = [(r["a"], r["b"]) for r in neardup.expanded(members, links).collect()]
    s = sets(rows)
    want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.7 * len(s[a] | s[b]) - 1e-9}
    assert len(got) == len(set(got)) and set(got) == want
    assert {r["key"] for r in members.collect()} == set(s)
    none = neardup.near_duplicates(df.limit(0), "k", "t")
    assert neardup.expanded(*none).count() == 0


@pytest.mark.parametrize("members", [2, 5, 40])
def test_texts_that_share_a_template(spark, words, monkeypatch, members):
    monkeypatch.setattr(neardup, "MEMBERS", members)  # nearly all bands and many shingles are in more texts
    rng = random.Random(7)
    template = words(60, 77).split()
    rows = []
    for i in range(150):
        own = words(rng.choice([5, 20, 40, 90]), 200 + i // 2).split()
        if i % 2:
            own = [w for w in own if rng.random() > 0.05]
        part = template[: rng.choice([0, 20, 60])]
        rows.append((i, " ".join(own[: len(own) // 2] + part + own[len(own) // 2 :])))
    df = spark.createDataFrame(rows, "k long, t string")
    got = {(r["a"], r["b"]) for r in neardup.expanded(*neardup.near_duplicates(df, "k", "t")).collect()}
    s = sets(rows)
    assert got == {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.7 * len(s[a] | s[b]) - 1e-9}


def prints(texts):
    runs, counts = zip(*((np.array(sorted(t), np.uint64), len(t)) for t in texts))
    return np.stack([np.frombuffer(p.tobytes(), np.uint64) for p in neardup.fingerprints(neardup.minima(np.concatenate(runs), np.array(counts)))])


def alike(rng, share, size=200):
    """Two sets of a similarity of ``share``."""
    both = round(2 * size * share / (1 + share))
    pool = rng.integers(0, 2**63, 2 * size, np.uint64).tolist()
    return set(pool[:size]), set(pool[size - both : 2 * size - both])


def test_coordinates_discard_what_is_far_and_keep_what_is_similar():
    rng = np.random.default_rng(3)
    groups = [alike(rng, s) for s in (0.7, 0.3) for _ in range(150)]
    table = neardup.distance_table(prints([t for g in groups for t in g]), np.arange(0, 600, 2), np.full(300, 2))
    apart = np.abs(table[::2] - table[1::2]).max(1)
    within = neardup.radius(0.7)
    assert (apart[:150] <= within).all() and (apart[150:] > within).mean() > 0.95


def test_coordinates_differ_by_no_more_than_the_distance():
    rng = np.random.default_rng(4)
    p = rng.integers(0, 2**63, (40, 4), np.uint64)
    table = neardup.distance_table(p, np.array([0]), np.array([40]))
    apart = np.abs(table[:, None] - table[None]).max(2)
    exact = np.bitwise_count(p[:, None] ^ p[None]).sum(2)
    assert (apart <= exact).all() and (apart[:16] == exact[:16]).all()


def test_radius_is_missed_as_rarely_as_stated():
    rng = np.random.default_rng(6)
    distance = rng.binomial(neardup.BITS, 0.15, 3_000_000)
    assert (distance > neardup.radius(0.7)).sum() <= 12 and (distance > neardup.radius(0.7) - 8).sum() > 12


def sketched(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string").withColumn("version", F.lit(None).cast("long")).withColumn("tie", F.lit(0).cast("long"))
    return neardup.sketch(rows.select("key", "version", "tie", "text"), 3), rows.select("key", "text")


def test_tables_discard_most_pairs_that_only_meet(spark, words):
    texts = []
    for i in range(60):  # half of each text is the same, so some bands are, and no pair is similar
        texts.append(words(70, 5) + " " + words(70, 900 + i))
    sketch, sources = sketched(spark, texts)
    met = neardup.candidates(sketch, sources, 3, 0.7, neardup.BITS).count()
    assert met > 200 and neardup.candidates(sketch, sources, 3, 0.7).count() < 0.2 * met


def test_candidates_of_a_template_stay_level(spark, words):
    each = {}
    for n in (150, 600):
        texts = [words(32, 5) + " " + words(70, 10_000 + i) for i in range(n)]
        each[n] = neardup.candidates(*sketched(spark, texts), 3, 0.7).count() / n
    assert each[600] <= 2 * each[150] + 0.1


def test_versions_that_tie(spark, words):
    rows = [(1, 1, words(50, 1)), (1, 1, words(50, 2)), (1, 1, None), (2, 1, words(50, 1)), (3, 1, words(50, 2))]
    df = spark.createDataFrame(rows, "k long, v int, t string")
    pairs = neardup.expanded(*neardup.near_duplicates(df, "k", "t", "v")).collect()
    assert len(pairs) == 1 and pairs[0]["a"] == 1


def test_only_the_newest_version_counts(spark, words):
    rows = [(1, 1, words(50, 1)), (1, 2, words(50, 2)), (2, 1, words(50, 1)), (3, 5, words(50, 2)), (4, 1, words(50, 1)), (4, 2, None)]
    df = spark.createDataFrame(rows, "k long, v int, t string")
    pairs = neardup.expanded(*neardup.near_duplicates(df, "k", "t", "v")).collect()
    assert [(r["a"], r["b"]) for r in pairs] == [(1, 3)]


def brute_spans(texts, least):
    where = {}
    for k, t in texts:
        for i in range(len(t or "") - least + 1):
            where.setdefault(t[i : i + least], set()).add(k)
    found = set()
    for k, t in texts:
        t = t or ""
        held = [False] * len(t)
        for i in range(len(t) - least + 1):
            if len(where[t[i : i + least]]) > 1:
                held[i : i + least] = [True] * least
        start = None
        for i, h in enumerate([*held, False]):
            if h and start is None:
                start = i
            if not h and start is not None:
                found.add((k, start, i))
                start = None
    return found


@pytest.mark.parametrize("seed", range(3))
def test_shared_spans_against_brute_force(spark, words, seed):
    rng = random.Random(seed)
    shared = [words(60, 1000 + i)[: rng.randint(150, 320)] for i in range(5)]
    texts = []
    for i in range(40):
        t = words(rng.randint(0, 60), 10 * seed + i)
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(shared)
            a = rng.randint(0, 30)
            at = rng.randrange(len(t) + 1)
            t = t[:at] + p[a : a + rng.randint(100, 300)] + t[at:]
        texts.append((i, t))
    texts += [(100, shared[0]), (101, shared[0]), (102, "ab" * 400), (103, "xy" + "ab" * 300), (104, None), (105, ""), (106, "é" * 200 + shared[1]), (107, "ü" + shared[1] * 2), (108, "q" * 149)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in texts], "doc_id long, text string, low int, digest int")
    got = [tuple(r) for r in spans.shared_spans(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(texts, 150)
    twice = df.unionByName(df.where("doc_id < 9")).unionByName(df.where("doc_id = 100").withColumn("doc_id", F.lit(3).cast("long")))
    both = {tuple(r) for r in spans.shared_spans(twice, "doc_id", "text").collect()}
    assert both >= {r for r in brute_spans(texts, 150) if r[0] != 3} and (3, 0, len(shared[0])) in both
    part = {r["doc_id"]: r["shared_chars"] for r in spans.shared_part(df, "doc_id", "text").collect()}
    assert part[100] == len(shared[0]) and part[104] == 0 and len(part) == len(texts)
    assert spans.shared_spans(df.limit(0), "doc_id", "text").count() == 0


def test_parts_of_long_texts(spark, words, monkeypatch):
    monkeypatch.setattr(spans, "PART", 500)
    texts = [(1, words(400, 1)), (2, words(10, 2) + words(400, 1)[300:2000]), (3, words(300, 3))]
    found = []
    for rows, offsets, parts in spans._parts([1, 2, 3], [t for _, t in texts], 150):
        found += [(r, o + i) for r, o, p in zip(rows, offsets, parts) for i in range(len(p) - 149)]
    assert sorted(found) == [(r, i) for r, (_, t) in enumerate(texts) for i in range(len(t) - 149)]


def brute_neighbours(rows, k, least, dims):
    kept = {}
    for key, model, v in rows:
        if key is None or model not in dims or not v:
            continue
        v = (v + [0.0] * dims[model])[: dims[model]]
        if all(x is not None and np.isfinite(x) for x in v) and any(v):
            kept[model, key] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for (m, a), x in kept.items():
        near = sorted((-round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 6), b) for (n, b), y in kept.items() if n == m and b != a)
        out[m, a] = [(b, -s) for s, b in near if -s >= least][:k]
    return out


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(knn, "bin_size", lambda n: 40)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 6))
    rows = [(i, "m6", (centers[rng.integers(12)] + rng.normal(size=6) * 0.3).tolist()) for i in range(500)]
    rows += [(1000 + i, "m6", [1.0, 2, 3, 4, 5, 6]) for i in range(40)]  # equal vectors
    rows += [(2000 + i, "m4", rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(3000, "m6", None), (3001, "m6", []), (3002, "m6", [0.0] * 6), (3003, "m6", [float("nan")] * 6), (3004, "m6", [1.0, 2.0]), (3005, "m6", [1.0, 2, 3, 4, 5, 6, 99]), (3006, "other", [1.0] * 6), (None, "m6", [1.0] * 6), (3007, None, [1.0] * 6), (3008, "m6", [1.0, 2.0])]
    dims = {"m6": 6, "m4": 4}
    rows = [(k, m, [float(x) for x in v] if v is not None else None) for k, m, v in rows]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "key long, model string, vec array<float>, bin int, entry string")
    df = df.unionByName(df.limit(20))
    found = knn.neighbours(df, "key", "model", "vec", 5, 0.8, dims)
    got = {}
    for r in found.collect():
        got.setdefault((r["model"], r["key"]), []).append((r["place"], r["neighbour"], r["cosine"]))
    want = brute_neighbours(rows, 5, 0.8, dims)
    hits = sum(len({n for _, n, _ in got.get(q, [])} & {n for n, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near in got.items():
        assert len(near) <= 5 and all(c >= 0.8 for *_, c in near) and [p for p, *_ in sorted(near)] == list(range(1, len(near) + 1))
    assert [n for _, n, _ in sorted(got["m6", 1010])] == [1000, 1001, 1002, 1003, 1004]  # ties by key
    assert ("m6", 3005) in got and ("m6", 3008) in got and ("m6", 3003) not in got
    assert knn.recall(df, found, "key", "model", "vec", 5, 0.8, dims, modulus=1) >= 0.9
    assert knn.neighbours(df.limit(0), "key", "model", "vec", dimensions=dims).count() == 0


def test_nearest_equals_double_precision():
    rng = np.random.default_rng(5)
    b = rng.normal(size=(3000, 8))
    b[1000:1040] = b[5] + rng.normal(size=(40, 8)) * 1e-7  # a crowd of ties
    b[2000] = b[7] * 3
    a = np.concatenate([b[:300], rng.normal(size=(50, 8))])
    q, c, s = knn.nearest(a, b, 6, 700_000)
    scores = knn._cosines(a, b)
    for i in range(len(a)):
        best = sorted((-x, j) for j, x in enumerate(scores[i].tolist()) if x >= 700_000)[:6]
        assert [(-x, j) for x, j in zip(s[q == i].tolist(), c[q == i].tolist())] == best
    assert all(len(x) == 0 for x in knn.nearest(a[:0], b, 6, 0))


def test_tree_visits_every_bin_once():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(800, 5))
    tree = knn.fit_tree(points, 20)
    bins = np.flatnonzero(tree.count == 0)
    order, apart = tree.visits(points[:50], len(bins))
    assert all(sorted(row) == sorted(bins) for row in order.tolist())
    assert np.allclose(apart, ((tree.centroids[order] - points[:50, None]) ** 2).sum(2))
    few = tree.visits(points[:50], 4)[0]
    assert (few == order[:, :4]).all()
    assert np.mean([b in row for b, row in zip(tree.bin_of(points[:50]), few)]) > 0.9
    row, met = tree.near_bins(points[:50], 4, 1.2)
    near = {(i, b) for i in range(50) for b, d in zip(few[i].tolist(), apart[i].tolist()) if d <= 1.44 * apart[i, 0]}
    assert set(zip(row.tolist(), met.tolist())) == near and 50 <= len(near) < 200
