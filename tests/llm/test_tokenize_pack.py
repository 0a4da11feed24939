from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliodex.llm import pack, tokenize

PATH = f"{tokenize.TOKENIZERS}/{tokenize.VOCABULARY}"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return tokenize.Encoder(PATH)


ODD = ["", " ", "a", "<|endoftext|> x", "aaaa" * 500, "=-=" * 300, "It's we'll I'd 'sx", "​​ a", " 　 \xa0a", "\x1c\x1d a", "é é", "👩‍👩‍👧 flag 🇩🇪", "\r\n\r\n\t x", "١٢٣ ½ Ⅷ", "漢字かな交じり文", "\x00\x7f", "z" * 20_000]


@pytest.mark.parametrize("text", ODD)
def test_same_as_library(encoder, reference, text):
    ids, n = encoder.encode([text])
    assert ids.tolist() == reference(text) and n.tolist() == [len(ids)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_same_as_library_on_any_text(text):
    enc, ref = _pair()
    assert enc.encode([text])[0].tolist() == ref(text)


def test_long_texts_in_parts(encoder, reference, monkeypatch):
    monkeypatch.setattr(tokenize, "SLICE", 40)
    rng = random.Random(9)
    for _ in range(30):
        text = "".join(rng.choice(["word", " ", "  ", "\n", "\r\n ", "it's", "9", "…", "x" * 60, "\u3000"]) for _ in range(200))
        assert encoder.encode(["a", text, ""])[0].tolist() == reference("a") + reference(text)


_kept = []


def _pair():
    if not _kept:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(PATH)
        t.encode_special_tokens = True
        _kept.extend([tokenize.Encoder(PATH), lambda text: t.encode(text, add_special_tokens=False).ids])
    return _kept


def test_exact_merges_equal_the_verified_way(encoder, reference):
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 30)))
        assert encoder.vocabulary.exact(word.encode()) == reference(word)


def test_rows(spark, reference):
    rows = [(1, None, "x"), (2, "", "x"), (3, "some text", "x"), (3, "some text", "x"), (None, "text", "x"), (5, "<|endoftext|>", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] or 0), r["ids"]) for r in tokenize.token_ids(df, "doc_id", "text").collect())
    assert got == sorted((a or 0, reference(t) if t else []) for a, t, _ in rows)
    assert tokenize.token_ids(df.limit(0), "doc_id", "text").count() == 0


def test_whole_small_table(spark, small, reference):
    df = spark.read.parquet(f"{small}/documents.parquet")
    want = {r["doc_id"]: reference(r["text"] or "") for r in df.collect()}
    assert {r["doc_id"]: r["ids"] for r in tokenize.token_ids(df, "doc_id", "text").collect()} == want


def check_packed(rows, sizes, capacity):
    """Every token is in one container, none is over-full, full pieces come first."""
    got, load = {}, {}
    for r in rows:
        got.setdefault(r["k"], []).append((r["piece"], r["n_tokens"]))
        if r["n_tokens"]:
            load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
        else:
            assert r["container"] is None
    for k, n in sizes.items():
        parts = sorted(got[k])
        assert sum(m for _, m in parts) == n and [p for p, _ in parts] == list(range(len(parts)))
        assert all(m == capacity for _, m in parts[:-1])
    assert all(n <= capacity for n in load.values())
    return load


def test_pack(spark, words):
    rng = random.Random(1)
    rows = [(i, words(int(rng.paretovariate(0.8) * 4) % 900, i)) for i in range(600)] + [(900, None), (901, ""), (902, words(40, 2)), (903, words(40, 2)), (904, words(3000, 9))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "k long, text string, size int, container int")
    enc = tokenize.Encoder(PATH)
    sizes = {i: len(enc.encode([t])[0]) for i, t in rows}
    found = pack.pack(df, "k", "text", capacity=256).collect()
    load = check_packed(found, sizes, 256)
    assert len(load) <= 1.02 * sum(sizes.values()) / 256 + 2
    assert pack.pack(df.limit(0), "k", "text").count() == 0
    again = pack.pack(df.repartition(3), "k", "text", capacity=256).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))  # the same however the rows lie


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=400))
def test_plans_fill_containers(sizes):
    capacity = 64
    histogram = sorted({s: sizes.count(s) for s in sizes}.items(), reverse=True)
    in_order = sorted(sizes, reverse=True)
    large, rest, used = pack.plan_large(histogram, capacity)
    load, seen = {}, set()
    for first, n, q, c in large:
        for i in range(n):
            load[c + i // q] = load.get(c + i // q, 0) + in_order[first + i]
            seen.add(first + i)
    room = {}
    for c, total in sorted(load.items()):
        room.setdefault(capacity - total, []).append(c)
    assert set(load) == set(range(used))
    small = pack.plan_small(rest, [(r, len(c)) for r, c in room.items()], capacity, used)
    for first, n, q, kind, slot in small:
        for i in range(n):
            c = slot + i // q if kind == -1 else room[kind][slot + i // q]
            load[c] = load.get(c, 0) + in_order[first + i]
            assert first + i not in seen
            seen.add(first + i)
    assert seen == set(range(len(sizes))) and max(load.values()) <= capacity
    assert len(load) <= 1.7 * max(1, -(-sum(sizes) // capacity)) + 1


def test_configurations_cover_no_more_than_asked():
    chosen = pack.configurations([50, 34, 20], [100, 70, 300], 100)
    left = np.array([100, 70, 300])
    for column, times in chosen:
        assert np.dot(column, [50, 34, 20]) <= 100
        left -= np.array(column) * times
    assert (left >= 0).all() and left.sum() <= 30
