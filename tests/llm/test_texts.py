from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliodex.llm import company, frequency, scans, split


@pytest.mark.parametrize("n_most", [0, 1, 2, 5])
def test_block_counts_against_brute_force(n_most):
    rng = random.Random(1)
    for _ in range(30):
        values = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(30)]
        records = np.array([rng.randint(0, 5) for _ in values])
        again = [rng.randrange(30) for _ in range(25)]  # rows that repeat, some of them in one record
        values, records = values + [values[i] for i in again], np.append(records, records[again])
        grams, n, d = frequency.block_counts(values, records, n_most, not n_most)
        count, held = Counter(), defaultdict(set)
        for v, r in zip(values, records.tolist()):
            x = v.split()
            for g in [v] if not n_most else [" ".join(x[i : i + k]) for k in range(1, n_most + 1) for i in range(len(x) - k + 1)]:
                count[g] += 1
                held[g].add(r)
        assert dict(zip(grams, n.tolist())) == count
        assert dict(zip(grams, d.tolist())) == {g: len(r) for g, r in held.items()}
        assert d.sum() < n.sum()  # neighbours of one record were there to be subtracted


@pytest.mark.parametrize("block", [7, 50, 300_000])
def test_terms(spark, monkeypatch, block):
    rng = random.Random(4)
    rows = [(rng.randint(1, 9), rng.choice(["Red Car", "red  car", " blue", "BLUE\n", "été", "été", "x"])) for _ in range(200)]
    rows += [(5, f"many words {i}") for i in range(60)]  # one record larger than a block
    rows += [(None, "x"), (1, None), (2, " \t"), (3, "")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "id long, kw string, term string, n int")
    monkeypatch.setattr(frequency, "BLOCK", block)
    monkeypatch.setattr(frequency, "SHARES", 5)
    import unicodedata

    clean = [(r, " ".join(unicodedata.normalize("NFC", v).lower().split())) for r, v in rows if r is not None and v and v.split()]
    total = len({r for r, _ in clean})
    count, held = Counter(v for _, v in clean), defaultdict(set)
    for r, v in clean:
        held[v].add(r)
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in frequency.marked_terms(df, "id", "kw").collect()}
    mark = lambda n: "rare" if n <= 2 else "common" if n >= 0.06 * total else None
    assert got == {v: (n, len(held[v]), mark(len(held[v]))) for v, n in count.items()}
    assert frequency.marked_terms(df.limit(0), "id", "kw").count() == 0


def test_pieces_hold_everything():
    rng = random.Random(6)
    texts = ["x" * 9000, ("word " * 3000).strip(), ". ".join("s" * rng.randint(1, 300) for _ in range(90)), "\n\n".join("p" * rng.randint(1, 3999) for _ in range(9)), "\n" * 5000, "é" * 4001, "a b\r\n \r\nc. d! " * 600]
    texts += ["\n".join(rng.choice(["", " " * rng.randint(1, 4500), "w" * rng.randint(1, 4200), "a. " * rng.randint(1, 900), "b c " * rng.randint(1, 1200)]) for _ in range(12)) for _ in range(60)]
    for t in texts:
        found = split.pieces(t)[1]
        assert "".join(t[b:c] for _, b, c in found) == t
        assert all(c - a <= 4000 and 0 <= b - a <= 200 for a, b, c in found) and all(a < b or c - b == 4000 for a, b, c in found[1:])


def test_cuts_come_at_paragraphs_if_these_fit():
    t = "\n\n".join("one sentence. " * 60 for _ in range(12))
    for _, start, _ in split.pieces(t)[1][1:]:
        assert t[:start].endswith("\n\n")


@pytest.mark.parametrize("t, unit", [("a" * 10, "paragraph"), ("a. " * 2000, "sentence"), ("a " * 4000, "word"), ("a" * 4001, "none"), ("b" * 4000 + "\n \t\n" + "c" * 4000, "paragraph"), ("  " + "b" * 4000 + "  ", "paragraph"), ("b" * 3999 + "! " + "c" * 4000, "sentence")])
def test_finest(t, unit):
    assert split.pieces(t)[0] == unit


def test_the_merge_decides_the_finest_unit(monkeypatch):
    t = "\n\n".join(". ".join(["some words"] * 90) for _ in range(9))
    assert split.pieces(t)[0] == "paragraph"
    monkeypatch.setattr(split.heapq, "heapify", lambda heap: heap.clear())  # nothing is merged
    assert split.pieces(t)[0] == "sentence"


def test_finest_against_its_definition():
    def unit(t):
        paragraphs = split._paragraph.split(t)
        sentences = [s for p in paragraphs for s in split._sentence.split(p.strip(split.SPACE))]
        words = [w for s in sentences for w in split._word.split(s)]
        fits = [all(len(x.strip(split.SPACE)) <= 40 for x in parts) for parts in (paragraphs, sentences, words)]
        return next((name for name, ok in zip(("paragraph", "sentence", "word"), fits) if ok), "none")

    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice(["a" * rng.randint(1, 12), "b" * rng.randint(30, 45), " ", ". ", "! ", "\n\n", "\n \n", " " * rng.randint(30, 50), "\n"]) for _ in range(rng.randint(5, 30)))
        if len(t) > 40:
            assert split.pieces(t, 40, 5)[0] == unit(t)


def test_split_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 4000), (4, "y" * 4001), (4, "y" * 4001)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "id long, t string, piece int, a string")
    got = sorted((r["id"], r["piece"], len(r["piece_text"])) for r in split.split_pieces(df, ["id"], "t").collect())
    assert got == [(4, 0, 3800), (4, 0, 3800), (4, 1, 401), (4, 1, 401)]
    assert split.split_pieces(df.limit(0), ["id"], "t").count() == 0


PAGE = """Grand report annual

   The quick committee describes every early department of this re-
port while another engine supports the long-
term budget of our teacher. Every ma0hine stands beside the kitchen
of another customer because the statemcnt arrives.
                        - 1 -
\x0cGrand rcport annual

   Another paragraph begins here and goes on for quite some while,
as it must be long enough to fill the lines of a page. 2024-
01-05 is a date that the line has parted in two.
- 2 -"""


def test_furniture():
    lines, kinds = scans.furniture(PAGE)
    assert [k for k in kinds if k != "blank"] == ["title", "text", "text", "text", "text", "page_number", "header", "text", "text", "text", "page_number"]


@pytest.mark.parametrize("s", ["3", "- l7 -", "[ll3]", "| 3 |", "3 / 5", "Page 12", "Pagc 12", "Seite 3 von 9", "iv", "24O"])
def test_page_numbers(s):
    assert scans.is_page_number(s)


@pytest.mark.parametrize("s", ["133  216  364", "later.", "the 3 of", "Budget 2024", "a"])
def test_no_page_numbers(s):
    assert not scans.is_page_number(s)


def test_repair():
    options = {"ma0hine": [{"origin": "machine", "fit": 1.0, "vector": None}], "statemcnt": [{"origin": "statement", "fit": 1.0, "vector": None}]}
    marks, text = scans.repair(PAGE, *scans.furniture(PAGE), {"report": 9, "long-term": 9}, options, True)
    assert marks == [(3, "hyphen"), (5, "ocr"), (6, "ocr"), (7, "page_number"), (8, "header"), (13, "page_number")]
    first, second, third = text.split("\n\n")
    assert first == "Grand report annual"
    assert "of this report while" in second and "the long-term budget" in second and "machine" in second and second.endswith("statement arrives.")
    assert "2024-01-05 is a date" in third


def test_a_header_and_a_misread_word_show_a_scan():
    page = """Grand report annual

The quick committee describes every early department of this long
report while another engine supports the budget of our new teacher
\x0cGrand rcport annual
and every statemcnt stands beside the kitchen of another customer
because the machine arrives."""
    options = {"statemcnt": [{"origin": "statement", "fit": 1.0, "vector": None}]}
    marks, text = scans.repair(page, *scans.furniture(page), {}, options, False)
    assert marks == [(5, "header"), (6, "ocr")] and "every statement stands" in text
    assert scans.repair(page, *scans.furniture(page), {}, {}, False) == ([], page)  # one header alone is not enough
    page = page.replace("Grand rcport annual\n", "")
    assert scans.repair(page, *scans.furniture(page), {}, options, False)[0] == []  # nor is one word


GLYPHS = company.Misreadings({("c", "e"): 3.0, ("rn", "m"): 2.0, ("ii", "u"): 2.0, ("1", "l"): 1.5}, (0.4, 0.2), (0.1, 0.2))


def test_origins():
    assert GLYPHS.origins("statemcnt")["statement"] == 3.0 and GLYPHS.origins("rnodcrn")["modern"] == 2.0 and GLYPHS.origins("joiirna1")["journal"] == 1.5
    assert "sumrnary" not in GLYPHS.origins("sumrnary") and GLYPHS.origins("plain") == {}
    assert scans.recase("C@refully,", "carefully") == "Carefully," and scans.recase("REP0RT", "report") == "REPORT"


@pytest.mark.parametrize("seen, meant, both", [("statemcnt", "statement", ("c", "e")), ("rnodern", "modern", ("rn", "m")), ("aab", "ab", ("a", "")), ("ab", "ab", ("", "")), ("blueprmt", "blueprint", ("m", "in"))])
def test_edit(seen, meant, both):
    assert company.edit(seen, meant) == both


def test_what_is_no_misreading():
    assert company.is_misreading("c", "e", "-") and not any(company.is_misreading(a, b, "-") for a, b in (("", "r"), ("-", ""), ("o-", "o"), ("ro", "or")))


def test_one_place_apart(spark):
    words = spark.createDataFrame([(w,) for w in ("statemcnt", "kltchen", "rnodern", "ab", "kitchen", "x" * 300, "statement2")], "word string")
    often = spark.createDataFrame([("statement", 9), ("kitchen", 9), ("modern", 9), ("abc", 9)], "origin string, often long")
    got = {(r["word"], r["origin"]) for r in company.one_place_apart(words, often).collect()}
    assert got == {("statemcnt", "statement"), ("kltchen", "kitchen"), ("rnodern", "modern"), ("statement2", "statement")}


def test_vectors_are_factors_of_the_table(spark):
    rng = random.Random(2)
    nouns, verbs = [f"noun{i}" for i in range(8)], [f"verb{i}" for i in range(8)]
    counts = Counter()
    for _ in range(3000):
        n, v = rng.choice(nouns), rng.choice(verbs)
        words = ["the", n, v, "a", rng.choice(nouns), "and"]
        counts.update(company.neighbours(words, {w: i for i, w in enumerate([*nouns, *verbs, "the", "a", "and"])}))
    df = spark.createDataFrame([(w, c, n) for (w, c), n in counts.items()], "word string, near int, n long")
    model = company.fit_company(df, [*nouns, *verbs, "the", "a", "and"])
    got = {r["word"]: np.array(r["vector"]) for r in company.word_vectors(df, model).collect()}
    cosine = lambda a, b: got[a] @ got[b] / np.sqrt((got[a] @ got[a]) * (got[b] @ got[b]))
    assert cosine("noun1", "noun5") > 0.5 > cosine("noun1", "verb5") and cosine("verb0", "verb3") > 0.5
    assert model.fit_of(got["noun1"].tolist(), ["and"]) > model.fit_of(got["verb1"].tolist(), ["and"])
    none = company.fit_company(df.limit(0), [])
    assert company.word_vectors(df.limit(0), none).count() == 0 and none.fit_of([], ["the"]) == 0.0


PAIRS = "word string, origin string, v array<float>, u array<float>"


def test_misreadings_are_learned_from_all_pairs(spark):
    word = F.concat(F.lit("word"), F.translate("id", "0123456789", "abdfghijkl"))
    made = F.when(F.col("id") % 100 == 0, F.lit("1")).otherwise(F.lit("c"))  # 270 of 27,000
    meant = F.when(F.col("id") % 100 == 0, F.lit("i")).otherwise(F.lit("e"))
    pairs = spark.range(27_000).select(F.concat(word, made).alias("word"), F.concat(word, meant).alias("origin"), F.array(F.lit(1.0)).cast("array<float>").alias("v"), F.array(F.lit(1.0)).cast("array<float>").alias("u"))
    controls = spark.range(25_000).select(F.concat(word, F.lit("c")).alias("word"), F.concat(word, F.lit("e")).alias("origin"))
    got = company.learn_misreadings(pairs, controls, 300_000, 900_000, "-")
    weight = lambda n, chance: np.log((n + 0.5) / (300_000 * (chance + 0.5) / 901_000 + 0.3))
    assert got.weights == pytest.approx({("1", "i"): weight(270, 0), ("c", "e"): weight(26_730, 25_000)})


def test_unlike_company_is_that_of_all_other_words(spark):
    rng = np.random.default_rng(4)
    v, u = rng.normal(0.3, 1, (60, 5)), rng.normal(0.3, 1, (60, 5))
    u[::2] = v[::2] + rng.normal(0, 0.5, (30, 5))
    rows = [(f"stat{i:02}mcnt", f"stat{i:02}ment" if i % 3 else f"stat{i:02}mcn", v[i].tolist(), u[i].tolist()) for i in range(60)]  # a third is no misreading, but company all the same
    none = [("statemcnt", "statement", [], []), ("statemcnt", "statement", None, [1.0])]
    got = company.learn_misreadings(spark.createDataFrame(rows + none, PAIRS).repartition(3), spark.createDataFrame([], "word string, origin string"), 60, 1000, "-")
    cosines = (v / np.linalg.norm(v, axis=1)[:, None]) @ (u / np.linalg.norm(u, axis=1)[:, None]).T
    own, others = np.diag(cosines)[[i for i in range(60) if i % 3]], cosines[~np.eye(60, dtype=bool)]
    assert set(got.weights) == {("c", "e")}
    assert got.like == pytest.approx((own.mean(), own.std()), abs=1e-6) and got.unlike == pytest.approx((others.mean(), others.std()), abs=1e-6)
    empty = company.learn_misreadings(spark.createDataFrame(none, PAIRS), spark.createDataFrame([], "word string, origin string"), 0, 0, "-")
    assert empty == company.Misreadings({}, (0.3, 0.25), (0.05, 0.2))


def test_all_rare_words_of_other_texts_are_controls(spark, monkeypatch):
    asked, learn = [], scans.learn_misreadings
    monkeypatch.setattr(scans, "learn_misreadings", lambda pairs, controls, n_odd, n_controls, hyphens: asked.append(n_controls) or learn(pairs, controls, n_odd, n_controls, hyphens))
    known = spark.range(21_000).select(F.concat(F.lit("word"), "id").alias("word"), F.lit(1).cast("long").alias("clean"), F.lit(0).cast("long").alias("scan"))
    scans.links(known.select("word").limit(0), known, spark.createDataFrame([], "text string, letters string"))
    assert asked == [21_000]


def test_the_origin_that_fits_its_place():
    model = company.Company({"the": 0, "we": 1}, np.array([0.5, 0.5]), np.array([[1.0, 0.0], [0.0, 1.0]]), np.ones(2))
    options = [{"origin": "noun", "fit": 1.0, "vector": [1.0, 0.0]}, {"origin": "verb", "fit": 1.0, "vector": [0.0, 1.0]}]
    assert scans._best(options, ["the"], model) == "noun" and scans._best(options, ["we"], model) == "verb"


def test_repeated_cores_against_all_pairs():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 30))) for _ in range(60)]
    cores = Counter(base + ["".join(c if rng.random() > 0.12 else "z" for c in rng.choice(base)) for _ in range(60)])
    assert scans.repeated(cores) == {c: n > 1 or any(scans.alike(c, d) for d in cores if d != c) for c, n in cores.items()}
    assert scans.repeated(Counter()) == {}


WORDS = ["committee", "describes", "department", "engine", "statement", "kitchen", "customer", "machine", "another", "every", "between", "because"]


def run(rng, n):
    """Words of which each is followed by one of two others."""
    at, out = rng.randrange(12), []
    for _ in range(n):
        out.append(WORDS[at])
        at = (5 * at + rng.choice([1, 4])) % 12
    return out


def scanned(rng, n):
    """Page texts of frequent words, some of which are misread, and the numbers of the lines that are."""
    lines, wrong = [], set()
    for i in range(1, n + 1):
        own = run(rng, 6)
        if rng.random() < 0.3:
            at = rng.randrange(6)
            seen, meant = rng.choice([("c", "e"), ("rn", "m"), ("ii", "u"), ("1", "i")])
            if meant in own[at]:
                own[at] = own[at].replace(meant, seen, 1)
                wrong.add(i)
        lines.append(" ".join(own))
    return "\n".join(lines), wrong


def test_repair_rows(spark, monkeypatch):
    rng = random.Random(8)
    clean = [" ".join(run(rng, 80)) for _ in range(60)]
    pages = {200 + i: scanned(rng, 20) for i in range(20)}
    rows = [(i, t, "markitdown") for i, t in enumerate(clean)] + [(k, t, "ocr") for k, (t, _) in pages.items()]
    rows += [(100, PAGE, "ocr"), (101, None, "ocr"), (102, "", None), (103, "plain", None), (None, PAGE, "ocr"), (104, PAGE, None), (105, "not a page " * 30, "ocr"), (106, pages[200][0] + "\n" + " ".join(WORDS * 4), "ocr"), (107, " \n", "ocr")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, t string, m string, key int, kinds string")
    got = {r["id"]: r for r in scans.repair_scans(df, "id", "t", "m", df, "t").collect()}
    assert set(got) == {100, 104, 105, 106, *pages}
    assert got[105]["reason"] == "no lines of a page" and got[105]["repaired"] == "not a page " * 30 and got[105]["kinds"] == []
    assert got[106]["reason"] is None and got[106]["kinds"]  # one long line does not leave a page out
    marked = lambda found: sum(len({x["line_no"] for x in found[k]["kinds"] if x["kind"] == "ocr"} & wrong) for k, (_, wrong) in pages.items())
    wrong = sum(len(w) for _, w in pages.values())
    assert marked(got) >= 0.8 * wrong and sum(len(x["kinds"]) for x in got.values()) < 2 * wrong + 100
    monkeypatch.setattr(scans, "CONTEXTS", 0)  # without vectors nothing is learned and no word put right
    none = {r["id"]: r for r in scans.repair_scans(df, "id", "t", "m", df, "t").collect()}
    assert marked(none) == 0
    assert scans.repair_scans(df.limit(0), "id", "t", "m", df.limit(0), "t").count() == 0
