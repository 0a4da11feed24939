"""Text of scanned pages: furniture found, cut words joined, misread words put right, lines made paragraphs.

Skip-gram vectors are learned over all scanned texts (``company``). Rare words are linked to frequent ones from which they
differ by glyphs that are misread that way and whose company they keep; what glyphs are misread is learned from words in like company.
Where a word has several links, the one that fits best in its place is taken. Vocabulary, links and vectors are tables; each text
only meets those of its own words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliodex.llm.company import CONTEXTS, LETTERS, WINDOW, Company, Misreadings, cosine, edit, fit_company, is_misreading, learn_misreadings, one_place_apart, pair_counts, word_vectors
from foliodex.session import stage

#: Lines of a scanned page are not longer.
WIDEST = 120
#: The share of lines that may be longer, run together by whatever read the page.
MOST_WIDE = 0.1
#: A misread word is in texts that are not scans at most so many times for one in scans, and its origin so many times more often.
RARE, OFTEN, LEAST = 1.0, 15, 4
#: Log-likelihood ratio, by glyphs and company, from which a word is taken for misread.
BAR = 1.5
#: What glyphs that have not been learned count: company must make up for it.
UNKNOWN = -1.0
HYPHENS = "-¬­‐"
EDGES = ".,;:!?\"'«»„“”"
#: The words for a page in the languages of the texts.
PAGE_WORDS = {"page", "seite", "página", "pagina", "pág", "pag", "p", "s"}

_digits = r"[0-9lIiOoSsB]{1,4}"
_roman = r"[ivxlcIVXLC1]{1,7}"
_number = re.compile(rf"(?:[-–—|\[(]\s*)?(?:{_digits}|{_roman})(?:\s*[-–—|\])])?(?:\s*/\s*{_digits})?")
_worded = re.compile(rf"(\S{{1,8}}?)\.?\s+(?:{_digits}|{_roman})(?:\s+(?:of|von|de|sur|/)\s+{_digits})?")
_row = re.compile(r"[0-9lIOo]+(?:\s{2,}[0-9lIOo]+)+")
_edge_number = re.compile(rf"^(?:{_digits}|{_roman})\s{{2,}}|\s{{2,}}(?:{_digits}|{_roman})$")
_head = re.compile(r"[A-Za-z-]{2,}:\s")
_wrapped = re.compile(r"[^\W\d_][,\-¬­‐]*$")


def skeleton(text: str) -> str:
    """What is left of a text when look-alike glyphs are one."""
    s = unicodedata.normalize("NFKD", text.lower())
    s = "".join(c for c in s if not unicodedata.combining(c))
    for a, b in (("vv", "w"), ("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d")):
        s = s.replace(a, b)
    return s.translate(str.maketrans("c(f†i1|05@96hy", "eettlllosagbbv"))


def alike(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 4:
        return a == b
    match = SequenceMatcher(None, a, b, autojunk=False)
    return match.real_quick_ratio() >= 0.8 and match.quick_ratio() >= 0.8 and match.ratio() >= 0.8


def repeated(cores: Counter) -> dict[str, bool]:
    """Of distinct strings with their counts, whether each occurs twice or is alike another.

    Alike strings of l and m characters share so many neighbouring pairs of characters that at least 0.4 of the shorter length less two
    are left in any order; only such are compared. Pairs are counted in blocks of strings by products of arrays.
    """
    own = list(cores)
    pairs = np.zeros((len(own), 512), np.float32)
    for i, core in enumerate(own):
        for a, b in zip(core, core[1:]):
            pairs[i, (ord(a) * 31 + ord(b)) % 512] += 1
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    found = {core: n > 1 for core, n in cores.items()}
    for at in range(0, len(own), 1024):
        both = pairs[at : at + 1024] @ pairs.T
        shorter = np.minimum(sizes[at : at + 1024, None], sizes)
        likely = (both >= 0.4 * shorter - 2) & (np.abs(sizes[at : at + 1024, None] - sizes) <= 4)
        for i, j in zip(*np.nonzero(likely)):
            i += at
            if i < j and not (found[own[i]] and found[own[j]]) and alike(own[i], own[j]):
                found[own[i]] = found[own[j]] = True
    return found


def is_wrapped(text: str) -> bool:
    """Whether a text is prose in lines of a page's width, and neither a mail nor a table; a few lines may have been run together."""
    lines = [s for line in text.split("\n") if (s := line.strip())]
    wide = sum(len(line) > WIDEST for line in lines)
    if len(lines) < 3 or wide > MOST_WIDE * len(lines) or _head.match(lines[0]):
        return False
    fields = Counter(n for line in lines if (n := sum(map(line.count, ",;|\t"))) > 1)
    if max(fields.values(), default=0) > 0.5 * len(lines):
        return False
    goes_on = sum(25 < len(a) <= WIDEST and a.count(" ") >= 2 and bool(_wrapped.search(a)) and b[0].isalpha() for a, b in zip(lines, lines[1:]))
    return goes_on >= max(1, 0.25 * len(lines))


def likely(text: Column, method: Column) -> Column:
    """Whether a text may be a page or is said to be one: some line ends in a letter and goes on with a letter."""
    return F.coalesce(method == "ocr", F.lit(False)) | text.rlike(rf"\p{{L}}[{HYPHENS},]*[ \t\r]*\n[ \t\r\f\n]*\p{{L}}")


def is_page_number(s: str) -> bool:
    if _number.fullmatch(s):
        return True
    m = _worded.fullmatch(s)
    return bool(m) and (m[1].lower() in PAGE_WORDS or len(m[1]) > 3 and any(alike(skeleton(m[1]), skeleton(w)) for w in PAGE_WORDS if len(w) > 3))


def furniture(text: str) -> tuple[list[str], list[str]]:
    """The lines of a page text, stripped, and for each one of: blank, header, page_number, row, title, text."""
    raw = [line.rstrip(" \t\r") for line in text.split("\n")]
    lines = [line.strip(" \t\r\f") for line in raw]
    kinds = ["blank" if not s else "page_number" if is_page_number(s) else "row" if _row.fullmatch(s) else "text" for s in lines]
    width = max((len(line) for line, k in zip(raw, kinds) if k == "text"), default=0)
    held = [i for i, k in enumerate(kinds) if k != "blank"]
    first = held[0] if held else -1
    texts = [i for i in held if kinds[i] == "text"]
    following = dict(zip(texts, texts[1:]))
    cores: dict[int, str] = {}
    numbered, unfilled = set(), set()
    for i in texts:
        s = lines[i]
        core = _edge_number.sub("", s)
        if core != s and len(core) > 3 and core[-1] not in ".?!,;":
            numbered.add(i)
        elif s[-1] in ".?!,;%" + HYPHENS or len(s) < 4:
            continue
        else:
            after = following.get(i)
            if after is None or len(s) + 3 + len(lines[after].split(None, 1)[0]) < width:
                unfilled.add(i)
        if i in numbered or i in unfilled or i == first:
            if core.count(" ") <= 8:
                cores[i] = skeleton(core)
    kinds_of = Counter(cores.values())  # a long text has one header very often
    akin = repeated(kinds_of)
    for i, own in cores.items():
        like = akin[own]
        indented = raw[i].lstrip("\f")[:1] == " "
        if i == first and i not in numbered:
            stands_alone = i + 1 < len(lines) and not lines[i + 1]
            flush = not indented and lines[i] != lines[i].upper() and stands_alone
            if like and not flush:
                kinds[i] = "header"
            elif i in unfilled and stands_alone:
                kinds[i] = "title"
        elif like or i in numbered and (i in unfilled or len(lines[i]) < 0.85 * width):
            kinds[i] = "header"
    # a header that stands once, at the edge of a page
    marked = [i for i in held if kinds[i] != "title"]
    for before, i, after in zip([-1, *marked], marked, [*marked[1:], -1]):
        if i in unfilled and kinds[i] == "text" and i in following and lines[i].count(" ") < 6 and not lines[i][0].islower():
            edge = raw[i][:1] == "\f" or after >= 0 and raw[after][:1] == "\f" or "page_number" in (kinds[before] if before >= 0 else "", kinds[after] if after >= 0 else "")
            if edge and len(lines[i]) < 0.8 * width:
                kinds[i] = "header"
    return lines, kinds


def normal(word: str) -> str:
    return word.strip(EDGES).lower()


def cut_words(lines: list[str], kinds: list[str]) -> dict[int, tuple[int, str, str, str]]:
    """Lines that end in a hyphen: the next line of text, the word's two parts, and the hyphen."""
    texts = [i for i, k in enumerate(kinds) if k in ("text", "title")]
    found = {}
    for i, j in zip(texts, texts[1:]):
        s = lines[i].rstrip(HYPHENS)
        if len(s) < len(lines[i]) and s and not s[-1].isspace() and kinds[i] == kinds[j] == "text":
            found[i] = (j, s.split()[-1], lines[j].split(None, 1)[0], lines[i][len(s) :])
    return found


#: One letter for each kind of line.
LETTER = {"blank": "b", "header": "h", "page_number": "p", "row": "r", "title": "i", "text": "t"}
KIND = {v: k for k, v in LETTER.items()}


def lines_of(text: str, letters: str) -> tuple[list[str], list[str]]:
    """The lines and kinds that ``furniture`` found, read back from the kinds' letters."""
    return [line.strip(" \t\r\f") for line in text.split("\n")], [KIND[c] for c in letters]


def asked(lines: list[str], kinds: list[str]) -> tuple[set[str], set[str]]:
    """The words of a scanned text that must be looked up, and among them those cut at a line's end, with and without their hyphen."""
    cut = cut_words(lines, kinds)
    skip = {j for j, *_ in cut.values()}
    words: set[str] = set()
    for i, k in enumerate(kinds):
        if k in ("text", "title"):
            own = lines[i].split()
            words.update(map(normal, own[1 if i in skip else 0 : len(own) - (i in cut)]))
    joined = {normal(a + h + b) for _, a, b, _ in cut.values() for h in ("", "-")}
    lettered = {w for w in words | joined if any(c.isalpha() for c in w)}
    return lettered, lettered & joined


def stream(lines: list[str], kinds: list[str]) -> list[str]:
    return [w for i, k in enumerate(kinds) if k == "text" for x in lines[i].split() if (w := normal(x))]


def vocabulary(rows: DataFrame) -> DataFrame:
    """(word, clean, scan): occurrences of each word in the texts of (text) that are not pages, and in those that are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text in batch.column(0).to_pylist():
                counts[is_wrapped(text)].update(text.lower().split())
            total: Counter = Counter()
            for kind in (0, 1):
                for w, n in counts[kind].items():
                    if w := w.strip(EDGES):
                        total[w, kind] += n
            words, of = [w for w, _ in total], [k for _, k in total]
            n = np.fromiter(total.values(), np.int64, len(total))
            scan = np.array(of, bool)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.where(scan, 0, n)), pa.array(np.where(scan, n, 0))], names=["word", "clean", "scan"])

    return rows.mapInArrow(count, "word string, clean long, scan long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan"))


def links(words: DataFrame, known: DataFrame, pages: DataFrame) -> tuple[DataFrame, Company, Misreadings]:
    """(word, origin, fit, vector) of misread words: frequent words they may have been, the greater the fit the better, and the models that say so.

    ``words``: (word), distinct; ``known``: their ``vocabulary``; ``pages``: (text, letters). A word is linked if glyphs and company together
    speak for it; a word without neighbours that are known is judged by its glyphs alone.
    """
    letters = F.col("word").rlike(r"^\p{L}[\p{L}\p{M}'’-]*$")
    often = stage(known.where((F.col("clean") >= LEAST) & letters).select(F.col("word").alias("origin"), F.col("clean").alias("often"), "scan"), "scans-often")
    longest = often.agg(F.max(F.char_length("origin"))).first()[0] or 0
    frequent = [r["origin"] for r in often.where("scan > 0").orderBy(F.desc("often"), "origin").limit(CONTEXTS).collect()]

    def streams(batch: pa.RecordBatch) -> Iterator[list[str]]:
        return (stream(*lines_of(t, k)) for t, k in zip(*(c.to_pylist() for c in batch.columns)))

    counted = pair_counts(pages.select("text", "letters"), streams, frequent)
    company = fit_company(counted, frequent)
    vectors = stage(word_vectors(counted, company), "scans-vectors")

    odd = words.join(known, "word", "left").na.fill(0, ["clean", "scan"]).where(F.col("clean") <= RARE * F.greatest("scan", F.lit(1)))
    odd = stage(odd.select("word", F.col("clean").alias("seen")), "scans-odd")
    rare = stage(known.where("scan = 0 and clean <= 2").where(F.col("word").rlike(r"\p{L}") & (F.char_length("word") >= LETTERS)).select("word", F.col("clean").alias("seen")), "scans-controls")
    more_often = F.col("often") >= OFTEN * F.greatest("seen", F.lit(0.2))
    near = stage(one_place_apart(odd, often).where(more_often), "scans-near")
    alone = lambda df: df.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("origin").alias("origin")).where("n = 1").select("word", "origin")
    beside = vectors.toDF("word", "v"), vectors.toDF("origin", "u")
    aligned = alone(near).join(beside[0], "word").join(beside[1], "origin")
    n_odd = odd.where((F.char_length("word") >= LETTERS) & ~F.col("word").rlike(f"[{HYPHENS}]")).count()
    glyphs = learn_misreadings(aligned, alone(one_place_apart(rare, often).where(more_often)), n_odd, rare.count(), HYPHENS)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, n, o, weight) for w, n in zip(*(c.to_pylist() for c in batch.columns)) if len(w) > 1 for o, weight in glyphs.origins(w).items()]
            columns = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.float64()))], names=["word", "seen", "origin", "weight"])

    def of_glyphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = [edit(w, o) for w, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            kept = [i for i, (x, y) in enumerate(edits) if is_misreading(x, y, HYPHENS) and (x, y) not in glyphs.weights]
            yield batch.take(pa.array(kept, pa.int64()))

    # two edits make a word longer than its origin by two letters at most
    guessed = odd.where(F.char_length("word") <= longest + 2).mapInArrow(guess, "word string, seen long, origin string, weight double").join(often, "origin").where(more_often).select("word", "origin", "often", "weight")
    unknown = near.select("word", "origin", "often").mapInArrow(of_glyphs, "word string, origin string, often long").withColumn("weight", F.lit(UNKNOWN))
    found = guessed.unionByName(unknown).join(beside[0], "word", "left").join(beside[1], "origin", "left")
    scored = found.withColumn("fit", F.col("weight") + glyphs.of_company(cosine(F.col("v"), F.col("u"))))
    linked = scored.where(F.col("fit") >= BAR).select("word", "origin", (F.col("fit") + 0.2 * F.log("often")).alias("fit"), F.col("u").alias("vector"))
    return linked, company, glyphs


def recase(seen: str, origin: str) -> str:
    """The origin in the case and between the edges of the word as seen."""
    core = seen.strip(EDGES)
    left = seen[: seen.find(core)] if core else ""
    right = seen[len(left) + len(core) :]
    letters = [c for c in core if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        origin = origin.upper()
    elif letters and core[0].isupper():
        origin = origin[:1].upper() + origin[1:]
    return left + origin + right


def _best(options: list[dict], near: list[str], company: Company | None) -> str:
    """The origin that fits best: overall, and beside the words it stands among."""
    if len(options) == 1 or company is None:
        return max(options, key=lambda o: (o["fit"], o["origin"]))["origin"]
    beside = lambda o: company.fit_of(o["vector"], near) if o["vector"] else 0.0
    return max(options, key=lambda o: (o["fit"] + 2 * beside(o), o["origin"]))["origin"]


def repair(text: str, lines: list[str], kinds: list[str], seen: dict[str, int], options: dict[str, list[dict]], scanned: bool, company: Company | None = None) -> tuple[list[tuple[int, str]], str]:
    """The kinds of a text's lines as (line number from 1, kind), and the text in paragraphs.

    ``lines`` and ``kinds``: what ``furniture`` found; ``seen``: occurrences of joined words outside scans; ``options``: the links of misread words. Unless ``scanned``,
    the page must show that it is one by a page number, cut words, or two headers or misread words in all; else nothing is changed.
    """
    cut = cut_words(lines, kinds)
    other = sum(h != "-" for *_, h in cut.values())
    parted: dict[int, tuple[int, str, str, str]] = {}
    hyphens = set()
    for i, (j, a, b, h) in cut.items():
        whole, compound = seen.get(normal(a + b), 0), seen.get(normal(f"{a}-{b}"), 0)
        at_own = h == "-" and (2 * other > len(cut) or a[-1:].isdigit() and b[:1].isdigit() or compound > whole)
        parted[i] = (j, a, b, "-" if at_own else "")
        if not at_own:
            hyphens.add(i)
    words: list[tuple[str, int, int]] = []  # word, its line, and the line it goes on in or -1
    goes_on = {j for j, *_ in parted.values()}
    for i, k in enumerate(kinds):
        if k in ("text", "title"):
            own = lines[i].split()
            for w in own[1 if i in goes_on else 0 : len(own) - (i in parted)]:
                words.append((w, i, -1))
            if i in parted:
                j, a, b, h = parted[i]
                words.append((a + h + b, i, j))
    misread, right = set(), {}
    for at, (w, i, j) in enumerate(words):
        if found := options.get(normal(w)):
            near = [normal(x[0]) for x in words[max(0, at - WINDOW) : at] + words[at + 1 : at + 1 + WINDOW]]
            right[at] = recase(w, _best(found, near, company))
            if j < 0:
                misread.add(i)
            else:
                part = len(parted[i][1])
                if right[at][:part] != w[:part]:
                    misread.add(i)
                rest = len(w) - part - len(parted[i][3])
                if right[at][-rest:] != w[-rest:]:
                    misread.add(j)
    if not (scanned or hyphens or "page_number" in kinds or len(right) + kinds.count("header") > 1):
        return [], text
    marks = [(i + 1, k) for i, k in enumerate(kinds) if k in ("header", "page_number")]
    marks += [(i + 1, "hyphen") for i in hyphens] + [(i + 1, "ocr") for i in misread]
    return sorted(marks), _paragraphs(text, lines, kinds, words, right)


def _paragraphs(text: str, lines: list[str], kinds: list[str], words: list[tuple[str, int, int]], right: dict[int, str]) -> str:
    """Words in paragraphs: a new one begins after a title, at an indent, or at a blank line after the end of a sentence; table rows stay lines."""
    raw = text.split("\n")
    of_line: dict[int, list[str]] = {}
    for at, (w, i, _) in enumerate(words):
        of_line.setdefault(i, []).append(right.get(at, w))
    out: list[str] = []
    begin, blank, last = True, False, ""
    for i, k in enumerate(kinds):
        if k == "blank":
            blank = True
        elif k == "row":
            out.append(lines[i])
            begin = last == "row" and begin
        elif k in ("text", "title") and i in of_line:
            line = " ".join(of_line[i])
            indent = raw[i].lstrip("\f")[:2] == "  "
            ended = not out or out[-1][-1:] in ".?!"
            if begin or k == "title" or last == "title" or indent or blank and ended:
                out.append(line)
            elif last == "row":
                at = next((x for x in range(len(out) - 1, -1, -1) if not _row.fullmatch(out[x])), -1)
                if at >= 0 and out[at][-1:] not in ".?!":
                    out[at] += " " + line  # a table stood inside a sentence
                else:
                    out.append(line)
            else:
                out[-1] += " " + line
            begin = blank = False
        if k in ("text", "title", "row"):
            last = k
    return "\n\n".join(out)


def repair_scans(df: DataFrame, key: str, text: str, method: str, corpus: DataFrame, corpus_text: str) -> DataFrame:
    """(key, kinds, repaired, reason): for each scanned text of ``df`` its lines that are furniture, cut or misread, as an array of
    (line_no, kind), and the repaired text.

    A text is taken for scanned if it is prose in lines of a page's width and ``method`` says ocr or the lines show it. A text of which
    ``method`` says ocr and that is not blank, but not such prose, comes out as it is, without kinds, with the reason ``no lines of a
    page``; other texts give no row, nor do null and blank ones or null keys. Of rows with one key, each is repaired, with
    the links of all. Word counts are taken over the whole column ``corpus_text`` of ``corpus``. Other columns
    are not read.
    """
    rows = df.select(df[key].cast("long").alias("key"), df[text].alias("text"), F.coalesce(df[method] == "ocr", F.lit(False)).alias("ocr"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = ["".join(LETTER[k] for k in furniture(t)[1]) if is_wrapped(t) else None for t in batch.column(1).to_pylist()]
            found = pa.array(letters, pa.string())
            whole = pa.RecordBatch.from_arrays([*batch.columns, found], names=["key", "text", "ocr", "letters"])
            yield whole.filter(pa.array([bool(x or o) for x, o in zip(letters, batch.column(2).to_pylist())], pa.bool_()))

    read = stage(rows.where(F.col("key").isNotNull() & F.col("text").rlike(r"\S")).mapInArrow(keep, "key long, text string, ocr boolean, letters string"), "scans-pages")
    pages = read.where("letters is not null")
    known = stage(vocabulary(corpus.select(corpus[corpus_text].alias("text")).where("text <> ''")), "scans-words")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, t, x in zip(*(c.to_pylist() for c in batch.columns)):
                words, joined = asked(*lines_of(t, x))
                found += [(k, w, w in joined) for w in words]
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.bool_()))], names=["key", "word", "joined"])

    wanted = stage(pages.select("key", "text", "letters").mapInArrow(ask, "key long, word string, joined boolean"), "scans-asked")
    linked, company, _ = links(wanted.select("word").distinct(), known, pages)
    options = linked.groupBy("word").agg(F.collect_list(F.struct("origin", "fit", "vector")).alias("options"))
    with_options = wanted.join(options, "word").select("key", "word", F.lit(0).cast("long").alias("clean"), "options")
    joined = wanted.where("joined").join(known.where("clean > 0").select("word", "clean"), "word").select("key", "word", "clean", F.lit(None).cast(options.schema["options"].dataType).alias("options"))
    facts = with_options.unionByName(joined).groupBy("key").agg(F.collect_list(F.struct("word", "clean", "options")).alias("facts"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line_no", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            keys, marks, texts = [], [], []
            for k, t, ocr, letters, own in zip(*(c.to_pylist() for c in batch.columns)):
                own = own or []
                counts, choices = {f["word"]: f["clean"] for f in own if f["options"] is None}, {f["word"]: f["options"] for f in own if f["options"]}
                m, repaired = repair(t, *lines_of(t, letters), counts, choices, ocr, company)
                if m or ocr:
                    keys.append(k)
                    marks.append([{"line_no": i, "kind": x} for i, x in m])
                    texts.append(repaired)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(marks, kind), pa.array(texts, pa.string())], names=["key", "kinds", "repaired"])

    kinds_type = "array<struct<line_no: long, kind: string>>"
    mended = pages.join(facts, "key", "left").select("key", "text", "ocr", "letters", "facts").mapInArrow(mend, f"key long, kinds {kinds_type}, repaired string").withColumn("reason", F.lit(None).cast("string"))
    others = read.where("letters is null").select("key", F.array().cast(T._parse_datatype_string(kinds_type)).alias("kinds"), F.col("text").alias("repaired"), F.lit("no lines of a page").alias("reason"))
    return mended.unionByName(others).withColumnRenamed("key", key)
