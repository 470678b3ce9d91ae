"""Problem 5: noise in text from scanned pages.

Running headers and footers are lines at page edges that repeat within a book
(compared after folding what scanners confuse); page numbers are edge lines that
hold the page's own number.  Words broken across lines are joined where the
corpus' vocabulary knows the joined word better than the hyphenated one.
Misread words are tokens that the vocabulary of born-digital books doesn't know
and that a scanner's known confusions turn into a word it knows well.

The vocabulary is a table; tokens meet it in shuffled joins.  Only the
``KNOWN_WORDS`` most frequent words go to every executor, as a filter that keeps
sure words out of those joins; words that the joins would report in any case of
letters aren't sent, so it changes no result.

Defined results
---------------
* null or empty ``lines``, null, empty and blank text: no case.
* a page without a number can't confirm bare page numbers; decorated ones count.
* a line of furniture has no other kind; the heading that opens a chapter (on the
  page where the chapter starts, or where its title first occurs) is none.
* languages without a vocabulary give no misread words and join nothing at '-'.
* keys delivered twice count once, in the statistics too; other columns than
  those named here are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.alphabets import own
from bookloom.llm.common import lang_code, materialise, once_of, table
from bookloom.operators.tables import running
from bookloom.llm.lookalikes import form

#: Words sent to every executor as sure; a bound, not a cap on the vocabulary.
KNOWN_WORDS = 50_000
#: A misread word's reading is at least this many times as frequent in clean books.
RATIO = 30
#: Uses in clean books that make a word known.
KNOWN = 3
#: Uses in scanned books that make a word a possible reading of a token with a sign inside.
SEEN = 5
#: A page's edge: so many lines from the top and from the bottom.  Headers and page numbers are its outer two.
EDGE = 3
#: Letters of the longest word; longer runs are no words.
LONGEST = 60
#: Signs in a token that stand for letters; a token with more is no misread word.
MOST_SIGNS = 8
#: Words of the longest title of a running header.
TITLE_WORDS = 10
#: Words of the longest running header that is looked for in a line with other text.
HEADER_WORDS = 12
#: Pages on which a number runs along with the pages, at a fixed distance, to be a sequence of page numbers.
SEQUENCE = 3
#: Header lines at most this far apart, in edits for a letter, say the same; shorter ones have to be equal.
FUZZY, FUZZY_LETTERS = 0.1, 12
#: Rows of pieces of lines that are handed over at once.
PARTS_AT_ONCE = 50_000

# What scanners print, and what stood there.
CONFUSED = [
    ("0", "o"), ("0", "о"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("9", "g"), ("9", "q"),
    ("6", "b"), ("6", "б"), ("@", "a"), ("@", "а"), ("4", "ч"), ("4", "a"), ("3", "з"), ("3", "e"), ("8", "b"), ("$", "s"), ("ь1", "ы"), ("bl", "ы"),
    ("6", "ô"), ("0", "ô"), ("п1", "ш"), ("10", "ю"), ("o'", "ơ"), ("u'", "ư"), ("o’", "ơ"), ("u’", "ư"), ("cl", "đ"), ("l", "i"),
    ("c", "e"), ("f", "t"), ("rn", "m"), ("ri", "n"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("U", "ll"), ("ii", "u"), ("m", "rn"), ("I", "l"),
    ("e", "c"), ("t", "f"), ("n", "ri"), ("d", "cl"), ("h", "li"), ("w", "vv"), ("u", "ii"), ("ll", "U"), ("tt", "U"), ("nn", "rm"), ("q", "g"), ("ı", "i"),
    ("г", "т"), ("п", "л"), ("и", "н"), ("с", "е"), ("ш", "щ"), ("ц", "и"), ("н", "и"), ("л", "п"), ("т", "г"), ("в", "б"),
]
MARKS = "-‐‑­¬–—"
PAGE_WORDS = r"page|trang|seite|pág\.|стр\.|p\.|pag\.|página|страница|tr\."
# What number a misread digit stands for.
DIGITS = str.maketrans("lIi|!oOоОsSbgqB", "111110000556998")

# What stands before a number that belongs to the sentence.
BEFORE_NUMBER = set("p pp no nr s tr q st fig vol vols cap núm pág chap t bd abb с рис табл ок ул cf vgl d art approx aprox env ca lt № số n° kl".split())

TOKEN = re.compile(r"[\w@!|$]+(?:['’][\w@!|$]+)*")
NUMBER_FIRST, NUMBER_LAST = re.compile(r"([^\s.]{1,8})\s{2,}(?=\S)"), re.compile(r"(?<=\S)\s{2,}([^\s.]{1,8})\Z")
# white space with a line break, or longer than a sign; begins with a class, which is searched for quickly
GAP = re.compile(r"\s(?:\s+|(?<=[\r\n]))")
CLOSED = re.compile(r"[.!?…:]['\"”»’“)\]]*\Z")
UNSPACED = re.compile(r"[぀-ヿ㐀-鿿]")
LEADING_NUMBER = re.compile(rf"([\-–—\[(]?\s?(?:(?:{PAGE_WORDS})\s)?(?:\d{{1,4}}|[ivxlc]{{1,8}}|[lI|\dO]{{1,4}})\s?[\-–—\])]?)\s(?=\w|[“«„\"(])", re.I)
# what a leading number can begin with: implied by the pattern above
LEADS = re.compile(r"[-–—\[(\s\divxlcO|ptsпс]", re.I)
# what may stand before a title that interrupts a sentence
NO_END = re.compile(r"[^\s.!?…”»\"']")
BREAK = re.compile(rf"[{MARKS}]\s+(?=\w)")
RIGHT = re.compile(r"\w[\w'’]*")
# A capital inside a word that stands for small letters.
INNER = re.compile(r"(?<=\w)[IU]")
VOCABULARY_RUN = re.compile(r"[\w'’-]+")
VOCABULARY_TOKEN = re.compile(r"\w+(?:['’]\w+)*(?:-\w+)*")
NUMBER_LINE = re.compile(rf"[\s\-–—\[\]()·•.]*(?:({PAGE_WORDS})\s*)?([0-9lIi|!oOоОsSbgqB]{{1,4}}|[ivxlcIVXLC]{{1,8}})[\s\-–—\[\]()·•.]*\Z", re.I)
ROMAN = re.compile(r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\Z", re.I)

EVENTS = "record_table string, record_id long, lang string, line_no int, kind string, a string, b string, mark string"


def _roman(s: str) -> int | None:
    if not ROMAN.match(s):
        return None
    total, last = 0, 0
    for c in reversed(s.lower()):
        v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c]
        total += v if v >= last else -v
        last = max(last, v)
    return total


def numbers(line: str) -> tuple[set[int], bool] | None:
    """The numbers a page-number line may hold, and whether it is decorated; None for other lines."""
    m = NUMBER_LINE.match(line)
    if not m:
        return None
    s = m[2]
    out = set()
    if r := _roman(s):
        out.add(r)
    digits = s.translate(DIGITS)
    if digits.isdigit():
        out.add(int(digits))
    stripped = line.strip()
    decorated = bool(m[1]) or stripped[:1] in "-–—[(" and stripped[-1:] in "-–—])"
    return (out, decorated) if out else None


@lru_cache(maxsize=20_000)
def fold(line: str) -> str:
    """A line as a scanner that confuses everything it can confuse would have it."""
    s = form(line, "en").lower()
    for seen, true in (("0", "o"), ("1", "l"), ("!", "l"), ("|", "l"), ("i", "l"), ("5", "s"), ("9", "g"), ("q", "g"), ("6", "b"), ("@", "a"), ("rn", "m"), ("rl", "n"), ("vv", "w"), ("cl", "d"), ("ll", "h"), ("c", "e"), ("f", "t"), ("4", "ч"), ("3", "з")):
        s = s.replace(seen, true)
    s = s.replace("г", "т").replace("п", "л").replace("и", "н").replace("ц", "и")
    return " ".join(s.split())


def split_number(line: str, pages) -> tuple[str, bool]:
    """A header without the number of one of the pages (a container) at its start or end, and whether it had one."""
    s = line.strip()
    for m in (NUMBER_FIRST.match(s), NUMBER_LAST.search(s)):
        if m and pages and (n := numbers(m[1])) and any(x in pages for x in n[0]):
            return (s[m.end() :] if m.start() == 0 else s[: m.start()]).strip(), True
    return s, False


def _left(text: str, end: int) -> int:
    """Where the word begins that ends at a place."""
    at = end
    while at > 0 and (text[at - 1].isalnum() or text[at - 1] in "_'’"):
        at -= 1
    while at < end and text[at] in "'’":
        at += 1
    return at


def tokens(text: str, lang: str, known: frozenset[str]) -> list[tuple[str, bool]]:
    """Tokens worth a look in the vocabulary, each with whether '!' closes it before a small letter."""
    out = []
    inner = INNER.search(text)
    if known.issuperset(TOKEN.findall(text.lower())) and not inner:
        return out
    letters = own(lang)
    for m in TOKEN.finditer(text):
        w = m[0]
        low = w.lower()
        odd = inner and not w.isupper() and INNER.search(w)
        if low in known and not odd or low.isdigit():
            continue
        closing = w.endswith("!")
        if closing and not (text[m.end() : m.end() + 1] == " " and text[m.end() + 1 : m.end() + 2].islower()):
            low = w.rstrip("!").lower()
            # a number is a word only with its last letter misread
            if not low or low in known and not odd:
                continue
            w, closing = w.rstrip("!"), False
        if not any(c.isalpha() for c in w) or len(w) > LONGEST or "_" in w:
            continue
        # a letter with a hyphen is part of an abbreviation (Russian "г-н")
        if len(w) == 1 and (text[m.end() : m.end() + 1] == "-" or text[m.start() - 1 : m.start()] == "-"):
            continue
        if any(ord(c) >= 128 and c not in letters for c in w) or w.startswith("!"):
            continue
        out.append((w, closing))
    return out


HARD = set("01!|5969@438$")
HARD_PAIRS: dict[str, list[tuple[str, str]]] = {}
SOFT_PAIRS: list[tuple[str, str]] = []
for _seen, _true in CONFUSED:
    _signs = [c for c in _seen if c in HARD]
    if _signs:
        HARD_PAIRS.setdefault(_signs[0], []).append((_seen, _true))
    else:
        SOFT_PAIRS.append((_seen, _true))


def _signs_undone(token: str) -> set[str]:
    """Readings of every sign that is no letter, from the left; none if one can't be read."""
    front = {token}
    while True:
        at = {s: next((i for i, c in enumerate(s) if c in HARD), None) for s in front}
        if all(i is None for i in at.values()):
            return front
        new = {s for s, i in at.items() if i is None}
        for s, i in at.items():
            if i is not None:
                for seen, true in HARD_PAIRS.get(s[i], ()):
                    begin = i - seen.index(s[i])
                    if begin >= 0 and s.startswith(seen, begin):
                        new.add(s[:begin] + true + s[begin + len(seen) :])
        front = new


def variants(token: str) -> set[str]:
    """Readings of a token: every sign that is no letter undone, and up to two letters that scanners confuse.

    A token of more than ``MOST_SIGNS`` signs is none.  A letter may be undone before the signs, where both make one letter.
    """
    if sum(c in HARD for c in token) > MOST_SIGNS:
        return set()
    front, out = _signs_undone(token), set()
    out |= front
    for _ in range(2):
        new = set()
        for s in front:
            for seen, true in SOFT_PAIRS:
                at = s.find(seen)
                while at >= 0:
                    new.add(s[:at] + true + s[at + len(seen) :])
                    at = s.find(seen, at + 1)
        out |= new
        front = new
    out = {s.lower() for s in out}
    out.discard(token.lower())
    return out


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        runs: dict[tuple, Counter] = {}
        for lang, clean, text in zip(b.lang, b.clean, b.text):
            runs.setdefault((lang, clean), Counter()).update(VOCABULARY_RUN.findall(text.lower()))
        rows = []
        for (lang, clean), found in runs.items():
            counts: dict[str, int] = {}
            for run, n in found.items():
                # no token goes beyond a run, so each different run is parted once
                for w in (run,) if run.isalnum() else VOCABULARY_TOKEN.findall(run):
                    counts[w] = counts.get(w, 0) + n
            rows += [(lang, w, n if clean else 0, 0 if clean else n) for w, n in counts.items() if len(w) <= LONGEST]
        yield pd.DataFrame(rows, columns=["lang", "word", "n_clean", "n_scan"])


def vocabulary(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """(lang, word, n_clean, n_scan) over all paragraphs and pages, each key once."""
    p = paragraphs.where(F.length("text") > 0).select("lang", (~F.col("origin").startswith("pdf")).alias("clean"), "text")
    s = pages.where(F.size("lines") > 0).select("lang", F.lit(False).alias("clean"), F.array_join("lines", "\n").alias("text"))
    words = p.unionByName(s).mapInPandas(_words, "lang string, word string, n_clean long, n_scan long")
    return words.groupBy("lang", "word").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_scan").alias("n_scan"))


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edge lines of pages: those with the page's number, and the others with their folded key."""
    for b in batches:
        rows = []
        for page, book, number, lines in zip(b.page_id, b.book_id, b.page_number, b.lines):
            full = [(i, x) for i, x in enumerate(lines) if x and x.strip()]
            width = max((len(x) for _, x in full), default=0)
            number = None if pd.isna(number) else int(number)
            for k in sorted({*range(min(EDGE, len(full))), *range(max(0, len(full) - EDGE), len(full))}):
                i, x = full[k]
                rank, top = min(k, len(full) - 1 - k), k <= len(full) - 1 - k
                n = numbers(x)
                kind = "number" if n and rank <= 1 and (number in n[0] or n[1]) else "line"
                rest, had = split_number(x, () if number is None else (number,))
                closed = bool(re.search(r"[.!?…,;:]['\"”»)]*\Z", rest))
                apart = [v - number for v in sorted(n[0])] if n and rank <= 1 and number is not None and kind == "line" else None
                rows.append((page, book, number, i, rank, top, kind, fold(rest), had, len(rest) < 0.9 * width and not closed, apart))
        columns = ["page_id", "book_id", "page_number", "line_no", "rank", "top", "kind", "key", "numbered", "titled", "apart"]
        yield pd.DataFrame(rows, columns=columns).astype({"page_number": "Int32"})


EDGE_LINES = "page_id long, book_id long, page_number int, line_no int, rank int, top boolean, kind string, key string, numbered boolean, titled boolean, apart array<int>"


def furniture(pages: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(page_id, line_no) of furniture on pages, (book_id, key, common) of running headers and titles, and
    (page_id, heading) of the lines that open chapters.

    ``common``: the key is a header or title in several books.
    """
    edges = materialise(pages.where(F.size("lines") > 0).mapInPandas(_edges, EDGE_LINES))
    # numbers that run along with the pages at a distance of their own
    apart = edges.where("apart is not null").select("page_id", "book_id", "line_no", F.explode("apart").alias("apart"))
    runs = apart.groupBy("book_id", "apart").agg(F.countDistinct("page_id").alias("n")).where(f"n >= {SEQUENCE}")
    sequences = apart.join(runs.drop("n"), ["book_id", "apart"], "left_semi").select("page_id", "line_no").distinct()
    lines = edges.where("kind = 'line' and length(key) >= 2 and rank <= 1").join(sequences, ["page_id", "line_no"], "left_anti")
    titles = chapters.where(F.length(F.trim("chapter_title")) > 0).mapInPandas(_titles, "book_id long, page_start int, key string").distinct()
    # small tables that are met several times are written, which keeps plans small
    titles = materialise(titles)
    # what is a chapter's title stays as it is
    said = same_lines(lines).join(titles.select("book_id", "key"), ["book_id", "key"], "left_anti")
    lines = lines.join(said, ["book_id", "key"], "left").withColumn("key", F.coalesce("said", "key")).drop("said", "apart")
    lines = materialise(lines)
    each = lines.groupBy("book_id", "key").agg(
        F.countDistinct("page_id").alias("n_pages"), F.min("page_number").alias("first_page"), F.max(F.col("numbered").cast("int")).alias("numbered"), F.avg(F.col("titled").cast("int")).alias("titled")
    )
    own_titles = titles.groupBy("book_id", "key").agg(F.max(F.col("page_start").isNotNull()).alias("has_start"))
    each = each.join(own_titles, ["book_id", "key"], "left")
    # a key that repeats as a header in other books is one where it occurs once
    elsewhere = each.where("n_pages >= 2 and titled >= 0.5").groupBy("key").agg(F.count("*").alias("n_books"))
    headers = each.join(elsewhere, "key", "left").where(
        "numbered = 1 or (n_pages >= 2 and titled >= 0.5) or n_pages >= 4 or (titled >= 0.5 and n_books >= 2) or (titled >= 0.5 and has_start is not null)"
    )
    headers = materialise(headers)
    here = titles.where("page_start is not null").select("book_id", "key", F.col("page_start").alias("page_number"), F.lit(True).alias("titled_here"))
    begins = chapters.where("page_start is not null").select("book_id", F.col("page_start").cast("int").alias("page_number"), F.lit(True).alias("begins")).distinct()
    at = lines.join(headers.select("book_id", "key", "first_page", "has_start", "n_pages"), ["book_id", "key"])
    at = at.join(here, ["book_id", "key", "page_number"], "left").join(begins, ["book_id", "page_number"], "left")
    # the heading that opens a chapter: the last such line on the chapter's first page, or where its title first occurs;
    # of a title that the list of chapters lacks, a line of its own on a page where a chapter starts
    opens = F.coalesce("titled_here", F.lit(False)) | (F.coalesce(~F.col("has_start"), F.lit(False)) & F.coalesce(F.col("page_number") == F.col("first_page"), F.lit(False)))
    opens = opens | ((F.col("n_pages") == 1) & F.coalesce("begins", F.lit(False)))
    at = materialise(at.withColumn("opens", opens & F.col("top") & ~F.col("numbered")).select("page_id", "line_no", "opens"))
    last = at.where("opens").groupBy("page_id").agg(F.max("line_no").alias("heading"))
    header_lines = at.join(last, "page_id", "left").where("heading is null or line_no <> heading").select("page_id", "line_no")
    number_lines = edges.where("kind = 'number'").select("page_id", "line_no").unionByName(sequences)
    known = headers.select("book_id", "key").unionByName(titles.select("book_id", "key")).distinct()
    books = known.groupBy("key").agg((F.count("*") >= 2).alias("common"))
    known = known.join(books, "key")
    return number_lines.unionByName(header_lines).distinct(), known, last


def same_lines(lines: DataFrame) -> DataFrame:
    """(book_id, key, said): edge lines of a book that differ little from one that it has more often, and the most frequent such one.

    Short words (numbers among them) have to be equal.  A line parted into one piece more than the edits it is allowed
    keeps a piece whole in every line that says the same; so lines meet on their book, short words and pieces, and all
    pairs that meet are compared.  Only lines with a more frequent one of the same short words are cut.
    """
    each = lines.where(F.col("book_id").isNotNull() & (F.length("key") >= FUZZY_LETTERS)).groupBy("book_id", "key").agg(F.count("*").alias("n"))
    # small tables that are met several times are written, which keeps plans small
    each = materialise(each.withColumn("short", F.regexp_replace("key", r"\S{4,}", "")))
    often = each.where("n >= 2")
    there = often.groupBy("book_id", "short").agg(F.max("n").alias("most"), F.collect_set(F.length("key")).alias("lengths"))
    asked = each.join(there, ["book_id", "short"]).where("n < most").select("book_id", "short", "key", "n", "lengths")
    asked = asked.mapInPandas(_parts_of_asked, "book_id long, short string, key string, n long, part string")
    parts = often.mapInPandas(_parts_of_often, "book_id long, short string, n long, key string, part string")
    parts = parts.select("book_id", "short", "part", F.struct("n", "key").alias("first"))
    near = asked.join(parts, ["book_id", "short", "part"]).where("first.n > n").where(F.levenshtein("key", "first.key") <= F.floor(F.length("first.key") * FUZZY))
    return near.groupBy("book_id", "key").agg(F.max("first").alias("best")).select("book_id", "key", F.col("best.key").alias("said"))


@lru_cache(maxsize=4096)
def _pieces(length: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a line of a length, one more than the edits that it is allowed."""
    k = int(length * FUZZY) + 1
    ends = [length * i // k for i in range(k + 1)]
    return list(zip(ends, ends[1:]))


@lru_cache(maxsize=65536)
def _places(length: int, other: int) -> list[tuple[int, int, int]]:
    """(piece, start, end): where a line of a length holds the pieces of one of another length that says the same.

    Of the edits, at most as many as pieces come before lie before the first piece that is whole, and the rest after it.
    """
    pieces, longer = _pieces(other), length - other
    edits = len(pieces) - 1
    if abs(longer) > edits:
        return []
    out = []
    for i, (start, end) in enumerate(pieces):
        low = max(0, start - i, start + longer - (edits - i))
        high = min(length - (end - start), start + i, start + longer + (edits - i))
        out += [(i, at, at + end - start) for at in range(low, high + 1)]
    return out


def _parts_of_asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["book_id", "short", "key", "n", "part"]
    for b in batches:
        rows = []
        for book, short, key, n, lengths in zip(b.book_id, b.short, b.key, b.n, b.lengths):
            rows += [(book, short, key, n, x) for x in {f"{other} {i} {key[s:e]}" for other in lengths for i, s, e in _places(len(key), int(other))}]
            # long lines have many pieces
            if len(rows) >= PARTS_AT_ONCE:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)


def _parts_of_often(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(book, short, n, key, f"{len(key)} {i} {key[s:e]}") for book, short, key, n in zip(b.book_id, b.short, b.key, b.n) for i, (s, e) in enumerate(_pieces(len(key)))]
        yield pd.DataFrame(rows, columns=["book_id", "short", "n", "key", "part"])


def _titles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = pd.DataFrame({"book_id": b.book_id, "page_start": b.page_start.astype("Int32"), "key": [fold(t) for t in b.chapter_title]})
        yield out


def _hyphens(text: str, lang: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, left, right, mark) of words broken in running text."""
    out = []
    letters = own(lang)
    for m in BREAK.finditer(text):
        left = _left(text, m.start())
        if left < m.start():
            right = RIGHT.match(text, m.end())
            out.append((left, right.end(), text[left : m.start()], right[0], m[0][0]))
    if "¬" in text:
        out += [(m.start(), m.end(), m[1], m[3], m[2]) for m in re.finditer(r"(\w+)(¬)(\w+)", text)]
    return [x for x in out if all(ord(c) < 128 or c in letters for c in x[2] + x[3])]


def _pieces_after_gaps(text: str) -> Iterator[tuple[int, str, str]]:
    """(start, gap before it, piece) of what stands after line breaks and double spaces, and at the start a lone number."""
    gaps = list(GAP.finditer(text))
    ends = [*(m.start() for m in gaps), len(text)]
    if text and numbers(text[: ends[0]]):
        yield 0, "", text[: ends[0]]
    for m, end in zip(gaps, ends[1:]):
        if piece := text[m.end() : end]:
            yield m.end(), m[0], piece


def _pages(first: int | None, last: int | None) -> range:
    """The pages of a paragraph and the one after them."""
    return range(first, last + 2) if first is not None and last is not None else range(0)


def header_candidates(text: str, first: int | None, last: int | None) -> set[str]:
    """Folded pieces of a paragraph that may be running headers: whole pieces and, after double spaces, their first words."""
    out = set()
    for _, gap, piece in _pieces_after_gaps(text):
        whole = piece.strip()
        out |= {fold(whole), fold(split_number(whole, _pages(first, last))[0])}
        if "\n" not in gap and gap:
            words = piece.split(" ")
            out |= {fold(" ".join(words[:k])) for k in range(2, min(len(words), HEADER_WORDS) + 1)}
    return {k for k in out if len(k) >= 4}


def paragraph_furniture(text: str, first: int | None, last: int | None, keys) -> list[tuple[int, int]]:
    """Spans of headers, footers and page numbers inside a paragraph; ``keys`` are folded headers of its book."""
    spans = []
    pages = _pages(first, last)
    folded = {k for k in keys if len(k) >= 4}
    for at, gap, piece in _pieces_after_gaps(text):
        whole = piece.strip()
        n = numbers(whole)
        if n and (n[1] or any(x in pages for x in n[0])) and (at > 0 or len(whole) < len(text.strip())):
            spans.append((at, at + len(piece)))
            continue
        m = LEADING_NUMBER.match(piece) if LEADS.match(piece) else None
        if m and (n := numbers(m[1])) and (n[1] or pages) and (not pages or any(x in pages for x in n[0])):
            before = (text[: at - len(gap)].rsplit(maxsplit=1)[-1:] or [""])[0]
            belongs = not n[1] and before.lower().strip(".,;:") in BEFORE_NUMBER
            letter = len(m[1].strip()) == 1 and m[1].strip().isalpha() and m[1].strip() not in "ivx"
            if not belongs and not letter and (n[1] or "\n" in gap or "\r" in gap or not before.endswith((".", "!", "?", "…"))):
                spans.append((at, at + m.end()))
                continue
        if not folded:
            continue
        if len(whole) < len(text.strip()) and (fold(whole) in folded or fold(split_number(whole, pages)[0]) in folded):
            spans.append((at, at + len(piece)))
            continue
        if "\n" not in gap and gap:
            words = piece.split(" ")
            for size in range(min(len(words), HEADER_WORDS), 1, -1):
                head = " ".join(words[:size])
                if fold(head) in folded:
                    spans.append((at, at + len(head)))
                    break
    return spans


def title_spans(text: str) -> list[tuple[str, int, int]]:
    """(folded key, start, end) of short pieces that interrupt a sentence: titles of headers that the book's pages don't show."""
    out = []
    gaps = list(GAP.finditer(text))
    for m, stop in zip(gaps, [*(g.start() for g in gaps[1:]), len(text)]):
        at, gap = m.end(), m[0]
        if not m.start() or not NO_END.match(text, m.start() - 1):
            continue
        piece = text[at:stop].strip()
        if not piece or not piece[0].isupper():
            continue
        words = piece.split(" ")
        if "\n" in gap:
            if len(words) <= TITLE_WORDS and not piece.endswith((".", "!", "?", "…", ",")) and at + len(piece) < len(text.rstrip()):
                out.append((fold(piece), at, at + len(piece)))
        else:
            heads = [" ".join(words[:k]) for k in range(2, min(len(words), TITLE_WORDS) + 1)]
            out += [(fold(h), at, at + len(h)) for h in heads]
    return out


def title_like(text: str) -> list[str]:
    return [key for key, _, _ in title_spans(text)]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without spans; the white space around one becomes a line break."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s < at:
            continue
        out.append(text[at:s].rstrip(" \n\r") + "\n")
        at = e + len(text[e:]) - len(text[e:].lstrip())
    out.append(text[at:])
    return "".join(out)


def blanked(text: str, broken: list[tuple[int, int, str, str, str]]) -> str:
    """The text without its broken words."""
    out, at = [], 0
    for s, e, *_ in sorted(broken):
        if s >= at:
            out.append(text[at:s])
            at = e
    return " ".join([*out, text[at:]]) if out else text


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, book, lang, text, first, last in zip(b.record_id, b.book_id, b.lang, b.text, b.page_start, b.page_end):
            pages = (None if pd.isna(first) else int(first), None if pd.isna(last) else int(last))
            rows += [(key, book, k) for k in header_candidates(form(text, lang), *pages)]
        yield pd.DataFrame(rows, columns=["record_id", "book_id", "key"]).astype({"record_id": "int64", "book_id": "Int64"})


def header_hits(scanned: DataFrame, headers: DataFrame) -> DataFrame:
    """(record_id, keys): of each paragraph the headers of its book that its own pieces are; pairs meet on (book, key)."""
    pieces = scanned.mapInPandas(_candidates, "record_id long, book_id long, key string")
    return pieces.join(headers.select("book_id", "key"), ["book_id", "key"], "left_semi").groupBy("record_id").agg(F.collect_set("key").alias("keys"))


def _paragraph_events(shared):
    def run(batches):
        for b in batches:
            rows = []
            for key, lang, text, first, last, keys in zip(b.record_id, b.lang, b.text, b.page_start, b.page_end, b["keys"]):
                text = form(text, lang)
                pages = (None if pd.isna(first) else int(first), None if pd.isna(last) else int(last))
                spans = paragraph_furniture(text, *pages, list(keys) if keys is not None else [])
                if spans:
                    rows.append(("paragraphs", key, lang, -1, "furniture", None, None, None))
                    text = without(text, spans)
                else:
                    rows += [("paragraphs", key, lang, -1, "maybe", k, None, None) for k in title_like(text)]
                broken = _hyphens(text, lang)
                rows += [("paragraphs", key, lang, -1, "hyphen", left, right, mark) for _, _, left, right, mark in broken]
                text = blanked(text, broken)
                for w, closing in tokens(text, lang, shared.value.get(lang, frozenset())):
                    rows.append(("paragraphs", key, lang, -1, "token", w, None, "!" if closing else None))
            yield _frame(rows)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["record_table", "record_id", "lang", "line_no", "kind", "a", "b", "mark"]).astype({"record_id": "int64", "line_no": "int32"})


def _page_events(shared):
    def run(batches):
        for b in batches:
            rows = []
            for key, lang, lines, drop in zip(b.page_id, b.lang, b.lines, b["furniture"]):
                gone = set(drop) if drop is not None else set()
                body = [(i, form(x, lang)) for i, x in enumerate(lines) if x and x.strip() and i not in gone]
                cut: dict[int, list[str]] = {}
                for k, (i, x) in enumerate(body):
                    for _, _, left_, right, mark in _hyphens(x, lang):
                        rows.append(("source_pages", key, lang, i, "hyphen", left_, right, mark))
                        cut.setdefault(i, []).extend((left_ + mark, right))
                    bare = x.rstrip()
                    left = bare[_left(bare, len(bare) - 1) : -1] if bare[-1:] and bare[-1] in MARKS else ""
                    if left and k + 1 < len(body):
                        r = re.match(r"\s*(\w[\w'’]*)", body[k + 1][1])
                        if r:
                            rows.append(("source_pages", key, lang, i, "hyphen", left, r[1], bare[-1]))
                            cut.setdefault(i, []).append(left + bare[-1])
                            cut.setdefault(body[k + 1][0], []).append(r[0])
                    elif left:
                        rows.append(("source_pages", key, lang, i, "open", left, None, bare[-1]))
                        cut.setdefault(i, []).append(left + bare[-1])
                if body and (r := re.match(r"\s*(\w[\w'’]*)", body[0][1])):
                    rows.append(("source_pages", key, lang, body[0][0], "first", r[1], None, None))
                for i, x in body:
                    for piece in cut.get(i, ()):
                        x = x.replace(piece, " ", 1) if not x.rstrip().endswith(piece) else x.rstrip()[: -len(piece)]
                    for w, closing in tokens(x + "\n", lang, shared.value.get(lang, frozenset())):
                        rows.append(("source_pages", key, lang, i, "token", w, None, "!" if closing else None))
            yield _frame(rows)

    return run


def sure_words(words: DataFrame) -> DataFrame:
    """(lang, word): of the KNOWN_WORDS most frequent words those that ``misread_words`` can't report."""
    top = words.where(f"n_clean >= {KNOWN}").orderBy(F.desc("n_clean"), "lang", "word").limit(KNOWN_WORDS).select("lang", "word", F.col("n_clean").alias("n_own"))
    top = materialise(top)
    most = words.groupBy("lang").agg(F.max("n_clean").alias("most"))  # one row for each of at most twelve languages
    asked = top.join(F.broadcast(most), "lang").where(F.col("most") >= RATIO * F.col("n_own"))
    read = asked.select("lang", "word", "n_own", F.explode(F.array_distinct(F.array("word", F.initcap("word"), F.upper("word")))).alias("a"))
    read = read.repartition("a").mapInPandas(_variants_of_sure, "lang string, own string, n_own long, word string")
    doubtful = read.join(words.where(f"n_clean >= {KNOWN * RATIO}"), ["lang", "word"]).where(F.col("n_clean") >= RATIO * F.col("n_own"))
    return top.join(doubtful.select("lang", F.col("own").alias("word")).distinct(), ["lang", "word"], "left_anti").select("lang", "word")


def _variants_of_sure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(lang, w, n, v) for lang, w, n, a in zip(b.lang, b.word, b.n_own, b.a) for v in variants(a)]
        yield pd.DataFrame(rows, columns=["lang", "own", "n_own", "word"])


def events(paragraphs: DataFrame, pages: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events of all scanned records, the vocabulary, the furniture lines of pages, the headers that each
    paragraph holds and the lines of pages that open chapters."""
    spark = pages.sparkSession
    words = materialise(vocabulary(paragraphs, pages))
    known: dict[str, set] = {}
    for r in sure_words(words).collect():
        known.setdefault(r.lang, set()).add(r.word)
    shared = spark.sparkContext.broadcast({k: frozenset(v) for k, v in known.items()})
    lines, headers, headings = furniture(pages, chapters)
    lines, headers = materialise(lines), materialise(headers)
    scanned = paragraphs.where(F.col("origin").startswith("pdf") & (F.length(F.trim("text")) > 0))
    p = scanned.select(F.col("paragraph_id").alias("record_id"), "book_id", "lang", "text", "page_start", "page_end")
    keys = materialise(header_hits(p, headers))
    p = p.join(keys, "record_id", "left")
    of_page = lines.groupBy("page_id").agg(F.collect_set("line_no").alias("furniture"))
    s = pages.where(F.size("lines") > 0).select("page_id", "lang", "lines").join(of_page, "page_id", "left")
    both = p.mapInPandas(_paragraph_events(shared), EVENTS).unionByName(s.mapInPandas(_page_events(shared), EVENTS))
    found = materialise(both)
    common = headers.where("common").select(F.col("key").alias("a")).distinct()
    titles = found.where("kind = 'maybe'").join(common, "a", "left_semi").withColumn("kind", F.lit("furniture")).select(*found.columns)
    return found.where("kind <> 'maybe'").unionByName(titles), words, lines, keys, headings


def hyphen_verdicts(found: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates of broken words, with ``good`` where the vocabulary prefers the joined form, and ``own`` where the
    mark belongs to a compound that goes on without a space."""
    at = pages.select("page_id", "book_id", "page_number")
    ends = found.where("kind = 'open'").join(at.withColumnRenamed("page_id", "record_id"), "record_id")
    starts = found.where("kind = 'first'").select(F.col("record_id").alias("page_id"), F.col("a").alias("next")).join(at, "page_id")
    starts = starts.select("book_id", (F.col("page_number") - 1).alias("page_number"), "next")
    over = ends.join(starts, ["book_id", "page_number"]).select("record_table", "record_id", "lang", "line_no", "a", F.col("next").alias("b"), "mark")
    cases = found.where("kind = 'hyphen'").select("record_table", "record_id", "lang", "line_no", "a", "b", "mark").unionByName(over)
    each = cases.select("lang", "a", "b").distinct()
    asked = each.select("lang", "a", "b", F.explode(F.array(
        F.struct(F.lit("joined").alias("as"), F.lower(F.concat("a", "b")).alias("word")),
        F.struct(F.lit("kept").alias("as"), F.lower(F.concat("a", F.lit("-"), "b")).alias("word")),
        F.struct(F.lit("left").alias("as"), F.lower("a").alias("word")),
        F.struct(F.lit("right").alias("as"), F.lower("b").alias("word")),
    )).alias("q")).select("lang", "a", "b", "q.as", "q.word")
    counts = asked.join(words, ["lang", "word"], "left").groupBy("lang", "a", "b").pivot("as", ["joined", "kept", "left", "right"]).agg(
        F.max(F.coalesce(F.col("n_clean") * 4 + F.col("n_scan"), F.lit(0)))
    )
    judged = cases.join(counts, ["lang", "a", "b"])
    plain = F.col("mark").isin("-", "‐", "‑", "­")
    small = F.lower("b") == F.col("b")
    unsure = (F.col("joined") == 0) & (F.col("kept") == 0)
    good = (
        F.when(F.col("mark") == "¬", F.lit(True))
        .when(plain, (F.col("joined") > F.col("kept")) | (unsure & small & ~((F.col("left") > 8) & (F.col("right") > 8))))
        .otherwise((F.col("joined") > 0) & small)
    )
    good = good & ~F.col("a").rlike("^[0-9]+$")
    own_mark = ~good & plain & ((F.col("kept") > 0) | ~small)
    return judged.select("record_table", "record_id", "lang", "line_no", "a", "b", "mark", "joined", good.alias("good"), own_mark.alias("own"))


def hyphen_cases(found: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """Broken words: candidates whose joined form the vocabulary prefers."""
    return hyphen_verdicts(found, words, pages).where("good").drop("good", "own")


def misread_words(found: DataFrame, broken: DataFrame, words: DataFrame) -> DataFrame:
    """(record_table, record_id, line_no, lang, a, reading) of misread tokens."""
    loose = found.where("kind = 'token'").select("record_table", "record_id", "lang", "line_no", "a", "mark")
    joined = broken.where("joined = 0").select("record_table", "record_id", "lang", "line_no", F.concat("a", "b").alias("a"), F.lit(None).cast("string").alias("mark"))
    tokens_ = loose.unionByName(joined)
    types = tokens_.select("lang", "a").distinct().withColumn("low", F.lower("a"))
    own_counts = words.select("lang", F.col("word").alias("low"), F.col("n_clean").alias("n_own"))
    types = types.join(own_counts, ["lang", "low"], "left").select("lang", "a", F.coalesce("n_own", F.lit(0)).alias("n_own"))
    read = types.repartition("lang", "a").mapInPandas(_variants_with_own, "lang string, a string, n_own long, word string")
    best = (
        read.join(words.where(f"n_clean >= {KNOWN} or n_scan >= {SEEN}"), ["lang", "word"])
        # a token with a sign inside that clean books don't know is no word; its reading may be one that only scanned books have
        .where(((F.col("n_clean") >= KNOWN) & (F.col("n_clean") >= RATIO * F.col("n_own"))) | ((F.col("n_own") < KNOWN) & F.col("a").rlike(r"[\p{L}][0-9!@|$]|[0-9!@|$][\p{L}]") & (F.col("n_scan") >= SEEN)))
        .groupBy("lang", "a")
        .agg(F.max(F.struct("n_clean", F.col("word").alias("reading"))).alias("best"))
        .select("lang", "a", "best.reading")
    )
    return tokens_.join(best, ["lang", "a"]).select("record_table", "record_id", "line_no", "lang", "a", "reading")


def _variants_with_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(lang, w, n, v) for lang, w, n in zip(b.lang, b.a, b.n_own) for v in variants(w)]
        yield pd.DataFrame(rows, columns=["lang", "a", "n_own", "word"])


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paragraphs, pages and chapters, each key once."""
    lang = lang_code(F.col("lang")).alias("lang")
    p = once_of(spark, sf_dir, "paragraphs", ["paragraph_id"], ["book_id", "origin", "text", lang, "page_start", "page_end"])
    s = once_of(spark, sf_dir, "source_pages", ["page_id"], ["book_id", "page_number", "lines", lang])
    c = once_of(spark, sf_dir, "chapters", ["chapter_id"], ["book_id", "chapter_title", "page_start"])
    return p, s, c


def noise(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Furniture, broken words and misread words of all scanned records."""
    p, s, c = inputs(spark, sf_dir)
    found, words, lines, _, _ = events(p, s, c)
    pages = table(spark, sf_dir, "source_pages").select("page_id", "book_id", "page_number").distinct()
    broken = materialise(hyphen_cases(found, words, pages))
    misread = misread_words(found, broken, words)
    on_pages = lines.select(F.lit("source_pages").alias("record_table"), F.col("page_id").alias("record_id"), "line_no")
    inside = found.where("kind = 'furniture'").select("record_table", "record_id", "line_no")
    return on_pages.unionByName(inside), broken, misread


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge, broken, misread = noise(spark, sf_dir)
    key = ["record_table", "record_id", "line_no"]
    return (
        edge.select(*key, F.lit("furniture").alias("kind"))
        .unionByName(broken.select(*key, F.lit("hyphen").alias("kind")))
        .unionByName(misread.select(*key, F.lit("misread").alias("kind")))
        .distinct()
    )


def _read(text: str, words) -> str:
    """The text with its misread words as they read."""
    for w in words if words is not None else []:
        right = w["reading"]
        right = right.upper() if w["a"].isupper() and len(w["a"]) > 1 else right.capitalize() if w["a"][0].isupper() or w["a"][0] in "0158|" and right and text.startswith(w["a"]) else right
        text = re.sub(rf"(?<!\w){re.escape(w['a'])}(?!\w)", lambda _, r=right: r, text)
    return text


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for lang, text, first, last, keys, titles, joins, words in zip(b.lang, b.text, b.page_start, b.page_end, b["keys"], b.titles, b.joins, b.words):
            text = form(text, lang)
            spans = paragraph_furniture(text, None if pd.isna(first) else int(first), None if pd.isna(last) else int(last), list(keys) if keys is not None else [])
            if not spans and titles is not None:
                known = set(titles)
                # the longest piece that is a title, where several begin at one place
                spans = list({s: (s, e) for key, s, e in sorted(title_spans(text), key=lambda x: x[2]) if key in known}.values())
            text = without(text, spans) if spans else text
            for j in joins if joins is not None else []:
                gap = r"\s*" if j["good"] else r"\s+"
                text = re.sub(rf"(?<!\w){re.escape(j['a'])}([{MARKS}]){gap}{re.escape(j['b'])}(?!\w)", lambda m, j=j: j["a"] + ("" if j["good"] else m[1]) + j["b"], text)
            text = _read(text, words)
            out.append(re.sub(r"[^\S\n]*\r?\n[^\S\n]*|[^\S\n]{2,}", " ", re.sub(r"\n\s*\n", "\n", text)).strip())
        yield pd.DataFrame({"record_table": "paragraphs", "record_id": b.record_id, "line_no": -1, "book_id": b.book_id, "text": out}).astype({"line_no": "int32"})


def _line_gap(left: str, right: str) -> str:
    """What stands between two lines of a paragraph: nothing in scripts without spaces."""
    return "" if UNSPACED.fullmatch(left[-1:]) and UNSPACED.fullmatch(right[:1]) else " "


def page_paragraphs(pages: list[tuple], width: int, spaced: bool) -> list[tuple[int, int, bool, str, str]]:
    """(page_id, line_no, begins, gap, text) of the paragraphs of consecutive pages, each at the line where it begins.

    ``pages``: (page_id, number, lang, lines, furniture, heading, joins, words) in order.  Paragraphs end at blank
    lines; in books without them (not ``spaced``), after a line that closes a sentence and had room for the next word in
    the book's ``width``.  A paragraph goes on overleaf, but not over a page that is missing.  The first part of a page
    is one of its own; ``begins`` tells whether it begins a paragraph, ``gap`` what stands before it if it doesn't.
    """
    at, texts, numbers_, joins, words, blanks, headings = [], [], [], [], [], [], []
    for page, number, lang, lines, gone, heading, joins_, words_ in pages:
        gone, blank = set(gone if gone is not None else ()), False
        for i, x in enumerate(lines):
            if not x or not x.strip():
                blank = True
            elif i not in gone:
                at.append((page, i))
                texts.append(form(x, lang).strip())
                numbers_.append(None if pd.isna(number) else int(number))
                joins.append([j for j in (joins_ if joins_ is not None else ()) if j["line_no"] == i])
                words.append([w for w in (words_ if words_ is not None else ()) if w["line_no"] == i])
                blanks.append(blank)
                headings.append(i == heading)
                blank = False
        # a blank line at the foot of a page
        if blank and at and at[-1][0] == page:
            texts[-1] += "\n"
    begins = []
    for k, text in enumerate(texts):
        if k == 0 or blanks[k] or headings[k] or headings[k - 1] or texts[k - 1].endswith("\n"):
            begins.append(True)
        elif overleaf := at[k][0] != at[k - 1][0]:
            follows = numbers_[k] is not None and numbers_[k - 1] is not None and numbers_[k] == numbers_[k - 1] + 1
            begins.append(not follows or _closes(texts[k - 1], text, width))
        else:
            begins.append(not overleaf and not spaced and _closes(texts[k - 1], text, width))
    texts = [x.strip() for x in texts]
    gaps = [_line_gap(x, y) for x, y in zip(texts, texts[1:])]
    for k in range(len(texts)):
        for j in joins[k]:
            a, b = re.escape(j["a"]), re.escape(j["b"])
            put = lambda m, j=j: j["a"] + ("" if j["good"] else m[1]) + j["b"]
            texts[k] = re.sub(rf"(?<!\w){a}([{MARKS}]){r'\s*' if j['mark'] == '¬' else r'\s+'}{b}(?!\w)", put, texts[k])
            # the other half stands in the next line: it comes up, the signs after it too
            end = re.search(rf"(?<!\w){a}([{MARKS}])\Z", texts[k])
            rest = re.match(rf"{b}(?![\w'’])\S*\s*", texts[k + 1]) if end and k + 1 < len(texts) else None
            if rest:
                texts[k] = texts[k][: end.start()] + put(end) + rest[0].rstrip()[len(j["b"]) :]
                texts[k + 1] = texts[k + 1][rest.end() :]
                begins[k + 1] = False
    out: list[list] = []
    for k, text in enumerate(texts):
        gap = "" if k == 0 else gaps[k - 1] if texts[k - 1] else " "
        if begins[k] or k == 0 or at[k][0] != at[k - 1][0]:
            out.append([*at[k], begins[k], gap, _read(text, words[k])])
        elif text:
            out[-1][4] += gap + _read(text, words[k])
    return [(p, i, b, g, re.sub(r"\s+", " ", x).strip()) for p, i, b, g, x in out]


def _closes(line: str, after: str, width: int) -> bool:
    """True if a line ends a sentence and had room for the next word."""
    return bool(CLOSED.search(line)) and len(line) + 1 + len(after.split(maxsplit=1)[0]) <= width


def _chunk_paragraphs(b: pd.DataFrame) -> pd.DataFrame:
    """Parts of paragraphs of a chunk's own pages; the page before and the one after it are there for words that go on."""
    b = b.sort_values(["page_number", "page_id"])
    found = page_paragraphs(
        list(zip(b.page_id, b.page_number, b.lang, b.lines, b["furniture"], b.heading, b.joins, b.words)), int(b.width.max() or 0), bool(b.spaced.max())
    )
    own = {p: n for p, n, o in zip(b.page_id, b.page_number, b.own) if o}
    rows = [(p, b.book_id.iloc[0], None if pd.isna(own[p]) else int(own[p]), i, begins, gap, text) for p, i, begins, gap, text in found if p in own]
    return pd.DataFrame(rows, columns=["record_id", "book_id", "page_number", "line_no", "begins", "gap", "text"]).astype({"page_number": "Int32", "line_no": "int32"})


PARTS = "record_id long, book_id long, page_number int, line_no int, begins boolean, gap string, text string"
#: Pages of a book that one task takes; a longer book is several chunks.
CHUNK = 64


def leaf_paragraphs(leaves: DataFrame) -> DataFrame:
    """Paragraphs of ``leaves(page_id, book_id, page_number, lang, lines, furniture, heading, joins, words)``.

    A book comes in chunks of pages, each with the page before and after it, so a book of any length is spread; parts of
    a paragraph that goes on overleaf are put together by a running count of beginnings.
    """
    signs = F.array_join(F.transform("lines", lambda x, i: F.when(F.coalesce(F.trim(x), F.lit("")) == "", "_").when(i == F.col("heading"), "h").otherwise("x")), "")
    lengths = F.transform(F.filter("lines", lambda x: F.length(x) > 0), lambda x: F.length(F.trim(x)))
    sizes = leaves.select("book_id", F.explode(lengths).alias("n")).groupBy("book_id").agg(F.percentile_approx("n", 0.98).alias("width"))
    blanks = leaves.groupBy("book_id").agg(F.max(signs.rlike("x_+[xh]")).alias("spaced"))
    numbered = leaves.withColumn("chunk", F.floor(F.coalesce("page_number", F.lit(-1)) / CHUNK))
    with_edges = numbered.withColumn("to", F.explode(F.array_distinct(F.array("chunk", F.floor((F.coalesce("page_number", F.lit(-1)) - 1) / CHUNK), F.floor((F.coalesce("page_number", F.lit(-1)) + 1) / CHUNK)))))
    with_edges = with_edges.withColumn("own", F.col("to") == F.col("chunk")).drop("chunk").join(sizes, "book_id", "left").join(blanks, "book_id", "left")
    parts = materialise(with_edges.groupBy("book_id", "to").applyInPandas(_chunk_paragraphs, PARTS))
    order = ["page_number", "record_id", "line_no"]
    counted = running(parts.withColumn("one", F.col("begins").cast("int")), ["book_id"], order, k=("one", "sum"))
    pieces = F.array_sort(F.collect_list(F.struct("page_number", "record_id", "line_no", "gap", "text")))
    whole = counted.groupBy("book_id", "k").agg(pieces.alias("p"))
    first = F.col("p")[0]
    text = F.aggregate("p", F.lit(""), lambda s, x: F.when(s == "", x["text"]).when(x["text"] == "", s).otherwise(F.concat(s, x["gap"], x["text"])))
    rows = whole.select(F.lit("source_pages").alias("record_table"), first["record_id"].alias("record_id"), first["line_no"].alias("line_no"), "book_id", F.trim(text).alias("text"))
    return rows.where("text <> ''")


PARAGRAPHS = "record_table string, record_id long, line_no int, book_id long, text string"


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned paragraphs and pages as continuous text: furniture dropped, words joined and read.

    A row of 'paragraphs' is a paragraph (line_no -1); one of 'source_pages' is a paragraph of the book's pages, at the
    page and line where it begins.  Pages without a number and those after a gap begin a paragraph.
    """
    p, s, c = inputs(spark, sf_dir)
    found, words, lines, keys, headings = events(p, s, c)
    pages = table(spark, sf_dir, "source_pages").select("page_id", "book_id", "page_number").distinct()
    verdicts = materialise(hyphen_verdicts(found, words, pages))
    misread = materialise(misread_words(found, verdicts.where("good").drop("good", "own"), words))
    key = ["record_table", "record_id"]
    joins = verdicts.where("good or own").groupBy(*key).agg(F.collect_set(F.struct("line_no", "a", "b", "mark", "good")).alias("joins"))
    read = misread.groupBy(*key).agg(F.collect_set(F.struct("line_no", "a", "reading")).alias("words"))
    titles = found.where("kind = 'furniture' and a is not null").groupBy(*key).agg(F.collect_set("a").alias("titles"))
    rows = p.where(F.col("origin").startswith("pdf") & F.col("text").isNotNull())
    rows = rows.select(F.lit("paragraphs").alias("record_table"), F.col("paragraph_id").alias("record_id"), "book_id", "text", "lang", "page_start", "page_end")
    rows = rows.join(keys, "record_id", "left").join(titles, key, "left").join(joins, key, "left").join(read, key, "left")
    of_page = lines.groupBy("page_id").agg(F.collect_set("line_no").alias("furniture"))
    leaves = s.where(F.size("lines") > 0).join(of_page, "page_id", "left").join(headings, "page_id", "left").withColumn("record_table", F.lit("source_pages")).withColumn("record_id", F.col("page_id"))
    leaves = leaves.join(joins, key, "left").join(read, key, "left")
    inside = rows.mapInPandas(_repair, PARAGRAPHS)
    return inside.unionByName(leaf_paragraphs(leaves))
