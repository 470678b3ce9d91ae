"""Chapters of paged books, and blocks merged into paragraphs.

A page's lines become a string of letters, one for each kind of line; what opens a
chapter is a pattern over that string.  What a page needs to know of the pages
before it (the part it belongs to, whether a chapter marker still waits for its
title, whether a chapter is open) is carried by running values over the pages'
summaries, so a book is never gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookloom.functions import text as T
from bookloom.operators.documents import is_contents
from bookloom.operators.tables import has_hot_key, materialise, running

# What marks chapters, parts and supplements.
ORDINAL = "NHẤT|NHÌ|HAI|BA|BỐN|TƯ|NĂM|SÁU|BẢY|TÁM|CHÍN|MƯỜI|MỘT|MỐT|MƯƠI|ĐỘC NHẤT"
MARKER = rf"(?:CHƯƠNG|CHUONG|CHAPTER|KAPITEL|CHAPITRE|CAPÍTULO|ГЛАВА)\s+(?:{ORDINAL}|[IVXLCDM]+|\d+)"
# the patterns of parts and bare markers as Java reads them, on lines with single plain spaces
BARE = rf"(?iu)^{MARKER.replace(chr(92) + 's+', ' ')} *:?$"
PART = r"(?iu)^(?:PHẦN (?:THỨ .+|[0-9]{1,2})|PART [0-9]{1,2})$"
KINDS = [
    ("S", re.compile(r"\s*(?:LỜI\s+NHÀ\s+XUẤT\s+BẢN|VÀI\s+LỜI\s+THƯA\s+TRƯỚC|TỰA|GIỚI\s+THIỆU|BẢNG\s+THUẬT\s+NGỮ|PHỤ\s+LỤC.*|PREFACE|INTRODUCTION|APPENDIX.*|GLOSSARY)\s*\Z", re.I)),
    ("P", re.compile(r"\s*(?:PHẦN\s+(?:THỨ\s+.+|\d{1,2})|PART\s+\d{1,2})\s*\Z", re.I)),
    ("M", re.compile(rf"\s*{MARKER}\s*:?\s*\Z", re.I)),
    ("N", re.compile(r"\s*\d{1,2}\s*\Z")),
    ("I", re.compile(rf"\s*{MARKER}\s*[:.\-]", re.I)),
]
#: Most words of a line that can be a heading, and of one that opens a chapter by itself.
HEADING_WORDS, INLINE_WORDS = 16, 18
FALLBACK_TITLE, FIRST_TITLE = "Nội dung", "Mở đầu"
CLOSED = re.compile(r"[.!?…”\"]\Z")
# What takes lines together: a marker with the parts and the title after it, a supplement, a part, an inline heading.
EVENT = re.compile(r"M(?P<parts>P*)(?P<title>H+|[MIB])?|(?P<supplement>S)|(?P<part>P)|(?P<inline>I)")

CHAPTERS = "book_id long, chapter_no int, title string, page_start int, page_end int, paragraphs array<string>"
SUMMARY = "page_id long, book_id long, page_number int, lines array<string>, kinds string, part_in string, waits_in boolean, chapter string"
PIECES = "page_id long, book_id long, page_number int, starts int, pieces array<struct<chapter: int, kind: string, breaks: int, text: string>>, breaks int"


def kind(line: str) -> str:
    """A line's letter: supplement, part, marker, number, inline heading, heading-like or body."""
    for letter, pattern in KINDS:
        if pattern.match(line) and (letter != "I" or len(line.split()) <= INLINE_WORDS):
            return letter if letter != "M" or is_capital(line) else "m"
    return "H" if is_capital(line) else "B"


def is_capital(line: str) -> bool:
    letters = re.sub(r"[\W\d_]", "", line)
    return (bool(letters) and letters == letters.upper() or line.strip().casefold() == "action") and len(line.split()) <= HEADING_WORDS


def shape(lines: list[str]) -> str:
    """The letters of a page's lines.  A number is a heading only before one: then it is 'n', else body."""
    return re.sub("n(?![HSPM])", "B", "".join(map(kind, lines)).replace("N", "n")).replace("m", "M")


def outline(lines: list[str], kinds: str, part: str | None, waits: bool, title: str | None, numbers_alone: bool = False):
    """What happens on a page: (starts, pieces, breaks, title at the end) where a piece is (chapter on the page, kind,
    breaks before it, text).  Chapter 0 is the one that is open when the page begins, if ``title`` isn't null.
    """
    if part or numbers_alone:
        kinds = kinds.replace("n", "M")
    elif "P" in kinds and "n" in kinds:
        at = kinds.index("P")
        kinds = kinds[:at] + kinds[at:].replace("n", "M")
    kinds = ("M" if waits else "") + kinds.replace("n", "B")
    lines = ([""] if waits else []) + lines
    pieces, starts, breaks, at = [], 0, 0, 0
    for m in [*EVENT.finditer(kinds), None]:
        end = m.start() if m else len(kinds)
        for text in lines[at:end]:
            if title is not None and text.casefold() != title.casefold():
                pieces.append((starts, "body", breaks, text))
                breaks += bool(CLOSED.search(text))
        if m is None:
            break
        at = m.end()
        # the title of the open chapter, said again at the head of a page
        if (m["inline"] or m["part"]) and title is not None and lines[m.start()].casefold() == title.casefold():
            continue
        breaks += 1
        if m["supplement"]:
            title = None
            continue
        named = [i for i in range(m.start(), m.end()) if kinds[i] == "P"]
        part = lines[named[-1]] if named else part
        own = None
        if m["inline"]:
            own = re.sub(r"\.{3,}.*", "", lines[m.start()]).strip()
        elif m["title"]:
            own = " ".join(lines[m.end() - len(m["title"]) : m.end()])
        if own is not None:
            title, starts = f"{part} - {own}" if part else own, starts + 1
            pieces.append((starts, "title", breaks, title))
    return starts, pieces, breaks, title


def _summaries(numbers_alone: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, book, number, lines, part, waits in zip(b.page_id, b.book_id, b.page_number, b.lines, b.part_in, b.waits_in):
                lines, waits = list(lines), waits is True or waits == 1
                kinds = shape(lines)
                # the title with which a page ends, '' after a supplement, null where nothing opens or closes a chapter
                *_, last = outline(lines, kinds, part, waits, None, numbers_alone)
                rows.append((page, book, number, lines, kinds, part, waits, "" if last is None and "S" in kinds else last))
            yield pd.DataFrame(rows, columns=["page_id", "book_id", "page_number", "lines", "kinds", "part_in", "waits_in", "chapter"])

    return run


def _resolved(numbers_alone: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, book, number, lines, kinds, part, waits, title in zip(b.page_id, b.book_id, b.page_number, b.lines, b.kinds, b.part_in, b.waits_in, b.chapter_in):
                starts, pieces, breaks, _ = outline(list(lines), kinds, part, bool(waits), title or None, numbers_alone)
                rows.append((page, book, number, starts, pieces, breaks))
            yield pd.DataFrame(rows, columns=["page_id", "book_id", "page_number", "starts", "pieces", "breaks"])

    return run


def detect_chapters(pages: DataFrame, numbers_alone: bool = False) -> DataFrame:
    """Chapters of ``pages(page_id, book_id, page_number, lines)``; contents pages are left out, unless they are all there is.

    A book without any heading is one chapter under a stand-in title.  Pages without a number or without lines give
    nothing.  Of markers in a row each second one is the title of the one before it.  Two passes over the pages: their
    summaries, and, with what earlier pages carry over, their pieces; a chapter's pieces are gathered by chapter.
    """
    kept = F.filter(F.transform("lines", lambda s: T.normalize_space(s)), lambda s: ~T.is_noise_line(s))
    given = pages.where("page_number is not null and book_id is not null").select("page_id", "book_id", "page_number", "lines")
    hot = has_hot_key(given, ["book_id"])
    many = given.groupBy("book_id").agg((F.count("*") > 1).alias("many"))
    given = given.withColumn("is_contents", is_contents(F.col("lines"))["flag"]).join(many, "book_id").where("not (is_contents and many)")
    lined = given.select("page_id", "book_id", "page_number", kept.alias("lines")).where("size(lines) > 0")
    order = ["page_number", "page_id"]
    parts = F.filter("lines", lambda s: s.rlike(PART))
    # a page ends waiting for a title if an odd number of markers ends it, parts aside
    tail = F.regexp_extract(F.array_join(F.transform("lines", lambda s: F.when(s.rlike(BARE), "M").when(s.rlike(PART), "P").otherwise("B")), ""), "[MP]*$", 0)
    first = lined.withColumns({"part": F.try_element_at(parts, F.lit(-1)), "waits": F.regexp_count(tail, F.lit("M")) % 2 == 1})
    parted = running(first, ["book_id"], order, hot, part_in=("part", "before"), waits_in=("waits", "lag"))
    told = parted.mapInPandas(_summaries(numbers_alone), SUMMARY)
    carried = running(told, ["book_id"], order, hot, chapter_in=("chapter", "before"))
    found = materialise(carried.mapInPandas(_resolved(numbers_alone), PIECES))
    placed = running(found, ["book_id"], order, hot, to_start=("starts", "sum"), to_break=("breaks", "sum"))
    rows = placed.select("book_id", *order, F.col("to_start") - F.col("starts"), F.col("to_break") - F.col("breaks"), F.posexplode("pieces").alias("k", "p")).toDF("book_id", *order, "c0", "b0", "k", "p")
    rows = rows.select("book_id", *order, "k", (F.col("c0") + F.col("p.chapter")).alias("c"), (F.col("b0") + F.col("p.breaks")).alias("b"), F.col("p.kind").alias("kind"), F.col("p.text").alias("text"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "k", c))), lambda x: x[c])
    titles = rows.where("kind = 'title'").select("book_id", "c", F.col("text").alias("title"), F.col("page_number").alias("page_start"))
    paragraphs = rows.where("kind = 'body'").groupBy("book_id", "c", "b").agg(F.array_join(ordered("text"), " ").alias("text"), F.max("page_number").alias("page_end"))
    bodies = paragraphs.groupBy("book_id", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "text"))), lambda x: x["text"]).alias("paragraphs"), F.max("page_end").alias("page_end"))
    chapters = titles.join(bodies, ["book_id", "c"]).withColumn("one", F.lit(1))
    numbered = running(chapters, ["book_id"], ["c"], hot, n=("one", "count"))
    chapters = numbered.select("book_id", (F.col("n") - 1).cast("int").alias("chapter_no"), "title", "page_start", "page_end", "paragraphs")
    rest = lined.join(chapters.select("book_id").distinct(), "book_id", "left_anti")
    whole = rest.groupBy("book_id").agg(F.max("page_number").alias("page_end"), F.array_sort(F.collect_list(F.struct(*order, "lines"))).alias("all"))
    text = F.array_join(F.flatten(F.transform("all", lambda x: x["lines"])), " ")
    whole = whole.select("book_id", F.lit(0).alias("chapter_no"), F.lit(FALLBACK_TITLE).alias("title"), F.lit(1).alias("page_start"), "page_end", F.array(text).alias("paragraphs"))
    return chapters.unionByName(whole)


def text_pages(texts: DataFrame) -> DataFrame:
    """``texts(book_id, text)`` as pages for ``detect_chapters``: a text is one page."""
    return texts.select(F.col("book_id").alias("page_id"), "book_id", F.lit(1).alias("page_number"), T.lines(F.col("text")).alias("lines"))


def merged_blocks(blocks: DataFrame, most: int = 50, loose: int = 3) -> DataFrame:
    """``blocks(book_id, chapter_index, block_no, text, is_heading)`` merged within each chapter.

    A paragraph ends before a heading, with its ``most``-th sentence, and with each ``loose``-th block in a row that
    ends no sentence.  A sentence is a block that ends one, or a row of blocks that end none.  Empty blocks are dropped;
    every block is in one paragraph.
    """
    keys, order = ["book_id", "chapter_index"], ["block_no"]
    hot = has_hot_key(blocks, keys)
    b = blocks.where("is_heading or length(text) > 0").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("one", F.lit(1))
    b = b.withColumn("open", ~F.col("is_heading") & ~T.ends_sentence(F.col("text")))
    b = running(b, keys, order, hot, n=("one", "count"))
    b = running(b.withColumn("shut", F.when(~F.col("open"), F.col("n"))), keys, order, hot, last_shut=("shut", "last"))
    row = F.when(F.col("open"), F.col("n") - F.coalesce("last_shut", F.lit(0))).otherwise(0)
    b = b.withColumn("row", row).withColumn("cut", (F.col("is_heading") | (F.col("row") > 0) & (F.col("row") % loose == 0)).cast("int"))
    # a row's first block, and the first after a cut inside it, begin a sentence
    b = b.withColumn("sentence", ((F.col("row") == 0) | (F.col("row") % loose == 1)).cast("int"))
    b = running(b, keys, order, hot, cuts=("cut", "sum"))
    b = b.withColumn("group", F.col("cuts") - F.when(F.col("is_heading"), 0).otherwise(F.col("cut")))
    b = running(b, [*keys, "group"], order, hot, sentences=("sentence", "sum"))
    b = b.withColumn("piece", F.when(F.col("is_heading"), -1).otherwise(F.floor((F.greatest("sentences", F.lit(1)) - 1) / most)))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), " ")
    out = b.groupBy(*keys, "group", "piece", "is_heading").agg(F.min("block_no").alias("first"), T.normalize_space(said).alias("text"))
    numbered = running(out.withColumn("one", F.lit(1)), keys, ["first"], hot, n=("one", "count"))
    return numbered.select(*keys, (F.col("n") - 1).cast("int").alias("block_no"), "text", "is_heading")


def grouped_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks(book_id, block_no, text, is_heading)`` as (book_id, chapter_no, title, n_blocks, text): a heading begins a chapter.

    What stands before the first heading is a chapter under a stand-in title; chapters without a body are dropped.
    """
    b = running(blocks.withColumn("h", F.col("is_heading").cast("int")), ["book_id"], ["block_no"], c=("h", "sum"))
    own = F.max(F.when(F.col("is_heading"), F.trim("text"))).alias("title")
    body = ~F.col("is_heading") & (F.length(F.trim("text")) > 0)
    parts = F.array_sort(F.collect_list(F.when(body, F.struct("block_no", F.trim("text").alias("t")))))
    each = b.groupBy("book_id", "c").agg(own, F.sum(body.cast("int")).alias("n_blocks"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text")).where("n_blocks > 0")
    each = running(each.withColumn("one", F.lit(1)), ["book_id"], ["c"], n=("one", "count"))
    return each.select("book_id", (F.col("n") - 1).cast("int").alias("chapter_no"), F.coalesce("title", F.lit(FIRST_TITLE)).alias("title"), "n_blocks", "text")


def without_repeats(blocks: DataFrame, most_words: int = 14, least: int = 3) -> DataFrame:
    """Blocks without those that a book repeats as headers and footers do; headings always stay.

    Keys are counted by a combined aggregation and met in a join, so a frequent one isn't gathered anywhere.
    """
    keyed = blocks.withColumn("_key", T.dedupe_key(F.col("text")))
    often = keyed.where("_key <> ''").groupBy("book_id", "_key").agg(F.count("*").alias("_n")).where((F.col("_n") >= least) & (T.word_count(F.col("_key")) <= most_words))
    often = often.select("book_id", "_key", F.lit(True).alias("_repeats"))
    return keyed.join(often, ["book_id", "_key"], "left").where("is_heading or _repeats is null").drop("_key", "_repeats")
