"""Lines, cleaning and chapters of documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions import text as T

def document_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): normalised lines that hold something; line numbers count from 0."""
    split = documents.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    return split.select("doc_id", "line_no", T.normalize_space(F.col("line")).alias("line")).where("line <> ''")


def is_contents(lines: Column) -> Column:
    """(leaders, numbered, flag) of a page's lines: whether it is a table of contents by dotted leaders, many chapter or
    numbered lines, or its title."""
    x = F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda s: T.normalize_space(s))
    many = lambda p: F.size(F.filter(x, lambda s: s.rlike(p)))
    leaders, chapters, numbered = many(r"\.{4,} *[0-9]+"), many(r"(?iu)^(?:Chương|Chapter) +"), many(r"^[0-9]{1,2} +[^ ]+")
    bare, parts = many(r"^[0-9]{1,2}$"), many(r"(?iu)^(?:PHẦN +(?:THỨ +.+|[0-9]{1,2})|PART +[0-9]{1,2})$")
    titled = many(r"(?iu)^(?:mục lục|table of contents)$")
    flag = (titled > 0) | (leaders >= 2) | (chapters >= 4) | (numbered >= 4) | ((bare >= 4) & (parts >= 1)) | (parts >= 3)
    return F.struct(leaders.alias("leaders"), numbered.alias("numbered"), flag.alias("flag"))


def contents_pages(pages: DataFrame) -> DataFrame:
    """Whether a page is a table of contents."""
    told = pages.select("page_id", is_contents(F.col("lines")).alias("c"))
    return told.select("page_id", "c.leaders", "c.numbered", F.col("c.flag").alias("is_contents"))


def repeated_lines(lines: DataFrame, most_words: int = 14, least: int = 3) -> DataFrame:
    """Lines that repeat as headers and footers do: (book_id, key, n) of keys used ``least`` times or more.

    Counting needs no window: it is a combined aggregation, so a frequent key isn't gathered anywhere.
    """
    key = T.dedupe_key(F.col("line"))
    keyed = lines.select("book_id", key.alias("key")).where("key <> ''")
    return keyed.groupBy("book_id", "key").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (T.word_count(F.col("key")) <= most_words))


# What counts as a keyword's letters, and as capital and small letters of names.
KEYWORD = re.compile(r"[a-zà-ỹ_]{3,}")
NAME = re.compile(r"\b[A-ZÀ-Ỹ][a-zà-ỹ]+\s[A-ZÀ-Ỹ][a-zà-ỹ]+(?:\s[A-ZÀ-Ỹ][a-zà-ỹ]+)*\b")
#: Characters of a text in which names are looked for.
NAME_HEAD = 50_000


def _most_used(find: Callable[[str], list[str]], key: str, name: str, k: int):
    """Counts within each row, in Arrow batches: a row's words never leave it, so nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # most_common keeps the order of first use among equals
            rows = [(x, w, n, r) for x, t in zip(b[key], b.text) if t for r, (w, n) in enumerate(Counter(find(t)).most_common(k), 1)]
            yield pd.DataFrame(rows, columns=[key, name, "n", "rank"])

    return run


def keywords(texts: DataFrame, key: str, stop: list[str], k: int = 10) -> DataFrame:
    """The k most frequent words of each text, ties by first use: (key, word, n, rank).  Null and empty texts have none."""
    out = frozenset(stop)

    def find(text: str) -> list[str]:
        return [w for w in re.findall(r"\w+", text.lower()) if w not in out and KEYWORD.fullmatch(w)]

    return texts.select(key, "text").mapInPandas(_most_used(find, key, "word", k), f"{key} long, word string, n long, rank int")


def entities(texts: DataFrame, key: str, k: int = 5, head: int = NAME_HEAD) -> DataFrame:
    """Runs of two or more capitalised words in a text's first ``head`` characters, the k most frequent of each text."""
    return texts.select(key, "text").mapInPandas(_most_used(lambda t: NAME.findall(t[:head]), key, "name", k), f"{key} long, name string, n long, rank int")


def sentence_stub(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stand-in for a model's summary: the first 200 characters."""
    for b in batches:
        yield pd.DataFrame({"doc_id": b.doc_id, "chunk_no": b.chunk_no, "summary": [t[:200] for t in b.chunk]})
