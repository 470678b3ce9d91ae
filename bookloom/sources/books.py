"""Books and recordings from files: text, EPUB, WAV headers and pipe-separated metadata."""

from __future__ import annotations

import io
import posixpath
import re
import wave
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bookloom.sources.html import blocks

BLOCKS = "path string, item_no int, item string, title string, block_no int, kind string, text string"
# Items before and after a book's own text.
FRONT = re.compile(r"(?:^|[\s_\-/])(?:cover|title-?page|copyright|toc|contents|nav|intro(?:duction)?|preface|dedication|bia|muc-?luc|gioi-?thieu)\b", re.I)
BACK = re.compile(r"(?:^|[\s_\-/])(?:appendix|glossary|index|notes|bibliography|about|back-?cover|phu-?luc)\b", re.I)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a file is one row; bytes that are no UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", F.replace(F.expr("make_valid_utf8(cast(content as string))"), F.lit("�"), F.lit("")).alias("text"))


def epub_items(data: bytes) -> list[tuple[str, str]]:
    """(name, xhtml) of an EPUB's pages: the spine first, then what it leaves out; each once."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        package = next((n for n in names if n.endswith(".opf")), None)
        order: list[str] = []
        if package:
            root = ElementTree.fromstring(z.read(package))
            tag = lambda e: e.tag.rpartition("}")[2]
            manifest = {e.get("id"): e for e in root.iter() if tag(e) == "item"}
            base = posixpath.dirname(package)
            for e in root.iter():
                if tag(e) == "itemref" and e.get("idref") in manifest:
                    item = manifest[e.get("idref")]
                    if "nav" not in (item.get("properties") or ""):
                        order.append(posixpath.normpath(posixpath.join(base, item.get("href", ""))))
        rest = sorted(n for n in names if n.lower().endswith((".xhtml", ".html", ".htm")) and not re.search(r"(?:^|/)nav\.", n))
        return [(n, z.read(n).decode("utf-8", "replace")) for n in dict.fromkeys([*order, *rest]) if n in names]


def epub_blocks(data: bytes, skip: bool = True) -> Iterator[tuple[int, str, str, int, str, str]]:
    """(item_no, item, title, block_no, kind, text) of a book, front and back matter left out on request."""
    for k, (name, html) in enumerate(epub_items(data)):
        title, found = blocks(html)
        identity = " ".join([posixpath.basename(name), title])
        if skip and (FRONT.search(identity) or BACK.search(identity)):
            continue
        for j, (kind, text) in enumerate(found):
            yield k, name, title, j, kind, text


def _read_epubs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "item_no", "item", "title", "block_no", "kind", "text"]
    for b in batches:
        for path, content in zip(b.path, b.content):
            try:
                rows = [(path, *r) for r in epub_blocks(content)]
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                rows = []
            yield pd.DataFrame(rows, columns=names)


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of every EPUB under a path; a file that is none gives no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path)
    return files.select("path", "content").mapInPandas(_read_epubs, BLOCKS)


class EpubSource(DataSource):
    """``spark.read.format("epub").load(folder)``: the same blocks through the Python data source API."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return EpubReader(self.options["path"])


class EpubReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import glob
        import os

        return [InputPartition(f) for f in sorted(glob.glob(os.path.join(self.path, "*.epub")))]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            for row in epub_blocks(f.read()):
                yield (partition.value, *row)


def wav_seconds(data: bytes) -> float:
    """Length of a recording; 1 second where the header can't be read."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            return w.getnframes() / w.getframerate() if w.getframerate() else 1.0
    except (wave.Error, EOFError):
        return 1.0


def read_wav_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(path, seconds) of recordings; voices uploaded for one job (custom_*) are left out."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b.path, "seconds": [wav_seconds(c) for c in b.content]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.where(~F.col("path").rlike("/custom_[^/]*$")).select("path", "content").mapInPandas(run, "path string, seconds double")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text, codes) of pipe-separated training metadata without a header; rows without a text are dropped."""
    rows = spark.read.option("sep", "|").option("quote", "").schema("file_name string, text string, codes string").csv(path)
    return rows.where("text is not null").withColumn("codes", F.from_json("codes", "array<int>"))
