"""Rendering books: EPUB files, SSML, plain text and chapter metadata."""

from __future__ import annotations

import html
import io
import os
import unicodedata
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.functions import text as T

CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def ssml(heading: Column, sentences: Column) -> Column:
    """A chapter for a speech engine: a long break after the heading, a short one after each sentence."""
    said = lambda s: F.concat(F.lit("<s>"), T.escape_html(F.regexp_replace(s, r"\.$", "")), F.lit('</s><break time="0.5s"/>'))
    head = F.when(heading.isNotNull(), F.array(F.concat(F.lit("<s>"), T.escape_html(heading), F.lit('</s><break time="1.5s"/>')))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.lit("<speak>")), head, F.transform(sentences, said), F.array(F.lit("</speak>"))), "\n")


def plain_text(heading: Column, sentences: Column) -> Column:
    """A chapter as text: its heading, then a sentence on each line."""
    return F.array_join(F.concat(F.when(heading.isNotNull(), F.array(heading)).otherwise(F.array().cast("array<string>")), sentences), "\n")


def ffmetadata(title: Column, start_s: Column, end_s: Column) -> Column:
    """One chapter of an audio file's metadata, in milliseconds; null for an empty one."""
    ms = lambda c: F.round(c * 1000).cast("long")
    text = F.format_string("[CHAPTER]\nTIMEBASE=1/1000\nSTART=%d\nEND=%d\ntitle=%s", ms(start_s), ms(end_s), T.escape_metadata(title))
    return F.when(end_s > start_s, text)


def epub_bytes(title: str, chapters: list[tuple[str, list[str]]]) -> bytes:
    """An EPUB 3 of chapters (title, paragraphs), all text composed (NFC)."""
    clean = lambda s: html.escape(unicodedata.normalize("NFC", s))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", CONTAINER)
        names = [f"chapter_{k:04d}.xhtml" for k in range(1, len(chapters) + 1)]
        items = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
        spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(names)))
        nav = "".join(f'<li><a href="{n}">{clean(t)}</a></li>' for n, (t, _) in zip(names, chapters))
        z.writestr("OEBPS/content.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{clean(title)}</dc:identifier><dc:title>{clean(title)}</dc:title><dc:language>und</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>')
        z.writestr("OEBPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>')
        for name, (head, paragraphs) in zip(names, chapters):
            body = "".join(f"<p>{clean(p)}</p>" for p in paragraphs)
            z.writestr(f"OEBPS/{name}", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{clean(head)}</title></head><body><h1>{clean(head)}</h1>{body}</body></html>')
    return out.getvalue()


def write_epubs(chapters: DataFrame, folder: str) -> DataFrame:
    """Write an EPUB for each book of ``chapters(book_id, chapter_no, title, paragraphs)``; (book_id, path, bytes).

    ``folder`` is one that all executors share.  A file is written beside its place and then moved.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chapter_no", kind="stable")
        book = int(pdf.book_id.iloc[0])
        data = epub_bytes(f"book {book}", [(t or f"Chapter {n + 1}", list(p)) for n, t, p in zip(pdf.chapter_no, pdf.title, pdf.paragraphs)])
        path = os.path.join(folder, f"book_{book}.epub")
        with open(f"{path}.part{os.getpid()}", "wb") as f:
            f.write(data)
        os.replace(f.name, path)
        return pd.DataFrame({"book_id": [book], "path": [path], "bytes": [len(data)]})

    return chapters.groupBy("book_id").applyInPandas(run, "book_id long, path string, bytes long")


def concat_wav(parts: list[bytes]) -> bytes:
    """One recording of several, in order; they must agree in channels, width and rate."""
    import wave

    out, form = io.BytesIO(), None
    with wave.open(out, "wb") as w:
        for part in parts:
            with wave.open(io.BytesIO(part)) as r:
                own = (r.getnchannels(), r.getsampwidth(), r.getframerate())
                if form is None:
                    form = own
                    w.setnchannels(own[0])
                    w.setsampwidth(own[1])
                    w.setframerate(own[2])
                if own != form:
                    raise ValueError(f"recordings differ: {form} and {own}")
                w.writeframes(r.readframes(r.getnframes()))
        if form is None:
            raise ValueError("no recordings")
    return out.getvalue()


def joined_recordings(parts: DataFrame) -> DataFrame:
    """``parts(book_id, chapter_index, segment_no, content)`` as one recording for each chapter."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment_no", kind="stable")
        kept = [bytes(c) for c in pdf.content if c is not None]
        joined = concat_wav(kept) if kept else None
        return pd.DataFrame({"book_id": [int(pdf.book_id.iloc[0])], "chapter_index": [int(pdf.chapter_index.iloc[0])], "content": [joined]})

    return parts.groupBy("book_id", "chapter_index").applyInPandas(run, "book_id long, chapter_index int, content binary")


def write_metadata(samples: DataFrame, path: str) -> None:
    """``samples(file_name, text[, codes])`` as pipe-separated lines without a header."""
    columns = ["file_name", "text"] + (["codes"] if "codes" in samples.columns else [])
    out = samples.withColumn("codes", F.to_json("codes")) if "codes" in columns else samples
    out.select(*columns).write.mode("overwrite").option("sep", "|").option("quote", "").option("escape", "").csv(path)


def write_stage(df: DataFrame, folder: str, job_id: str, stage: str) -> None:
    """A stage's rows as JSON under job_id=/stage=, beside those of other stages."""
    df.withColumns({"job_id": F.lit(job_id), "stage": F.lit(stage)}).write.mode("append").partitionBy("job_id", "stage").json(folder)
