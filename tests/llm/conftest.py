"""Small tables with everything odd in them, as folders like the driver's."""

import pytest

SCHEMAS = {
    "paragraphs": "paragraph_id long, book_id long, chapter_index int, paragraph_index int, text string, lang string, origin string, page_start int, page_end int, created_at timestamp, ingested_at timestamp",
    "tts_segments": "segment_id long, book_id long, chapter_index int, segment_index int, text string, lang string, voice_id string, emotion string, intensity double, speed double, speaker string, created_at timestamp, ingested_at timestamp",
    "chapters": "chapter_id long, book_id long, chapter_index int, chapter_title string, lang string, page_start int, page_end int, word_count long, created_at timestamp, ingested_at timestamp",
    "source_pages": "page_id long, book_id long, page_number int, lines array<string>, lang string, scanned_at timestamp, ingested_at timestamp",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, work_key string, title string, file_format string, published_on date, crawled_at timestamp",
    "split_limits": "record_table string, lang string, max_chars int, overlap_chars int",
    "source_weights": "source string, target_share double, max_repeats int",
    "subject_examples": "example_id int, lang string, subject string, text string",
}
LONG = "Der Satz ist lang genug. " * 2000
TEXTS = [None, "", "  \n", "Ein Satz. Noch ein Satz!", "Ein Satz. Noch ein Satz!", "x" * 30_000, LONG, "ZoÃ« ging. Sie kam\xa0zurück.", "�", "Hal-\nlo Welt", "á"]


def rows(name):
    if name == "paragraphs":
        out = [(i, i % 3, 1, i, t, [None, "de", "en", "xx"][i % 4], ["epub", "pdf_scan", None][i % 3], 1, None, None, None) for i, t in enumerate(TEXTS)]
        return out + out[3:5]
    if name == "tts_segments":
        out = [(i, i % 3, 1, i, t, ["de", None][i % 2], None, None, None, 1.0, None, None, None) for i, t in enumerate(TEXTS)]
        return out + out[:4]
    if name == "chapters":
        return [(i, i % 3, i, t, "de", None, None, None, None, None) for i, t in enumerate(TEXTS[:9])] * 2
    if name == "source_pages":
        page = lambda i, n, x: (i, 1, n, x, "de", None, None)
        return [page(0, 1, None), page(1, 2, []), page(2, 3, ["Kopf", "Text geht", "weiter-", "3"]), page(3, None, ["Kopf", "hin.", "", "[4]"]), page(4, 4, ["", " "]), page(4, 4, ["", " "])]
    if name == "documents":
        return [(i, t, "de", ["a", "b", None, "other"][i % 4], None, None, None, None, None, None) for i, t in enumerate(TEXTS)]
    if name == "split_limits":
        return [(t, "de", 50, 10) for t in ("paragraphs", "tts_segments")] + [("paragraphs", "en", 40, None)]
    if name == "source_weights":
        return [("a", 0.5, 2), ("b", 0.3, 1), ("none", 0.1, 3), ("zero", 0.0, 1), (None, None, None)]
    return [(i, lang, s, f"{w} und {w} im Text {i}") for i, (lang, s, w) in enumerate([("de", "law", "Gericht"), ("de", "sport", "Ball"), ("de", "fiction", "Mond"), ("en", "law", "court"), ("en", "sport", "ball")] * 3)]


def build(spark, folder, fill, extra):
    for name, schema in SCHEMAS.items():
        fixed = name in ("split_limits", "source_weights", "subject_examples")
        df = spark.createDataFrame(rows(name) if fill or fixed else [], schema)
        for c in extra:
            if c not in df.columns:
                df = df.selectExpr("*", f"cast('x' as string) as {c}")
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    return build(spark, tmp_path_factory.mktemp("odd"), True, [])


@pytest.fixture(scope="session")
def clashing(spark, tmp_path_factory):
    return build(spark, tmp_path_factory.mktemp("clashing"), True, ["record_id", "record_table", "kind", "n", "key", "part", "word", "mask", "share", "max_chars", "ids", "form", "ends", "budget"])


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return build(spark, tmp_path_factory.mktemp("empty"), False, [])
