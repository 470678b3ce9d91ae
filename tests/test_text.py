"""Text functions against Python models of what they mean."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookloom.functions import text as T

SAMPLES = [None, "", " \n ", "Một câu. Hai câu! “Ba?” Bốn…", "no mark", "a b c", "x" * 20_000, "Dr. A… B", "<p>Hi <b>you</b></p> https://a.b/c end", "Trang 5", "copyright 2020"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, text string")


def column(df, c):
    return [r[0] for r in df.select(c.alias("x")).orderBy("i").collect()]


def test_normalize_space(rows):
    got = column(rows, T.normalize_space(F.col("text")))
    assert got == [None if s is None else re.sub(r"\s+", " ", s).strip() for s in SAMPLES]


def test_word_count(rows):
    assert column(rows, T.word_count(F.col("text"))) == [None if s is None else len(s.split()) for s in SAMPLES]


def test_segments_keep_everything(rows):
    for text, got in zip(SAMPLES, column(rows, T.speech_segments(F.col("text")))):
        if text is None:
            continue
        assert re.sub(r"\s", "", "".join(got)) == re.sub(r"\s", "", text) or text.strip().startswith(("<", "…"))


def test_sentences(rows):
    want = [None if s is None else [x for x in re.split(r"(?<=[.!?。！？])\s+", s.strip()) if x] for s in SAMPLES]
    assert column(rows, T.sentences(F.col("text"))) == want


def test_cleaning(rows):
    got = column(rows, T.clean_text(F.col("text")))
    assert got[8] == "Hi you end" and got[3].count('"') == 2
    assert column(rows, T.noise_rule(F.col("text")))[9:] == ["page", "rights"]


def test_pause_and_language(rows):
    assert column(rows, T.pause_ms(F.col("text")))[4] == 200
    got = column(rows, T.language(F.col("text")))
    assert got[0] == got[1] == got[2] == "unknown" and got[3] == "vi" and got[4] == "en"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab -–#1\n\t ", max_size=30), min_size=1, max_size=20))
def test_dedupe_key_is_stable(spark, texts):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, text string")
    once = df.select("i", T.dedupe_key(F.col("text")).alias("text"))
    assert column(once, T.dedupe_key(F.col("text"))) == column(once, F.col("text"))
