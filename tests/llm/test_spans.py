"""Quotations and white space of any length."""

import time

from bookloom.llm import sentences


def ends(text, lang="en"):
    return [p for p, *_ in sentences.places(text, lang)[0]]


def test_marks_in_long_quotations_end_nothing():
    long = "Stop here! Go on there! " * 60
    for a, b in ("“”", "«»", "\"\"", "()", "「」"):
        text = f"He read {a}{long.strip()}{b} aloud. She slept."
        assert ends(text) == [text.index(" She")], a
    both = f"“{long.strip()}” She slept."
    assert ends(both) == [len(both) - 11]


def test_quotations_end_with_their_paragraph():
    text = "He said “Stop! Go.\n\nNobody came! She said “no” twice."
    assert ends(text) == [14, 18, 32]


def test_long_white_space():
    assert ends("He left!" + " " * 300 + "She slept.") == [8] and sentences.places(" " * 200 + "She slept.", "en")[1] == "She"


def test_many_signs_take_linear_time():
    began = time.time()
    ends("“Ah! " * 20_000 + "(Oh! " * 20_000)
    ends("“" + "Ah! " * 40_000 + "”")
    assert time.time() - began < 10
