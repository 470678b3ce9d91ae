"""The filter of sure words decides no case."""

from bookloom.llm import scans

SCHEMA = "lang string, word string, n_clean long, n_scan long"


def test_words_that_the_ratio_reports_are_not_sent(spark):
    words = spark.createDataFrame([("es", "el", 6000, 900), ("es", "cl", 8, 40), ("es", "casa", 5000, 10), ("es", "masa", 400, 10), ("es", "uno", 2, 0)], SCHEMA)
    assert {r.word for r in scans.sure_words(words).collect()} == {"el", "casa", "masa"}


def test_letters_with_a_hyphen_are_abbreviations():
    look = lambda t, known: [w for w, _ in scans.tokens(t, "ru", known)]
    assert look("утра г-н Лада н дом", frozenset({"утра", "лада", "дом"})) == ["н"]
    assert look("teIl teil", frozenset({"teil"})) == ["teIl"]
