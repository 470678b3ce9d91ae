"""Periods of numbers are judged by ratios, not by a single record."""

from bookloom.llm import sentences


def test_one_record_that_begins_with_a_month_ends_no_dates(spark):
    texts = [f"Am {i % 28 + 1}. Oktober gingen die Leute hinunter. Niemand blieb stehen." for i in range(60)]
    texts += [f"Das war im Jahr {1900 + i}. Niemand blieb stehen." for i in range(20)] + ["Oktober war es."]
    rows = spark.createDataFrame([("tts_segments", i, t, "de") for i, t in enumerate(texts)], "record_table string, record_id long, text string, lang string")
    got = sorted((r.record_id, r.end_pos) for r in sentences.sentence_ends(rows).collect())
    assert got == [(i, t.index(" Niemand")) for i, t in enumerate(texts[:80])]
