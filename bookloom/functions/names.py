"""Names of files, voices and segments, and how numbers are shown, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def file_type(path: Column) -> Column:
    """Lower-case suffix without its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit(suffix))


def voice_id(name: Column) -> Column:
    """Lower case, letters, digits and single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_-]+", "_"), "^_+|_+$", "")


def engine(name: Column) -> Column:
    return F.translate(F.lower(name), "-", "_")


def segment_file(number: Column, voice: Column) -> Column:
    return F.format_string("seg_%04d_%s.wav", number, F.coalesce(voice, F.lit("default")))


def duration(seconds: Column) -> Column:
    """Hours, minutes and seconds, the leading parts left out where they are zero; '-' for null."""
    s = F.round(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return (
        F.when(seconds.isNull(), "-")
        .when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m "), r.cast("string"), F.lit("s")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), r.cast("string"), F.lit("s")))
        .otherwise(F.concat(r.cast("string"), F.lit("s")))
    )


def speech_tokens(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.concat(F.lit("<|speech_"), c.cast("string"), F.lit("|>"))), "")


def nfc(c: Column) -> Column:
    """Composed form, by Arrow batches; the JVM has no function for it."""

    @F.pandas_udf("string")
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return compose(c)
