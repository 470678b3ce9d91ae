"""What the training-data operators share: reading, counting keys once, intermediate tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookloom.operators.tables import materialise, once, once_of, small, table

__all__ = ["LANGS", "lang_code", "materialise", "once", "once_of", "small", "table"]

#: The languages of the book tables; codes outside it form one group, "other".
LANGS = ("vi", "en", "fr", "de", "es", "ru", "zh", "ja", "th", "hi", "fa")


def lang_code(col) -> F.Column:
    """The primary subtag in lower case; null, blank and unknown codes give 'other'."""
    code = F.regexp_extract(F.lower(F.trim(col)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(code.isin(*LANGS), code).otherwise(F.lit("other"))
