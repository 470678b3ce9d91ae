"""Problem 1: pieces of oversized texts.

Recursive bisection.  A text above its limit is cut at the strongest boundary
near the middle; halves still above ``limit - overlap`` are cut again; at the
end every piece but the first is prolonged to the left by at most ``overlap``
code points: to the furthest boundary that leaves at least half of them, else
to the full overlap.

Defined results
---------------
* null text: no piece; empty text: one empty piece; blank text: as any other.
* no limit for (table, language): one piece, whatever the length.
* a text of exactly the limit: one piece.
* pieces cover every code point; no piece is longer than the limit; a base and
  its combining marks stay together unless one such cluster alone exceeds it.
* an overlap that is negative or null counts as 0, one of more than half of the
  limit as that half; a limit below 1 counts as 1.
* rows delivered twice give their pieces once; columns other than the key,
  text and language are not read.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import once_of, table

# Boundaries from strong to weak; a cut is made at a match's end.
BOUNDARIES = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*|[।؟۔]+[”’»]*\s*"),
    re.compile(r"[,;:،؛–—]\s+|[，、；：]"),
    re.compile(r"\s+"),
)

PIECES = "record_table string, record_id long, piece_no int, start_pos int, end_pos int, piece string"


def _attached(ch: str) -> bool:
    """True if a cut before this character would part it from its base."""
    return ch in "\u200d\ufe0f" or unicodedata.category(ch) in ("Mn", "Mc", "Me")


def boundaries(text: str) -> list[list[int]]:
    """Cut positions of each strength, strongest first, each list in order."""
    found = [[m.end() for m in p.finditer(text) if 0 < m.end() < len(text)] for p in BOUNDARIES]
    return found


def _cut(text: str, places: list[list[int]], start: int, end: int) -> int:
    middle, reach = (start + end) // 2, max(1, (end - start) // 4)
    low, high = max(start + 1, middle - reach), min(end - 1, middle + reach)
    for at in places:
        k = bisect.bisect_left(at, middle)
        near = [p for p in at[max(0, k - 1) : k + 1] if low <= p <= high]
        if near:
            return min(near, key=lambda p: (abs(p - middle), p))
    for step in range(high - low + 1):
        for p in (middle - step, middle + step):
            if low <= p <= high and not _attached(text[p]) and text[p - 1] != "\u200d":
                return p
    return max(start + 1, min(middle, end - 1))


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece of one text."""
    limit = max(1, limit)
    if len(text) <= limit:
        return [(0, len(text))]
    overlap = max(0, min(overlap or 0, limit // 2))
    target, places = limit - overlap, boundaries(text)
    cores, todo = [], [(0, len(text))]
    while todo:
        start, end = todo.pop()
        if end - start <= target:
            cores.append((start, end))
            continue
        at = _cut(text, places, start, end)
        todo += [(at, end), (start, at)]
    pieces = []
    for k, (start, end) in enumerate(cores):
        pieces.append((_prolonged(text, places, start, overlap) if k and overlap else start, end))
    return pieces


def _prolonged(text: str, places: list[list[int]], start: int, overlap: int) -> int:
    """Where a piece begins that shares up to ``overlap`` code points with the one before it.

    The strongest kind of boundary that leaves at least half of the overlap decides, and of that kind the place
    furthest to the left; so a boundary just before the cut doesn't shrink the overlap to a few characters.
    """
    lowest, highest = start - overlap, start - (overlap + 1) // 2
    for at in places[2:]:
        j = bisect.bisect_left(at, lowest)
        if j < len(at) and at[j] <= highest:
            return at[j]
    p = lowest
    while p < start and (_attached(text[p]) or text[p - 1] == "\u200d"):
        p += 1
    return p


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for name, key, text, limit, overlap in zip(b.record_table, b.record_id, b.text, b.max_chars, b.overlap_chars):
            for k, (s, e) in enumerate(split(text, int(limit), int(overlap))):
                rows.append((name, key, k, s, e, text[s:e]))
        yield pd.DataFrame(rows, columns=["record_table", "record_id", "piece_no", "start_pos", "end_pos", "piece"])


def split_pieces(records: DataFrame, limits: DataFrame, oversized_only: bool = False) -> DataFrame:
    """Pieces of ``records(record_table, record_id, text, lang)``.

    Only oversized texts go to Python; the others become their single piece in
    the JVM.  ``limits`` is one row for each (table, language) and small; a
    planner that sees otherwise from its size shuffles it.
    """
    limits = limits.groupBy("record_table", "lang").agg(
        F.min("max_chars").alias("max_chars"), F.max(F.coalesce("overlap_chars", F.lit(0))).alias("overlap_chars")
    )
    base = records.select("record_table", F.col("record_id").cast("long"), "text", "lang").where(F.col("text").isNotNull())
    joined = base.join(limits, ["record_table", "lang"], "left")
    over = F.col("max_chars").isNotNull() & (F.length("text") > F.greatest("max_chars", F.lit(1)))
    cut = joined.where(over).drop("lang").mapInPandas(_pieces, PIECES)
    if oversized_only:
        return cut
    whole = joined.where(~over).select(
        "record_table", "record_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start_pos"), F.length("text").alias("end_pos"), F.col("text").alias("piece")
    )
    return whole.unionByName(cut)


TABLES = {"paragraphs": "paragraph_id", "tts_segments": "segment_id"}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of paragraphs and segments, as delivered."""
    each = [table(spark, sf_dir, name).select(F.lit(name).alias("record_table"), F.col(key).alias("record_id"), "text", "lang") for name, key in TABLES.items()]
    return each[0].unionByName(each[1])


def records_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each key once; texts stay where they are."""
    each = [once_of(spark, sf_dir, name, [key], ["text", "lang"]).select(F.lit(name).alias("record_table"), F.col(key).alias("record_id"), "text", "lang") for name, key in TABLES.items()]
    return each[0].unionByName(each[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that the operator cuts: those with a second piece.  Keys count once."""
    pieces = split_pieces(records(spark, sf_dir), table(spark, sf_dir, "split_limits"), oversized_only=True)
    return pieces.where("piece_no = 1").select("record_table", "record_id").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every record, each key once."""
    return split_pieces(records_once(spark, sf_dir), table(spark, sf_dir, "split_limits"))


def p1_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each record what its pieces must hold to: how far they reach without a gap, whether each is within the limit
    and every overlap between half of what is asked and all of it, and the text that they make when put together.

    A record's pieces are one row each; they are summed up by record, whose text bounds them.
    """
    limits = table(spark, sf_dir, "split_limits").groupBy("record_table", "lang").agg(F.min("max_chars").alias("most"), F.max("overlap_chars").alias("asked"))
    pieces = split_pieces(records_once(spark, sf_dir), table(spark, sf_dir, "split_limits"))
    each = pieces.groupBy("record_table", "record_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "piece"))).alias("p"))
    langs = [table(spark, sf_dir, name).select(F.lit(name).alias("record_table"), F.col(key).alias("record_id"), "lang").distinct() for name, key in TABLES.items()]
    each = each.join(langs[0].unionByName(langs[1]), ["record_table", "record_id"]).join(limits, ["record_table", "lang"], "left")
    whole = F.aggregate("p", F.struct(F.lit("").alias("text"), F.lit(0).alias("end")), lambda s, x: F.struct(F.concat(s["text"], F.substring(x["piece"], s["end"] - x["start_pos"] + 1, x["end_pos"])).alias("text"), x["end_pos"].alias("end")))
    inside = F.forall("p", lambda x: (F.length(x["piece"]) == x["end_pos"] - x["start_pos"]) & (F.coalesce(F.length(x["piece"]) <= F.col("most"), F.lit(True)) | (F.size("p") == 1) & F.col("most").isNull()))
    shared = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.element_at("p", k)["end_pos"] - F.element_at("p", k + 1)["start_pos"])
    asked = F.least(F.coalesce("asked", F.lit(0)), F.floor(F.col("most") / 2))
    overlaps = (F.size("p") == 1) | F.forall(shared, lambda n: (n <= asked) & (2 * n >= asked))
    return each.select("record_table", "record_id", (F.size("p") > 1).alias("is_cut"), inside.alias("within_limit"), overlaps.alias("overlaps"), F.md5(whole["text"].cast("binary")).alias("digest"))


_RECORDS_SQL = """SELECT 'paragraphs' AS record_table, paragraph_id AS record_id, text, lang FROM paragraphs
  UNION ALL SELECT 'tts_segments', segment_id, text, lang FROM tts_segments"""
P1_FOUND_SQL = f"""
SELECT DISTINCT t.record_table, t.record_id FROM ({_RECORDS_SQL}) t
JOIN split_limits l ON l.record_table = t.record_table AND l.lang = t.lang
WHERE length(t.text) > l.max_chars
"""
P1_AUDIT_SQL = f"""
SELECT DISTINCT t.record_table, t.record_id, coalesce(length(t.text) > l.max_chars, false) AS is_cut, true AS within_limit, true AS overlaps, md5(t.text) AS digest
FROM ({_RECORDS_SQL}) t LEFT JOIN split_limits l ON l.record_table = t.record_table AND l.lang = t.lang WHERE t.text IS NOT NULL
"""
