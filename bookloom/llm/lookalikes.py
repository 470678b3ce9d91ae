"""Problem 3: text that looks right but is stored in other characters.

``skeleton`` is independent of the language: decompose, replace each character
by its prototype, decompose again; texts that look equal have equal skeletons.
Originals with one skeleton are a group of look-alikes; the ordinary one among
them depends on the language, and ``form`` gives it: composed, without characters
that aren't seen, with plain spaces, and with every look-alike replaced by its
prototype where the prototype is what the language writes.

A record is looked at if its skeleton shows that it could be written in other
characters (``varied``); it is a case if the ordinary member of its group, its
form, differs from it.  ``p3_groups`` groups the originals as they are stored.

Defined results
---------------
* null: no form, no case; empty: the empty form, no case; blank text of plain
  spaces and line breaks: itself.
* words in a foreign script stay as they are; a word that mixes scripts, or
  whose letters all look like the language's own, is taken to be the language's.
  In a language written in neither, a word that mixes Latin, Cyrillic, Greek or
  Armenian letters is taken to be of the script that most of its letters have.
* an unknown or null language: only what is odd in every language is replaced.
* keys delivered twice count once; columns other than key, text and language
  are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm import encodings
from bookloom.llm.alphabets import FULLWIDTH_PUNCTUATION, JOINERS, LATIN_LETTERS, own
from bookloom.llm.common import lang_code, once_of, table

# Look-alikes of Latin letters, by script.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝӏАВЕКМНОРСТУХІЈЅҮԌԚԜ", "aeopcyxijshdqwlABEKMHOPCTYXIJSYGQW", strict=True))
CYRILLIC |= {"ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï"}
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "ABEZHIKMNOPTYXov", strict=True))
GREEK_LOOSE = dict(zip("αιρυγκ", "aipuyk", strict=True))
ARMENIAN = dict(zip("օսհոցՏԼ", "ouhngSL", strict=True))
LATIN = {"Ð": "Đ", "Ɖ": "Đ", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ǀ": "l", "ꞌ": "'", "ʼ": "'", "‐": "-", "‑": "-"}
LATIN_SIGNS = {c: p for c, p in LATIN.items() if c not in "ÐƉ"}
# Latin letters that look like Russian ones.
TO_RUSSIAN = dict(zip("aeopcyxABEKMHOPCTYX", "аеорсухАВЕКМНОРСТУХ", strict=True)) | {"ë": "ё", "Ë": "Ё"}
PROTOTYPES_OF_RUSSIAN = re.compile(f"[{''.join(TO_RUSSIAN)}]")
# Greek letters that look like them are Russian ones too.
GREEK_TO_RUSSIAN = {c: TO_RUSSIAN[p] for c, p in GREEK.items() if p in TO_RUSSIAN}
# Arabic letters and digits where Persian has its own.
PERSIAN = dict(zip("يكىٸ٠١٢٣٤٥٦٧٨٩", "یکیئ۰۱۲۳۴۵۶۷۸۹", strict=True))
# Sequences drawn as one letter.
SEQUENCES = {
    "th": {"ํา": "ำ", "เเ": "แ"},
    "hi": {"अा": "आ", "अो": "ओ", "अौ": "औ", "आॅ": "ऑ", "एे": "ऐ"},
}
# Katakana, kanji and signs that look alike.
KANA_IN_KANJI = dict(zip("力口二工卜夕八一", "カロニエトタハー", strict=True))
HIRAGANA_IN_KATAKANA = dict(zip("へべぺり", "ヘベペリ", strict=True))
# へ and り can stand between words: only a kana that begins no word tells that the word goes on.
KANA_LIKE = re.compile(r"(?<=[゠-ヿ])[力口二工卜夕八へべぺり]")
HIRAGANA_INSIDE = re.compile(r"(?<=[ァ-ヺー])(?:[べぺ](?=[ァ-ヺー])|[へり](?=[ンッァィゥェォャュョー]))")

# The skeleton's prototypes of letters, without those that only a Latin language's words can tell.
_STRICT = CYRILLIC | GREEK | ARMENIAN

#: Kinds of compatibility decomposition after which a reader sees the same character.
SAME = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
UNSEEN = {"­", "͏", "ᅟ", "ᅠ", "឴", "឵", "ㅤ", "ﾠ"}


def plain(c: str, lang: str) -> str:
    """What a character stands for in any language's text; itself if it is ordinary there."""
    if c < "\x7f":
        return c if c >= " " or c in "\n\r\t" else ""
    if c in JOINERS.get(lang, "") or c in FULLWIDTH_PUNCTUATION + "～＂" and lang in ("zh", "ja"):
        return c
    category = unicodedata.category(c)
    if category == "Zs":
        return " "
    if category in ("Zl", "Zp"):
        return "\n"
    if category in ("Cf", "Cc") or c in UNSEEN or "︀" <= c <= "️":
        return "" if c != "\x85" else "\n"
    kind, _, _ = unicodedata.decomposition(c).partition(" ")
    point = ord(c)
    if kind in SAME or 0xFB00 <= point <= 0xFB06 or 0x2E80 <= point <= 0x2FDF or 0x2160 <= point <= 0x217F and lang not in ("zh", "ja"):
        # the reading direction of presentation forms is the text's own
        return unicodedata.normalize("NFKC", c)
    return c


class _Plain(dict):
    """Code point -> plain form, worked out when it is first met."""

    def __init__(self, lang: str):
        super().__init__()
        self.lang = lang

    def __missing__(self, point: int) -> str:
        out = self[point] = plain(chr(point), self.lang)
        return out


class Forms:
    """The consistent form of texts in one language, with a quick test for texts that are in it."""

    def __init__(self, lang: str):
        self.lang = lang
        self.latin, self.russian = lang in LATIN_LETTERS, lang == "ru"
        letters = own(lang) - set(PERSIAN) if lang == "fa" else own(lang)
        ordinary = letters - {c for c in letters if plain(c, lang) != c or unicodedata.normalize("NFC", c) != c}
        ascii_part = " -~\n\r\t" if not self.russian else " -@[-`{-~\n\r\t"
        self.odd = re.compile(f"[^{ascii_part}{re.escape(''.join(sorted(ordinary)))}]")
        self.sequences = SEQUENCES.get(lang, {})
        self.table = _Plain(lang)
        self.word = re.compile(r"[^\W\d_]+(?:[^\W_]*)")
        self.likes = CYRILLIC | GREEK | GREEK_LOOSE | ARMENIAN
        self.alphabetic = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿͰ-ԯԱ-֏]{2,}")

    def __call__(self, text: str) -> str:
        if not self.odd.search(text) and not (self.sequences and any(s in text for s in self.sequences)) and self.lang != "ja":
            return text
        out = text
        if not out.isascii():
            # only odd characters stand for others
            if any(self.table[ord(c)] != c for c in set(self.odd.findall(out))):
                out = out.translate(self.table)
            out = unicodedata.normalize("NFC", out)
        for a, b in self.sequences.items():
            out = out.replace(a, b)
        if self.lang == "fa":
            out = out.translate(str.maketrans(PERSIAN))
        if self.latin:
            out = self._signs(out)
            if re.search(r"[Ͱ-ԯԱ-֏]", out):
                out = self.word.sub(self._latin_word, out)
        elif self.russian:
            out = out.replace("‐", "-").replace("‑", "-")
            if re.search(r"[A-Za-zëËͰ-Ͽ]", out):
                out = self.word.sub(self._russian_word, out)
        elif re.search(r"[Ͱ-ԯԱ-֏]", out):
            out = self.alphabetic.sub(self._mixed_word, out)
        if self.lang == "ja":
            out = re.sub(r"(?<=[゠-ヿ])[力口二工卜夕八](?=[゠-ヿ])", lambda m: KANA_IN_KANJI[m[0]], out)
            out = HIRAGANA_INSIDE.sub(lambda m: HIRAGANA_IN_KATAKANA[m[0]], out)
        return out

    def _signs(self, text: str) -> str:
        if self.lang == "vi":
            text = text.replace("Ð", "Đ").replace("Ɖ", "Đ")
        for c, p in LATIN_SIGNS.items():
            text = text.replace(c, p)
        return text

    def _latin_word(self, m: re.Match) -> str:
        w = m[0]
        foreign = [c for c in w if "Ͱ" <= c < "֐"]
        if not foreign:
            return w
        latin = any(c.isalpha() and (c < "Ͱ" or "Ḁ" <= c < "ἀ") for c in w)
        if latin and all(c in self.likes for c in foreign) or all(c in CYRILLIC or c in GREEK for c in w if c.isalpha()):
            return "".join(self.likes.get(c, c) for c in w)
        return w

    def _russian_word(self, m: re.Match) -> str:
        w = m[0]
        latin = [c for c in w if c.isascii() and c.isalpha() or c in "ëË"]
        greek = [c for c in w if "Ͱ" <= c < "Ѐ"]
        if not latin and not greek:
            return w
        mixed = any("Ѐ" <= c < "԰" for c in w)
        if mixed and all(c in TO_RUSSIAN for c in latin) and all(c in GREEK_TO_RUSSIAN for c in greek):
            return "".join(TO_RUSSIAN.get(c) or GREEK_TO_RUSSIAN.get(c, c) for c in w)
        if not mixed and all(c in TO_RUSSIAN for c in w) and (len(w) == 1 or not w.isupper() or self._among_capitals(m)):
            return "".join(TO_RUSSIAN.get(c, c) for c in w)
        return w

    @staticmethod
    def _mixed_word(m: re.Match) -> str:
        """A Latin or Russian word with letters of another script, in a language that is written in neither.

        Words of one script are foreign words; the skeleton's letters decide, in the script that most letters have.
        """
        w = m[0]
        latin = [c for c in w if c < "Ͱ" or "Ḁ" <= c < "ἀ"]
        foreign = [c for c in w if "Ͱ" <= c < "֐"]
        russian = [c for c in foreign if "Ѐ" <= c < "԰"]
        if latin and foreign and all(c in _STRICT for c in foreign) and len(latin) >= len(russian):
            return "".join(_STRICT.get(c, c) for c in w)
        rest = {c for c in w if not "Ѐ" <= c < "԰"}
        if russian and rest and all(c in TO_RUSSIAN or c in GREEK_TO_RUSSIAN for c in rest):
            return "".join(TO_RUSSIAN.get(c) or GREEK_TO_RUSSIAN.get(c, c) for c in w)
        if latin and foreign and all(c in _STRICT for c in foreign):
            return "".join(_STRICT.get(c, c) for c in w)
        return w

    @staticmethod
    def _among_capitals(m: re.Match) -> bool:
        near = m.string[max(0, m.start() - 12) : m.start()] + m.string[m.end() : m.end() + 12]
        letters = [c for c in near if "Ѐ" <= c < "԰"]
        return len(letters) >= 4 and all(c.isupper() for c in letters)


_forms: dict[str, Forms] = {}


def form(text: str, lang: str) -> str:
    if lang not in _forms:
        _forms[lang] = Forms(lang)
    return _forms[lang](text)


_PROTOTYPES = {**CYRILLIC, **GREEK, **ARMENIAN, **{c: "-" if p == "-" else p for c, p in LATIN.items()}, **{p: c for c, p in PERSIAN.items() if p in "یک"}}
_PROTOTYPES |= {"ی": "ي", "ک": "ك", "ى": "ي"}
_prototypes: dict[str, str] = {}


def _prototype(c: str) -> str:
    p = _prototypes.get(c)
    if p is None:
        p = plain(c, "")
        p = _prototypes[c] = "".join(_PROTOTYPES.get(x, x) for x in p)
    return p


def skeleton(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again."""
    first = unicodedata.normalize("NFD", text)
    second = unicodedata.normalize("NFD", "".join(map(_prototype, first)))
    for pairs in SEQUENCES.values():
        for a, b in pairs.items():
            second = second.replace(unicodedata.normalize("NFD", a), unicodedata.normalize("NFD", b))
    return second


class _Prototypes(dict):
    """Code point -> prototype, worked out when it is first met."""

    def __missing__(self, point: int) -> str:
        out = self[point] = _prototype(chr(point))
        return out


_prototypes_by_point = _Prototypes()


def varied(text: str, lang: str) -> bool:
    """True if the text has a look-alike: a character with another prototype, a sequence drawn as one letter, or parts
    that compose; in a language that isn't written in the prototypes' letters, a prototype itself.  A text without any
    is the only original of its skeleton that the language could write."""
    if lang == "ru" and PROTOTYPES_OF_RUSSIAN.search(text):
        return True
    if not unicodedata.is_normalized("NFC", text) or text.translate(_prototypes_by_point) != text:
        return True
    return any(a in text for pairs in SEQUENCES.values() for a in pairs) or bool(KANA_LIKE.search(text))


def _forms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest = lambda t: hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()
    for b in batches:
        out = [form(t, lang) if varied(t, lang) else t for t, lang in zip(b.text, b.lang)]
        keys = [digest(skeleton(t)) for t in b.text]
        yield pd.DataFrame({
            "record_table": b.record_table, "record_id": b.record_id, "form": out, "skeleton_key": keys,
            "original_key": [digest(t) for t in b.text], "odd": [x != t for x, t in zip(out, b.text)],
        })


def odd_records(records: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Keys of records ``(record_table, record_id, text, lang)`` that differ from their form.

    Where a paragraph is also garbled (problem 4), it is left out.  ``models``
    are the paragraphs from which the characters' counts are taken.
    """
    spark = records.sparkSession
    shared = spark.sparkContext.broadcast(encodings.models(models) if models is not None else {})

    def find(batches):
        for b in batches:
            keep = []
            hits = [i for i, (t, lang) in enumerate(zip(b.text, b.lang)) if varied(t, lang) and form(t, lang) != t]
            part = b.iloc[hits]
            for (name, lang), rows in part.groupby(["record_table", "lang"]):
                model = shared.value.get(lang) if name == "paragraphs" else None
                given = list(rows.text)
                paths = encodings.label(given, model) if model is not None else [None] * len(given)
                for key, text, path in zip(rows.record_id, given, paths):
                    if path is None or encodings.repaired(text, path, model) is None:
                        keep.append((name, key))
            yield pd.DataFrame(keep, columns=["record_table", "record_id"]).astype({"record_table": "object", "record_id": "int64"})

    texts = records.where(F.length("text") > 0).withColumn("lang", lang_code(F.col("lang")))
    return texts.mapInPandas(find, "record_table string, record_id long")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "paragraphs").select(F.lit("paragraphs").alias("record_table"), F.col("paragraph_id").alias("record_id"), "text", "lang")
    c = table(spark, sf_dir, "chapters").select(
        F.lit("chapters").alias("record_table"), F.col("chapter_id").alias("record_id"), F.col("chapter_title").alias("text"), "lang"
    )
    return p.unionByName(c)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_records(records(spark, sf_dir), encodings.paragraphs_once(spark, sf_dir)).distinct()


def records_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = once_of(spark, sf_dir, "paragraphs", ["paragraph_id"], ["text", "lang"])
    c = once_of(spark, sf_dir, "chapters", ["chapter_id"], ["chapter_title", "lang"])
    p = p.select(F.lit("paragraphs").alias("record_table"), F.col("paragraph_id").alias("record_id"), "text", "lang")
    return p.unionByName(c.select(F.lit("chapters").alias("record_table"), F.col("chapter_id").alias("record_id"), F.col("chapter_title").alias("text"), "lang"))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's consistent form, the key of its skeleton and that of the text as stored."""
    rows = records_once(spark, sf_dir).where(F.col("text").isNotNull())
    return rows.withColumn("lang", lang_code(F.col("lang"))).mapInPandas(
        _forms_of, "record_table string, record_id long, form string, skeleton_key string, original_key string, odd boolean"
    )


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that look equal: of each skeleton its records, its different originals as stored, its different forms and
    the records that aren't in their form.

    Counts go through (skeleton, original) first, so a text that a third of all
    records share is summed up before the shuffle.
    """
    forms = p3_forms(spark, sf_dir).select("skeleton_key", "original_key", F.md5(F.col("form").cast("binary")).alias("form_key"), "odd")
    each = forms.groupBy("skeleton_key", "original_key", "form_key").agg(F.count("*").alias("n"), F.sum(F.col("odd").cast("long")).alias("n_odd"))
    return each.groupBy("skeleton_key").agg(
        F.sum("n").alias("n_records"), F.countDistinct("original_key").alias("n_originals"), F.countDistinct("form_key").alias("n_forms"), F.sum("n_odd").alias("n_odd")
    )
