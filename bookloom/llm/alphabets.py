"""What is ordinary in each language's writing.  Fixed values throughout."""

from __future__ import annotations

from functools import lru_cache

# Letters beyond ASCII, lower case; capitals follow from them.
LATIN_LETTERS = {
    "vi": "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ",
    "en": "",
    "fr": "àâæçéèêëîïôœùûüÿ",
    "de": "äöüß",
    "es": "áéíñóúü",
}
RUSSIAN = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
# Punctuation and signs that any language's books print as they are.
COMMON = "“”‘’„‚«»‹›–—…·•°§€£№©®™×÷±¿¡"
# Ranges of scripts that are a language's own.
RANGES = {
    "hi": [(0x0900, 0x097F)],
    "th": [(0x0E00, 0x0E7F)],
    "fa": [(0x0600, 0x06FF)],
    "zh": [(0x3000, 0x303F), (0x4E00, 0x9FFF), (0x3400, 0x4DBF)],
    "ja": [(0x3000, 0x30FF), (0x4E00, 0x9FFF), (0x3400, 0x4DBF)],
}
FULLWIDTH_PUNCTUATION = "！（），：；？"
#: Joiners that a language's spelling needs.
JOINERS = {"fa": "‌", "hi": "‌‍"}


@lru_cache(maxsize=64)
def own(lang: str) -> frozenset[str]:
    """The non-ASCII characters that a language's ordinary text is made of."""
    out = set(COMMON)
    letters = LATIN_LETTERS.get(lang, "") + (RUSSIAN if lang == "ru" else "")
    out |= set(letters) | {c.upper() for c in letters if len(c.upper()) == 1}
    for low, high in RANGES.get(lang, []):
        out |= {chr(c) for c in range(low, high + 1)}
    if lang in ("zh", "ja"):
        out |= set(FULLWIDTH_PUNCTUATION)
    return frozenset(out | set(JOINERS.get(lang, "")))
