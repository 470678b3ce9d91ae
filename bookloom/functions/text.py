"""Text functions as column expressions, all inside whole-stage code generation.

White space means Unicode's white space everywhere (``WS``), as book texts hold
no-break and thin spaces; null gives null, empty gives empty unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, as a character class that Java's and RE2's dialects share.
WS_CHARS = r"\t\n\x0B\x0C\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_CHARS}]"
NON_WS = f"[^{WS_CHARS}]"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
# Marks of sentence ends.
SENTENCE_SPLIT = rf"(?<=[.!?。！？]){WS}+"
TTS_SENTENCE = r"[^.!?。！？…]+(?:[.!?。！？…]+[\"'”’»]*|$)"
DIALOGUE = "^" + WS + "*[-–—\"'‘’“”«»❬❭]"
# Letters that only Vietnamese has among the languages told apart.
VIETNAMESE = (
    "àáâãèéêìíòóôõùúýăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
    "ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝĂĐƠƯẠẢẤẦẨẪẬẮẰẲẴẶẸẺẼẾỀỂỄỆỈỊỌỎỐỒỔỖỘỚỜỞỠỢỤỦỨỪỬỮỰỲỴỶỸ"
)
# Hosts of social links.
SOCIAL = r"(?:bit\.ly|tinyurl\.com|t\.me|facebook\.com|fb\.com|youtube\.com|youtu\.be|zalo\.me|x\.com|twitter\.com|instagram\.com|tiktok\.com|github\.com)"
# The steps of deep cleaning, in order: pattern and replacement.
CLEAN_STEPS = [
    (r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<nav\b[^>]*>.*?</nav>|<footer\b[^>]*>.*?</footer>|<header\b[^>]*>.*?</header>|<aside\b[^>]*>.*?</aside>", " "),
    (r"<[^>]+>", " "),
    (rf"(?i)https?://{NON_WS}+", " "),
    (rf"(?i)\bwww\.{NON_WS}+", " "),
    (r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}\b", " "),
    (rf"(?i)\b{SOCIAL}/{NON_WS}+", " "),
    (r"(?i)\[[^\]]*(?:http|www\.|\.com|\.vn)[^\]]*\]", " "),
    (r"(?i)\([^)]*(?:http|www\.|\.com|\.vn)[^)]*\)", " "),
    (r"[ \t]+", " "),
    (r"\x{200B}", ""),
    (rf"{WS}+([,.;:!?])", "$1"),
]
# Characters a speech engine can't read, and what it gets instead.
SPEECH_FROM, SPEECH_TO = "“”‘’«»", "\"\"''\"\""
SPEECH_WORDS = [("…", "..."), ("—", " - "), ("–", " - ")]
SPEECH_DROP = "[•●○★☆§]+"
# Abbreviations and their readings, in order.
ABBREVIATIONS = [("đ/c", "đồng chí"), ("TP", "Thành phố"), ("TT", "Thị trấn"), ("QĐ", "Quyết định"), ("TTCP", "Thủ tướng Chính phủ"), ("CP", "Chính phủ"), ("TNHH", "Trách nhiệm hữu hạn"), ("Cổ phần", "Cổ phần"), ("v\\.v\\.(?=[\\p{L}\\p{N}_])", "vân vân"), ("v\\.v", "vân vân")]
# Lines that are never part of a book's text, as a pattern and as whole lines.
NOISE_LINE = r"(?iu)^(?:https?://|m\. me/)|tinyurl|ebook miễn phí|webtietkiem\.com|(?<![\p{L}\p{N}_])(?:thuviensach|download|đăng ký kho sách|facebook|fanpage)(?![\p{L}\p{N}_])|^[0-9]{3,4}$"
NOISE_LINES = ("ĐẮC NHÂN TÂM", "MỤC LỤC", "DALE CARNEGIE", "THÔNG TIN EBOOK")
# Rules of noise blocks, in order; the first that holds names the rule.
NOISE_RULES = [
    ("url", r"(?i)https?://|www\."),
    ("domain", rf"(?i){NON_WS}\.(?:com|org|net|vn|io|edu|gov|info|me|co)\b"),
    ("social", r"(?i)\b(?:website|trang web|fanpage|facebook|youtube|zalo|tiktok|instagram|twitter|telegram)\b"),
    ("rule", r"^[-–—_=~]{3,}$"),
    ("short", r"^[^a-zA-Zà-žÀ-Ž]{1,2}$"),
    ("leader", r"\.{3,}[ \t]*[0-9]+[ \t]*$"),
    ("navigation", r"(?i)^(?:trang|page|home|next|previous|back|menu|contents)$"),
    ("page", r"(?i)^(?:trang|page) *[0-9]+$"),
    ("fraction", r"^[0-9]+ */ *[0-9]+$"),
    ("number", r"(?i)^(?:[ivxlcdm]+|[0-9]+)$"),
    ("isbn", r"(?i)ISBN[ :-]*[0-9X-]{10,}"),
    ("publisher", r"(?i)Nhà xuất bản|NXB|In +[0-9]+ +bản|Khổ +[0-9]+"),
    ("rights", r"(?i)Bản quyền|Copyright|©|All rights reserved"),
    ("download", r"(?i)đọc +sách +online|ebook|e-book|scan|pdf|epub|download|tải +sách|nguồn *:"),
    ("contact", r"(?i)Liên hệ.*[0-9]{4,}|Điện thoại|Fax *:"),
    ("contents", r"(?i)Mục lục|Table of Contents"),
    ("note", r"^ *\[[0-9]+\].*"),
    ("credits", r"(?i)Chịu trách nhiệm xuất bản|Biên tập|Trình bày bìa"),
]


def normalize_space(c: Column) -> Column:
    """White space as single plain spaces, none at the ends; the letter oi as u-horn."""
    return F.trim(F.regexp_replace(F.translate(c, "Ƣƣ", "Ưư"), f"{WS}+", " "))


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def for_speech(c: Column) -> Column:
    out = F.translate(c, SPEECH_FROM, SPEECH_TO)
    for a, b in SPEECH_WORDS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, SPEECH_DROP, "")


def clean_text(c: Column) -> Column:
    """Markup, links, addresses and characters that can't be read aloud removed."""
    for pattern, to in CLEAN_STEPS:
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(for_speech(c), f"^{WS}+|{WS}+$", "")


def expand_abbreviations(c: Column) -> Column:
    for short, long in ABBREVIATIONS:
        end = "" if short.endswith(")") else r"(?![\p{L}\p{N}_])"
        c = F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){short}{end}", long)
    return c


def is_noise_line(c: Column) -> Column:
    """Empty lines, links, shop names, bare page numbers of three or four digits and a few whole lines."""
    return (c == "") | c.isin(*NOISE_LINES) | c.rlike(NOISE_LINE)


def noise_rule(c: Column) -> Column:
    """The rule by which a block is noise, or null."""
    # A domain makes noise of short blocks and of those with a path or an address, a contents title of short ones
    also = {"domain": (word_count(c) <= 12) | c.rlike("[/@]"), "contents": F.length(c) < 30}
    out = None
    for name, pattern in NOISE_RULES:
        hit = c.rlike(pattern) & also[name] if name in also else c.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


# How a short block begins that is a heading.
PROMOTED = r"(?iu)^(?:Chương|Chapter|Tiết|Phần|Mục|Hồi) +(?:[0-9]+|[IVXLCDM]+|[MộtHaiBaBốnNămSáuBảyTámChínMười]+)"


def is_promoted(c: Column) -> Column:
    """Whether a cleaned block of fewer than ten words is a heading by its beginning."""
    return (word_count(c) < 10) & c.rlike(PROMOTED)


def dedupe_key(c: Column) -> Column:
    """Lower case, digits as #, single spaces, trimmed of rules and bullets, 120 characters."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", "#"), f"{WS}+", " ")
    return F.substring(F.regexp_replace(out, r"^[ –—_|•·-]+|[ –—_|•·-]+$", ""), 1, 120)


def sentences(c: Column) -> Column:
    """Sentences after closing marks; blank ones dropped."""
    parts = F.transform(F.split(c, SENTENCE_SPLIT), lambda s: F.regexp_replace(s, f"^{WS}+|{WS}+$", ""))
    return F.filter(parts, lambda s: s != "")


def speech_segments(c: Column) -> Column:
    """Sentences as a speech engine gets them, closing quotes included; a text without a mark is one."""
    found = F.regexp_extract_all(c, F.lit(TTS_SENTENCE), F.lit(0))
    trimmed = F.filter(F.transform(found, lambda s: F.regexp_replace(s, f"^{WS}+|{WS}+$", "")), lambda s: s != "")
    whole = F.regexp_replace(c, f"^{WS}+|{WS}+$", "")
    return F.when(F.size(trimmed) > 0, trimmed).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"{NON_WS}+"))


def ends_sentence(c: Column) -> Column:
    return c.rlike(rf"[.?!。！？]{WS}*$")


def is_dialogue(c: Column) -> Column:
    return c.rlike(DIALOGUE)


def language(c: Column, threshold: float = 0.015) -> Column:
    """vi, zh, en or unknown, by the letters of the first 5000 characters."""
    head = F.substring(c, 1, 5000)
    # letters are counted by what is left without them, runs of others by what is left of them
    vietnamese = F.length(head) - F.length(F.translate(head, VIETNAMESE, ""))
    chinese = F.length(F.regexp_replace(head, "[^一-鿿]+", ""))
    return (
        F.when(c.isNull() | ~head.rlike(NON_WS), "unknown")
        .when(vietnamese / F.length(head) >= threshold, "vi")
        .when(chinese / F.length(head) > 0.1, "zh")
        .otherwise("en")
    )


def slug(c: Column, fallback: str = "item", size: int = 80) -> Column:
    """A file name's stem: ASCII letters and digits, single hyphens."""
    out = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), "-+", "-")
    out = F.regexp_replace(F.substring(F.regexp_replace(out, "^[-._]+|[-._]+$", ""), 1, size), "[-._]+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(fallback))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_metadata(c: Column) -> Column:
    for a in ("\\", "=", ";", "#"):
        c = F.replace(c, F.lit(a), F.lit("\\" + a))
    return F.replace(c, F.lit("\n"), F.lit("\\\n"))


def pause_ms(c: Column) -> Column:
    """Milliseconds of silence after a text, by its last mark."""
    t = F.regexp_replace(c, f"{WS}+$", "")
    return (
        F.when(t.endswith("..."), 600).when(t.endswith("."), 500).when(t.endswith(","), 300).when(t.rlike("[!?]$"), 700).when(t.rlike("[;:]$"), 400).otherwise(200)
    )


def training_reason(text: Column, seconds: Column) -> Column:
    """Why a speech-training sample is left out; 'ok' for those kept.  The first reason counts."""
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(text.rlike("[0-9]"), "digit")
        .when(text.rlike(r"(?:[a-zA-Z]\.){2,}|[A-Z]{2,}"), "acronym")
        .when(~text.rlike(r"[.,?!]$"), "end")
        .when(seconds.isNull() | (seconds < 3.0), "short")
        .when(seconds > 15.0, "long")
        .otherwise("ok")
    )
