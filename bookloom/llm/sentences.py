"""Problem 6: sentence boundaries in eleven languages.

What a period means is learned without labels, for each language, from all
records.  A first pass lists every place where a sentence could end, with the
token before it and the token after it.  Counts over these places give

* sentence starters: tokens whose share of sentence-initial uses (record starts
  and places after unambiguous marks) is high by a log-likelihood ratio;
* abbreviations: token types before a period that starters do not follow; a long
  type only where log-likelihood ratios tie it to its period and keep starters
  from it;
* collocations: numbers and initials and the token after their period that a
  log-likelihood ratio ties together (a date's month), where that is no starter;
* for scripts that end sentences with a space only, chunks that never begin a
  record although they are frequent, as wholes, by prefix or by suffix.

A second, relational pass classifies each distinct (before, after) context and
joins the verdict to the places, so the tables may be of any size.

Defined results
---------------
* null, empty and blank text: no boundary; the end of a text is never listed.
* marks inside a quotation or parentheses end no sentence; after a closing quote
  that ends with a mark the sentence ends unless the reporting clause follows.
* an unknown or null language is read as a cased language without statistics of
  its own: it forms the group "other".
* keys delivered twice count once, in the statistics too.  Columns other than
  the key, text, language (and origin for paragraphs) are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.functions import text as T
from bookloom.llm.common import lang_code, materialise, once_of

# Scripts and marks.
CASELESS = {"zh", "ja", "th", "hi", "fa"}
NO_SPACE = {"zh", "ja"}
SPACE_ENDS = {"th"}
MARKS = re.compile(r"[.!?…。！？।؟۔]+")
CLOSERS = "\"'”’»」』)]"
# each sign scans to the next one of its kind, so a search is linear
SPANS = re.compile(r"“[^“”]*”|«[^«»]*»|„[^„“]*“|「[^「」]*」|『[^『』]*』|\"[^\"\n]+\"|\([^()\n]+\)|（[^（）]+）")
BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")
WHITE = re.compile(r"\s*")
SPAN_SIGNS = re.compile(r"[“«„「『\"(（]")
STOP = re.compile(r"[.!?…。！？।؟۔\n]|\Z")
RUN = re.compile(r"\S*")
WORD_AFTER = re.compile(r"[\"'“‘«„(\[¿¡—–-]*\s*([^\s.,;:!?…”»\")\]]+)")
NUMBER = re.compile(r"[\d.,]*\d[\d.,]*\Z")
TOKEN = re.compile(r"[^\W\d_][\w'’-]*")
DOTTED = re.compile(r"([^\W\d_][\w'’-]*)\.(?!\w)")
# Verbs of clauses that report speech, as stems.
REPORTING = {
    "vi": "hỏi nói gọi đáp kêu hét thét bảo reo thì_thầm trả_lời".split(),
    "en": "said asked cried called replied answered whispered shouted says asks".split(),
    "fr": "dit demanda cria répondit murmura ajouta".split(),
    "de": "sagte fragte rief antwortete flüsterte schrie".split(),
    "es": "dijo preguntó gritó respondió murmuró contestó".split(),
    "ru": "сказал спросил крикнул ответил прошептал воскликнул".split(),
    "zh": "说 问 喊 道 叫 答".split(),
    "ja": "と 言 叫 尋 の一言".split(),
    "th": "ร้อง พูด ถาม ตอบ กล่าว บอก".split(),
    "hi": "कहा पूछा बोल चिल्ला".split(),
    "fa": "گفت پرسید زد پاسخ".split(),
}
# Words after a reporting verb that make it report a question of its own.
INDIRECT = (" liệu ", " whether ", " if ", " ob ", " si ", " ли ")
# A reporting clause has its verb among so many first words, in unspaced scripts first characters.
CLAUSE_WORDS, CASELESS_CLAUSE_WORDS, CLAUSE_CHARS = 4, 6, 40
DASHES = re.compile(r"[—– -]*")
#: A type with fewer uses before a period than this is judged by its form.
FEW = 4
#: Share of starters after a type from which its period ends sentences.
TERMINAL_SHARE = 0.2
#: Share of sentence-initial uses from which a token is a strong starter.
STARTER_SHARE = 0.75
#: Log-likelihood ratio (chi-square, p about 0.005) that starters, abbreviations and collocations must reach.
STARTER_LLR = 7.88
#: Share of sentence-initial uses from which a token can open a sentence after a number or an unclear type.
OPENS_SHARE = 0.05
#: A chunk of a space-ended script this frequent that never begins a record is no starter.
CHUNK_FEW = 8

PLACES = "record_table string, record_id long, lang string, end_pos int, kind string, before string, after string, n long"


def _reports(lang: str, clause: str) -> bool:
    clause = clause.lower() + " "
    if any(w in clause for w in INDIRECT):
        return False
    return any(v.replace("_", " ") in clause for v in REPORTING.get(lang, ()))


def _upper(token: str, after: str) -> bool:
    """True if a token could open a sentence in a cased language."""
    c = token[:1]
    if c.isupper() or c.isdigit():
        return True
    return not c.isalpha() and bool(after) or any(x.isupper() for x in token[1:3])


def places(text: str, lang: str) -> tuple[list[tuple[int, str, str, str]], str]:
    """((end_pos, kind, before, after), ...) of one text and its first token.

    kind: 'sure' ends a sentence, 'dot' depends on the statistics, 'gap' is a
    space of a script without marks.
    """
    n = len(text)
    caseless = lang in CASELESS
    spans = _spans(text) if SPAN_SIGNS.search(text) else []
    out = []
    k, begin = 0, 0
    for m in MARKS.finditer(text):
        s, e = m.start(), m.end()
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        closed = False
        opened = s
        if k < len(spans) and spans[k][0] < s < spans[k][1]:
            if e >= spans[k][2]:
                if text[spans[k][0]] in "(（":
                    continue
                opened, e, closed = spans[k][0], spans[k][1], True
            else:
                continue
        else:
            while e < n and text[e] in CLOSERS and text[e] not in ")]":
                e += 1
        if e >= n:
            continue
        at = WHITE.match(text, e).end()
        if at >= n:
            continue
        head = text[at]
        spaced = at > e
        mark = m.group()
        if closed:
            clause = text[at : min(STOP.search(text, at).start(), at + CLAUSE_CHARS)]
            if lang in NO_SPACE:
                if text[begin:opened].strip() or _reports(lang, clause):
                    continue
            elif head in ",，、،;:—–-" or head.islower() and not _upper(RUN.match(text, at)[0], True):
                continue
            elif _reports(lang, " ".join(clause.split()[: CLAUSE_WORDS if not caseless else CASELESS_CLAUSE_WORDS])):
                continue
            elif caseless and text[begin:opened].strip():
                continue
            out.append((e, "sure", mark, _after(text, at)))
            begin = e
            continue
        if lang in NO_SPACE:
            if mark[-1] in "。！？" or mark[-1] in "!?" and not head.isascii():
                out.append((e, "sure", mark, _after(text, at)))
                begin = e
            continue
        after = _after(text, at)
        dots = mark.strip("….")
        if lang in SPACE_ENDS:
            continue
        if not spaced:
            # a lost space: only a word's period before a capitalised word counts
            if not (s > 1 and text[s - 1].isalpha() and text[s - 2].isalpha() and head.isupper() and len(after) > 1 and not (text[s - 1].isupper())) and mark[-1] not in "।؟۔":
                if not (dots and text[s - 1].isalnum() and head.isupper()):
                    continue
        if caseless:
            if dots:
                out.append((e, "sure", mark, after))
                begin = e
            elif mark == ".":
                out.append((e, "dot", _before(text, s), after))
            continue
        if head in "—–-" and not text[e : e + 2].strip("\n ") == "":
            nxt = DASHES.match(text, at).end()
            if nxt >= n or not text[nxt].isupper():
                continue
        if not _upper(after, True):
            continue
        if dots or len(mark) > 1 or mark == "…":
            out.append((e, "sure", mark, after))
            begin = e
        else:
            out.append((e, "dot", _before(text, s), after))
    if lang in SPACE_ENDS:
        k = 0
        for m in re.finditer(r"\s+", text):
            s, e = m.start(), m.end()
            while k < len(spans) and spans[k][1] <= s:
                k += 1
            if k < len(spans) and spans[k][0] < s < spans[k][1] or s == 0 or e >= n:
                continue
            out.append((s, "gap", _chunk(_before(text, s)), _chunk(RUN.match(text, e)[0])))
    for m in BLANK_LINE.finditer(text):
        end = len(text[: m.start()].rstrip())
        if 0 < end and m.end() < n and not any(p[0] == end for p in out):
            out.append((end, "sure", "\n", _after(text, m.end())))
    at = WHITE.match(text).end()
    first = _chunk(RUN.match(text, at)[0]) if lang in SPACE_ENDS else _after(text, at)
    return out, first


def _spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, where the closing signs begin) of quotations and brackets, of any length within a paragraph."""
    out = []
    at = 0
    for stop in [*(m.start() for m in BLANK_LINE.finditer(text)), len(text)]:
        for m in SPANS.finditer(text, at, stop):
            core = m.end()
            while core > m.start() and text[core - 1] in CLOSERS + "“ ":
                core -= 1
            out.append((m.start(), m.end(), core))
        at = stop
    return out


def _chunk(word: str) -> str:
    return "#" if NUMBER.match(word) else word


def _before(text: str, end: int) -> str:
    """The run of characters that aren't white space before a place."""
    at = end
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    word = text[at:end].lstrip("\"'“‘«„([—–-")
    return "#" if NUMBER.match(word) else word


def _after(text: str, at: int) -> str:
    m = WORD_AFTER.match(text, at)
    if not m:
        return ""
    return "#" if NUMBER.match(m[1]) else m[1]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["record_table", "record_id", "lang", "end_pos", "kind", "before", "after", "n"]
    for b in batches:
        rows: list[tuple] = []
        first: Counter = Counter()
        caps: Counter = Counter()
        low: Counter = Counter()
        dotted: Counter = Counter()
        for name, key, text, lang in zip(b.record_table, b.record_id, b.text, b.lang):
            found, start = places(text, lang)
            rows += [(name, key, lang, p, kind, w, a, 1) for p, kind, w, a in found]
            first[lang, start] += 1
            if lang not in CASELESS:
                for w in TOKEN.findall(text):
                    (low if w.islower() else caps)[lang, w] += 1
                if "." in text:
                    dotted.update((lang, w) for w in DOTTED.findall(text))
        rows += [(None, None, lang, None, "first", None, w, n) for (lang, w), n in first.items()]
        for kind, counts in (("caps", caps), ("low", low), ("dotted", dotted)):
            rows += [(None, None, lang, None, kind, None, w, n) for (lang, w), n in counts.items()]
        yield pd.DataFrame(rows, columns=names).astype({"record_id": "Int64", "end_pos": "Int32"})


def _llr(k1, n1, k2, n2):
    """Dunning's log-likelihood ratio of k1 in n1 against k2 in n2, as a column."""

    def part(k, n, p):
        return k * F.log(F.greatest(p, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))

    p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / n1, k2 / n2
    return 2 * (part(k1, n1, p1) + part(k2, n2, p2) - part(k1, n1, p) - part(k2, n2, p))


def _told(k: str, n: str, all_k: str, all_n: str):
    """Dunning's ratio of k in n against all the other uses, the share in n and the share in the others."""
    one = [F.greatest(F.col(c).cast("double"), F.lit(0.0)) for c in (k, n, all_k, all_n)]
    k1, n1 = F.least(one[0], one[1]), F.greatest(one[1], F.lit(1e-9))
    k2, n2 = F.greatest(one[2] - one[0], F.lit(0.0)), F.greatest(one[3] - one[1], F.lit(1e-9))
    k2 = F.least(k2, n2)
    return _llr(k1, n1, k2, n2), k1 / n1, k2 / n2


def _more(*counts: str):
    llr, share, others = _told(*counts)
    return (llr >= STARTER_LLR) & (share > others)


def _less(*counts: str):
    llr, share, others = _told(*counts)
    return (llr >= STARTER_LLR) & (share < others)


def verdicts(scan: DataFrame) -> DataFrame:
    """(lang, kind, before, after) -> ends, for contexts that depend on statistics."""
    starts = (
        scan.where("kind in ('first', 'sure')")
        .groupBy("lang", "after")
        .agg(F.sum("n").alias("starts"))
        .unionByName(
            # after a long lower-case word a period is all but certain
            scan.where("kind = 'dot' and length(before) >= 5 and lower(before) = before and not before rlike '[.]'")
            .groupBy("lang", "after")
            .agg(F.sum("n").alias("starts"))
        )
        .groupBy("lang", "after")
        .agg(F.sum("starts").alias("starts"))
    )
    caps = scan.where("kind = 'caps'").groupBy("lang", "after").agg(F.sum("n").alias("uses"))
    # places whose period is still open say nothing about the token after them
    undecided = scan.where("kind = 'dot' and not (length(before) >= 5 and lower(before) = before and not before rlike '[.]')")
    undecided = undecided.groupBy("lang", "after").agg(F.sum("n").alias("undecided"))
    both = starts.join(caps, ["lang", "after"], "left").join(undecided, ["lang", "after"], "left")
    # of all its uses, those after open periods too
    both = both.withColumn("opens", F.col("starts") >= OPENS_SHARE * F.coalesce("uses", "starts"))
    both = both.withColumn("uses", F.greatest(F.coalesce("uses", "starts") - F.coalesce("undecided", F.lit(0)), "starts").cast("double"))
    total = both.groupBy("lang").agg(F.sum("starts").alias("all_starts"), F.sum("uses").alias("all_uses"))
    starters = (
        both.join(F.broadcast(total), "lang")  # one row for each of at most twelve languages
        .withColumn("llr", _llr(F.col("starts") * 1.0, F.col("uses"), F.col("all_starts") - F.col("starts") + 0.0, F.col("all_uses") - F.col("uses") + 1e-9))
        .select("lang", "after", (F.col("starts") >= STARTER_SHARE * F.col("uses")).alias("often"), "llr", "opens")
        .withColumn("strong", F.col("often") & (F.col("llr") >= STARTER_LLR) & ~F.col("after").isin("#", ""))
        .select("lang", "after", "strong", "opens")
    )
    contexts = scan.where("kind = 'dot'").groupBy("lang", "before", "after").agg(F.sum("n").alias("n"))
    # written once: one row for each distinct context, read for the types and for the verdicts
    contexts = materialise(contexts.join(starters, ["lang", "after"], "left").fillna({"strong": False, "opens": False}))
    types = contexts.groupBy("lang", "before").agg(
        F.sum("n").alias("uses_before"), F.sum(F.when(F.col("strong"), F.col("n")).otherwise(0)).alias("strong_after")
    )
    # Dunning's ratios of (type, period), of (type, starter after the period) and of (before, after)
    uses = scan.where("kind in ('caps', 'low', 'dotted')").groupBy("lang", F.col("after").alias("before")).agg(
        F.sum(F.when(F.col("kind") == "dotted", F.col("n")).otherwise(0)).alias("periods"), F.sum(F.when(F.col("kind") == "dotted", 0).otherwise(F.col("n"))).alias("tokens")
    )
    sums = uses.groupBy("lang").agg(F.sum("periods").alias("all_periods"), F.sum("tokens").alias("all_tokens"))
    dots_of = types.groupBy("lang").agg(F.sum("uses_before").alias("all_dots"), F.sum("strong_after").alias("all_strong"))
    per_lang = dots_of.join(sums, "lang", "left")
    types = types.join(uses, ["lang", "before"], "left").join(F.broadcast(per_lang), "lang")  # one row for each of at most twelve languages
    # a type that no token is like (it holds periods) is tied to its period by its form
    tied = F.coalesce(_more("periods", "tokens", "all_periods", "all_tokens"), F.lit(True))
    shunned = _less("strong_after", "uses_before", "all_strong", "all_dots")
    types = types.select("lang", "before", "uses_before", "strong_after", "all_dots", (tied & shunned).alias("abbreviated"))
    afters = contexts.groupBy("lang", "after").agg(F.sum("n").alias("uses_after"))
    # where another mark ends most sentences, a period is an abbreviation's
    danda = scan.where("kind = 'sure'").groupBy("lang").agg(F.avg(F.col("before").contains("।").cast("double")).alias("danda"))
    letters = F.length(F.regexp_replace("before", r"[^\p{L}]", ""))
    share = F.col("strong_after") / F.col("uses_before")
    caseless = F.col("lang").isin(*CASELESS)
    by_form = (letters >= 4) | (F.lower("before") == F.col("before")) & (letters >= 2) & ~F.col("before").contains(".")
    ends = (
        F.when(F.coalesce("danda", F.lit(0.0)) > 0.5, F.lit(False))
        .when(caseless, letters >= 1)
        .when(F.col("collocated"), F.lit(False))
        .when(F.col("before").isin("#", ""), F.col("opens"))
        .when(F.col("uses_before") < FEW, by_form | F.col("strong"))
        .when((share >= TERMINAL_SHARE) & ((letters > 3) | F.col("before").contains(".")), F.col("opens") | (letters > 3))
        .when(share >= TERMINAL_SHARE, F.col("opens") | F.col("after").isin("#") & (letters > 2))
        .when((letters > 5) & ~F.col("before").contains(".") & ~F.col("abbreviated"), F.lit(True))
        .otherwise(F.col("strong"))
    )
    dots = (
        contexts.join(types, ["lang", "before"])
        .join(afters, ["lang", "after"])
        .withColumn("collocated", _more("n", "uses_before", "uses_after", "all_dots") & ~F.col("strong") & ~F.col("opens") & ((F.col("before") == "#") | (letters == 1)))
        .join(F.broadcast(danda), "lang", "left")
        .select("lang", F.lit("dot").alias("kind"), "before", "after", ends.alias("ends"))
    )
    # scripts that end sentences with a space: chunks that do and do not begin records
    seen = scan.where(F.col("lang").isin(*SPACE_ENDS) & F.col("kind").isin("gap", "first")).groupBy("lang", "after").agg(
        F.sum("n").alias("uses"), F.sum(F.when(F.col("kind") == "first", F.col("n")).otherwise(0)).alias("first")
    )
    seen = seen.withColumn("head", F.substring("after", 1, 3)).withColumn("tail", F.expr("right(after, 9)"))
    never = lambda *by: seen.groupBy("lang", *by).agg(F.sum("uses").alias("u"), F.sum("first").alias("f")).select("lang", *by, ((F.col("u") >= CHUNK_FEW) & (F.col("f") == 0)).alias("never_" + by[0]))
    gaps = (
        seen.join(never("head"), ["lang", "head"])
        .join(never("tail"), ["lang", "tail"])
        .select(
            "lang",
            F.lit("gap").alias("kind"),
            F.lit(None).cast("string").alias("before"),
            "after",
            (~(F.col("never_head") | F.col("never_tail") | ((F.col("uses") >= CHUNK_FEW) & (F.col("first") == 0)) | (F.col("after") == "#"))).alias("ends"),
        )
    )
    return dots.unionByName(gaps)


def sentence_ends(records: DataFrame) -> DataFrame:
    """(record_table, record_id, end_pos) of ``records(record_table, record_id, text, lang)``, keys counted once."""
    base = records.where(F.length(F.trim("text")) > 0).withColumn("lang", lang_code(F.col("lang")))
    scan = materialise(base.mapInPandas(_scan, PLACES))
    told = materialise(verdicts(scan))
    key = ["record_table", "record_id", "end_pos"]
    sure = scan.where("kind = 'sure'").select(*key)
    dots = scan.where("kind = 'dot'").join(told.where("kind = 'dot'").drop("kind"), ["lang", "before", "after"]).where("ends").select(*key)
    gaps = scan.where("kind = 'gap'").join(told.where("kind = 'gap'").drop("kind", "before"), ["lang", "after"]).where("ends").select(*key)
    return sure.unionByName(dots).unionByName(gaps)


def records(spark: SparkSession, sf_dir: str, origin: str | None = "epub") -> DataFrame:
    """Segments and paragraphs (of one origin, or all), each key once; texts stay where they are."""
    p = once_of(spark, sf_dir, "paragraphs", ["paragraph_id"], ["text", "lang"], F.col("origin") == origin if origin else None)
    p = p.select(F.lit("paragraphs").alias("record_table"), F.col("paragraph_id").alias("record_id"), "text", "lang")
    s = once_of(spark, sf_dir, "tts_segments", ["segment_id"], ["text", "lang"])
    return p.unionByName(s.select(F.lit("tts_segments").alias("record_table"), F.col("segment_id").alias("record_id"), "text", "lang"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_ends(records(spark, sf_dir))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for name, key, text, ends in zip(b.record_table, b.record_id, b.text, b.ends):
            at = 0
            for k, e in enumerate([*sorted(int(x) for x in ends), len(text)]):
                rows.append((name, key, k, text[at:e].strip()))
                at = e
        yield pd.DataFrame(rows, columns=["record_table", "record_id", "sentence_no", "sentence"])


def p6_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every paragraph and segment, in order; a record of one sentence gives that one, a blank one none."""
    rows = records(spark, sf_dir, origin=None)
    ends = sentence_ends(rows).groupBy("record_table", "record_id").agg(F.collect_list("end_pos").alias("ends"))
    texts = rows.where(F.length(F.trim("text")) > 0).join(ends, ["record_table", "record_id"], "left").select(
        "record_table", "record_id", "text", F.coalesce("ends", F.array().cast("array<int>")).alias("ends")
    )
    return texts.mapInPandas(_cut, "record_table string, record_id long, sentence_no int, sentence string")


def p6_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every record's sentences make when put together, white space aside: nothing is lost and the order is kept."""
    s = p6_sentences(spark, sf_dir).groupBy("record_table", "record_id").agg(F.array_sort(F.collect_list(F.struct("sentence_no", "sentence"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["sentence"]), "")
    return s.select("record_table", "record_id", F.md5(F.regexp_replace(text, T.WS, "").cast("binary")).alias("digest"))


P6_COMPLETE_SQL = f"""
SELECT DISTINCT record_table, record_id, md5(regexp_replace(text, '{T.WS}', '', 'g')) AS digest FROM (
  SELECT 'paragraphs' AS record_table, paragraph_id AS record_id, text FROM paragraphs UNION ALL SELECT 'tts_segments', segment_id, text FROM tts_segments)
WHERE length(trim(text, ' ')) > 0
"""
