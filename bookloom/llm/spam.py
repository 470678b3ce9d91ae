"""Problem 9: documents that are keywords, tags, links or product lines.

A document is a sequence of lines; long lines are cut into pieces at sentence
ends and separators.  A hidden Markov model labels each line as prose, link
list, tag list, menu (keyword and product lines), refrain (words and sentences that
only repeat a keyword) or apparatus (lists that belong to books).  Emissions are products of
tables over binned features.

No list of spam words is given; the words of keyword lines are learned.  A first
decoding looks at the lines' form alone.  The documents in which a word stands in
lines labelled as spam and in others are counted over the whole corpus, words of
any language and script hashed into ``BUCKETS`` counters (a table of one size,
whatever the vocabulary).  Words that a log-likelihood ratio ties to spam lines
become a feature, "learned"; then one round of Viterbi training over all documents
re-estimates the tables, which start from a stated prior.  What training gathers is
a count for each (state, feature, bin).

A document is a case if more than half of its words stand in link, tag, menu or
refrain lines.  Equal texts have equal labels.

Defined results
---------------
* null, empty and blank text: no lines, no case.
* ties go to the earlier state (prose first).  A document of exactly half is no
  case.  Columns other than the key and the text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import materialise, table

STATES = ("prose", "link", "tag", "menu", "refrain", "apparatus")
SPAM = np.array([False, True, True, True, True, False])
#: Features and their numbers of bins.
FEATURES = (("url", 4), ("hash", 3), ("separators", 3), ("sentence", 2), ("repeated", 4), ("list", 7), ("product", 2), ("learned", 4))
CODES = int(np.prod([size for _, size in FEATURES]))
#: Staying in a state from one line to the next.
STAY = 0.85
#: Weight of the prior tables against the counts of training, in lines.
PRIOR_LINES = 500.0
#: A line longer than this is cut into pieces of at least PIECE characters.
LONG, PIECE = 220, 130
#: Counters of hashed words.
BUCKETS = 1 << 18
#: A word is a spam word if this many documents have it in spam lines, this log-likelihood ratio ties it to them, and
#: its share of spam lines' documents is so many times that of other lines'.
LEAST_DOCUMENTS, LEAST_LLR, LEAST_RATIO = 3, 10.83, 4.0
#: Shares of learned words in a line from which the bins of that feature begin.
LEARNED = (0.08, 0.25, 0.5)
#: A document counts from this share of words in link, tag and menu lines.
SHARE = 0.5

URL = re.compile(
    r"(?:https?|hxxps?|ftp)://\S+|\bwww[.\[(]\S+|\b(?=[0-9-]*[a-z])[a-z0-9-]{2,}(?:(?:\.|\[\.\]|\(\.\))[a-z0-9-]+)*(?:\.|\[\.\]|\(\.\))(?-i:[a-z]{2,12})\b(?:/\S*)?"
    r"|\b[a-z0-9-]{2,}(?: dot [a-z0-9-]+)* dot (?-i:[a-z]{2,7})\b(?:/\S*)?|</?(?:a|li|ul|ol|nav|div|span|p)\b[^>]*>",
    re.I,
)
HASH = re.compile(r"(?<!\S)#\w[\w'’-]*")
SEPARATORS, DASH = "•|→›»·;\t/,、，", re.compile(r" [-–—] ")
SENTENCE_END = re.compile(r"[.!?。！？।…؟۔][\"'”’»」』)]*(?=\s|$)|[。！？।]")
CUT = re.compile(r"[.!?…]+[\"'”’»)]*\s+|[。！？।؟۔]+[”’」』]*|[•|→;\t,、，]\s*| [-–—/] |\s+")
PRODUCT = re.compile(r"\bSKU\b|★{2,}|[-–]\d{1,2} ?%|[$€£₫]\s?\d|\d\s?(?:[$€£₫]|USD|EUR|VND)\b|in stock|add to cart", re.I)
# Lists that belong to books.
LISTS = (
    re.compile(r"\.{4,}\s*\d+\s*\Z|…{2,}\s*\d+\s*\Z"),
    re.compile(r"[^.!?:#/]{2,60}?(?:,\s*\d{1,4}(?:[–-]\d{1,4})?)+\s*\Z"),
    re.compile(r"[^\d()]{3,60}\((?:1[5-9]|20)\d\d[a-z]?\)\.\s"),
    re.compile(r"\d+(?:[.,/]\d+)?\s?(?:g|kg|mg|ml|cl|dl|l|tbsp|tsp|cups?|oz|lb|thìa|muỗng|克|グラム|г|мл)\b\.?\s+\S[^.!?]{1,60}\Z", re.I),
    re.compile(r"[^\s:：][^:：.!?#/]{0,40}[:：]\s+(?!\S*(?:https?:|hxxps?:|www|\w\.\w))\S.{8,}", re.S),
)
#: What a link and a price must hold, and digits inside words: tests that the patterns above imply.
DOTTED = re.compile(r"\.[A-Za-z\])[(]", re.I)
PRICED = re.compile(r"[%$€£₫★]")
LEETED = re.compile(r"[03@1$5][^\W\d_]")
# words go on over apostrophes and hyphens; digits and signs for letters are read as those in lines that have them
TOKEN = re.compile(r"[^\W_][\w\u0300-\u036f\u0900-\u0e7f'’@$-]*")
LEET = tuple(zip("03@1$5_", "oeaiss ", strict=True))
CJK = re.compile(r"[぀-ヿ㐀-鿿]")
UNSPACED = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
WORD = re.compile(r"[^\w]{0,3}[^\W\d_]+(?:['’-][^\W\d_]+)*[^\w\s]{0,3}\Z|[–—-]\Z")
WORDS = re.compile(r"[぀-ヿ㐀-鿿]{1,2}|[^\s぀-ヿ㐀-鿿]+")


def lines(text: str) -> list[str]:
    """Lines of a document; long ones in pieces."""
    out = []
    marked = "</li>" in text or "<br" in text
    for line in re.split(r"[\r\n]+|(?<=</li>)|<br ?/?>", text) if marked else text.replace("\r", "\n").split("\n"):
        line = line.strip()
        if not line:
            continue
        if len(line) <= LONG:
            out.append(line)
            continue
        at = 0
        while len(line) - at > LONG:
            end = SENTENCE_END.search(line, at + PIECE, at + LONG + 1) or CUT.search(line, at + PIECE, at + 2 * LONG)
            cut = end.end() if end else at + LONG
            out.append(line[at:cut])
            at = cut
        out.append(line[at:])
    return out


def _repeated(line: str, words: list[str], cjk: bool) -> float:
    """The share of a line in short sequences that it says again and again.

    Words: pairs said three times, longer words said four times.  Scripts
    without spaces: triples of characters said three times.  A refrain or a
    sentence said twice isn't what stuffing does.
    """
    if cjk and len(CJK.findall(line)) * 2 > len(line):
        s = "".join(words)
        if len(s) < 9:
            return 0.0
        grams = Counter(map("".join, zip(s, s[1:], s[2:])))
        return sum(n for n in grams.values() if n >= 3) / (len(s) - 2)
    if len(words) < 4 or len(set(words)) > 0.85 * len(words):
        return 0.0
    words = [w[:-1] if w[-1] == "s" and len(w) > 3 else w for w in words]
    single = Counter(words)
    # no pair is said more often than its words
    if max(single.values()) < 3:
        return 0.0
    pairs = Counter(zip(words, words[1:]))
    hit = [False] * len(words)
    often = {p for p, n in pairs.items() if n >= 3}
    alone = {w for w, n in single.items() if n >= 4 and len(w) >= 4}
    if not often and not alone:
        return 0.0
    for i, w in enumerate(words):
        if w in alone:
            hit[i] = True
        if i + 1 < len(words) and (w, words[i + 1]) in often:
            hit[i] = hit[i + 1] = True
    return sum(hit) / len(hit)


def _flat(values, n: int) -> pa.Array:
    return pa.array(np.fromiter(values, np.int32, n))


def _observed(keys: pa.Array, found: list[list[tuple[int, int, list[int]]]]) -> pa.RecordBatch:
    """Documents with the codes, words and numbers of keys of their lines, and all keys."""
    all_lines = list(chain.from_iterable(found))
    sizes = np.fromiter((len(x[2]) for x in all_lines), np.int32, len(all_lines))
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
    of_keys = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at, at_keys = pa.array(ends.astype(np.int32)), pa.array(of_keys[ends].astype(np.int32))
    columns = [pa.ListArray.from_arrays(at, x) for x in (_flat((x[0] for x in all_lines), len(all_lines)), _flat((x[1] for x in all_lines), len(all_lines)), pa.array(sizes))]
    columns.append(pa.ListArray.from_arrays(at_keys, _flat(chain.from_iterable(x[2] for x in all_lines), int(of_keys[-1]))))
    return pa.RecordBatch.from_arrays([keys, *columns], ["doc_id", "codes", "words", "sizes", "keys"])


class _Buckets(dict):
    """Word -> counter, kept for the words met so far up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        # numbers and signs share counter 0, which is never learned
        out = self[word] = crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1 if word[0].isalpha() else 0
        return out


_buckets = _Buckets()


class _Kept(dict):
    """What a function gives for a short token, kept for the tokens met so far up to a bound."""

    def __init__(self, work):
        self.work = work

    def __missing__(self, token: str):
        out = self.work(token)
        if len(token) <= 24:
            if len(self) > 100_000:
                self.clear()
            self[token] = out
        return out


def _unleeted(text: str) -> str:
    for sign, letter in LEET:
        text = text.replace(sign, letter)
    return text


# no word goes over white space, so a line's words are those of its tokens
_plain = _Kept(lambda token: bool(WORD.match(token)))
_words_of = _Kept(lambda token: TOKEN.findall(token.lower().replace("_", " ")))
_words_of_leeted = _Kept(lambda token: TOKEN.findall(_unleeted(token.lower())))


def features(line: str) -> tuple[int, int, list[int]]:
    """A line's bins as one number (that of the learned words still 0), its words, and their counters."""
    wide = not line.isascii() and bool(UNSPACED.search(line))
    cjk = wide and bool(CJK.search(line))
    tokens = line.split()
    words = len(WORDS.findall(line)) if cjk else len(tokens)
    n = max(1, len(line))
    linking = "." in line and DOTTED.search(line) or "://" in line or "<" in line or " dot " in line or "(" in line and "www(" in line.lower() or "[" in line and "www[" in line.lower()
    found = URL.findall(line) if linking else []
    linked = sum(map(len, found)) / n
    rest = line
    if found:
        rest = URL.sub(" ", line)
        tokens = rest.split()
    url = 0 if not found else 1 if linked < 0.3 else 2 if linked < 0.6 else 3
    tags = len(HASH.findall(rest)) if "#" in rest else 0
    hashed = 0 if not tags else 1 if tags * 3 < words else 2
    separated = (sum(map(rest.count, SEPARATORS)) + len(DASH.findall(rest))) / max(1, words)
    sep = 0 if separated < 0.12 else 1 if separated < 0.24 else 2
    small = rest.lower()
    low = list(chain.from_iterable(map((_words_of_leeted if LEETED.search(small) else _words_of).__getitem__, tokens)))
    unspaced = wide and len(UNSPACED.findall(rest)) * 4 > len(rest)
    product = int((bool(PRICED.search(rest)) or "sku" in small or "usd" in small or "eur" in small or "vnd" in small or "stock" in small or "cart" in small) and bool(PRODUCT.search(rest)))
    longest = max(map(len, tokens), default=0)
    # a script that ends sentences with spaces writes prose in long runs
    running = unspaced and len(rest) > 9 * max(1, len(tokens))
    ended = int(running or bool(SENTENCE_END.search(rest)))
    r = _repeated(rest, low, cjk)
    if r >= 0.12 and ended:
        # sentences said again count once, if they are sentences
        kept, once = [], set()
        for part in SENTENCE_END.split(rest):
            if len(part) < (6 if cjk else 12) or part.strip() not in once:
                kept.append(part)
                once.add(part.strip())
        if len(kept) <= len(SENTENCE_END.findall(rest)):
            again = " ".join(kept)
            r = _repeated(again, TOKEN.findall(_unleeted(again.lower())), cjk)
    if not unspaced and longest >= 40 and longest * 3 > len(rest):
        r = 0.0
    repeated = 0 if r < 0.12 else 1 if r < 0.3 else 2 if r < 0.5 else 3
    listed = 0
    if not product and not tags:
        may = ("...." in line or "…" in line, "," in line, "(" in line, line[:1].isdigit(), not found and (":" in line or "：" in line))
        for k, p in enumerate(LISTS, 1):
            if may[k - 1] and (p.search(line) if k == 1 else p.match(line)):
                listed = k
                break
        if not listed and url < 2 and repeated < 2 and not (ended and len(tokens) > 12 and longest < 40):
            plain = sum(map(_plain.__getitem__, tokens))
            debris = len(rest) < 15 or not unspaced and (longest >= 40 and longest * 3 > len(rest) or plain < 0.6 * len(tokens))
            listed = 6 if debris and not (ended and plain >= 3) else 0
    code = 0
    for value, (_, size) in zip((url, hashed, sep, ended, repeated, listed, product, 0), FEATURES):
        code = code * size + value
    if unspaced:
        # words of scripts without spaces: triples of characters
        low = [g for t in low for g in ((t[i : i + 3] for i in range(len(t) - 2)) if len(t) > 3 else (t,))]
    return code, words, list(map(_buckets.__getitem__, low))


def _prior() -> list[np.ndarray]:
    """The stated prior: for each feature a table of states by bins."""
    rows = {
        #  prose, link, tag, menu, refrain, apparatus
        "url": ([90, 8, 1.5, 0.5], [5, 10, 35, 50], [85, 10, 3, 2], [80, 12, 6, 2], [95, 3, 1, 1], [60, 15, 20, 5]),
        "hash": ([98, 1.5, 0.5], [94, 4, 2], [4, 8, 88], [95, 4, 1], [98, 1.5, 0.5], [97, 2.5, 0.5]),
        "separators": ([70, 25, 5], [50, 25, 25], [75, 15, 10], [30, 25, 45], [60, 25, 15], [40, 30, 30]),
        "sentence": ([12, 88], [85, 15], [92, 8], [70, 30], [40, 60], [60, 40]),
        "repeated": ([88, 9, 2.7, 0.3], [60, 20, 15, 5], [35, 30, 25, 10], [20, 20, 30, 30], [0.5, 3, 16.5, 80], [90, 7, 2.5, 0.5]),
        "list": ([80, 0.5, 2, 0.5, 0.5, 6, 10.5], [93, 0.5, 1, 0.3, 0.2, 3, 2], [96, 0.2, 0.5, 0.1, 0.2, 1, 2], [93, 0.3, 2, 0.2, 0.5, 2, 2], [96, 0.2, 1, 0.2, 0.2, 0.4, 2], [4, 18, 20, 14, 14, 16, 14]),
        "product": ([96, 4], [94, 6], [94, 6], [55, 45], [98, 2], [97, 3]),
        "learned": ([90, 8.5, 1.3, 0.2], [30, 15, 25, 30], [15, 15, 25, 45], [8, 12, 30, 50], [15, 20, 30, 35], [80, 14, 5, 1]),
    }
    return [np.array(rows[name], float) / 100 for name, _ in FEATURES]


class Tables:
    """Emissions of the states, from the prior and the counts of training."""

    def __init__(self, counts: list[np.ndarray] | None = None, form_only: bool = False):
        """``form_only`` leaves the learned words out."""
        prior = _prior()
        if form_only:
            prior[-1] = np.ones_like(prior[-1])
        self.logs = []
        for k, p in enumerate(prior):
            p = p / p.sum(axis=1, keepdims=True)
            if counts is not None:
                c = counts[k] + PRIOR_LINES * p
                p = c / c.sum(axis=1, keepdims=True)
            self.logs.append(np.log(np.maximum(p, 1e-4)))
        change = (1 - STAY) / (len(STATES) - 1)
        self.moves = np.log(np.full((len(STATES),) * 2, change) + np.eye(len(STATES)) * (STAY - change))
        self.first = np.log(np.array([0.5, 0.1, 0.1, 0.1, 0.1, 0.1]))
        self.table = None

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Emissions by line, from a table of all codes, of which there are few."""
        if self.table is None:
            self.table = self._emissions(np.arange(CODES))
        return self.table[codes]

    def _emissions(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), len(STATES)))
        rest = codes.astype(np.int64)
        for k in range(len(FEATURES) - 1, -1, -1):
            size = FEATURES[k][1]
            out += self.logs[k][:, rest % size].T
            rest = rest // size
        return out

    def paths(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The state of each line of documents that stand one after another; documents run side by side."""
        out = np.zeros(len(codes), np.int8)
        emit_all, starts = self.emissions(codes), np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        for a in range(0, len(order), 1024):
            some = order[a : a + 1024]
            own, width = sizes[some], int(sizes[some].max())
            inside = np.arange(width) < own[:, None]
            at = np.where(inside, starts[some][:, None] + np.arange(width), 0)
            emit = emit_all[at]
            score, came = self.first + emit[:, 0], np.zeros((width, len(some), len(STATES)), np.int8)
            final = score.copy()
            for t in range(1, width):
                step = score[:, :, None] + self.moves
                came[t] = step.argmax(axis=1)
                score = step.max(axis=1) + emit[:, t]
                final = np.where((own > t)[:, None], score, final)
            state, ending, each = np.zeros(len(some), int), final.argmax(axis=1), np.arange(len(some))
            back = np.zeros((len(some), width), np.int8)
            for t in range(width - 1, -1, -1):
                state = np.where(own == t + 1, ending, state)
                back[:, t] = state
                state = came[t, each, state]
            out[at[inside]] = back[inside]
        return out


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # parts bound what one batch of long texts needs
        for at in range(0, b.num_rows, TEXTS):
            known: dict[str, tuple[int, int, list[int]]] = {}
            texts = b.column(1).slice(at, TEXTS).to_pylist()
            found = [[known.get(x) or known.setdefault(x, features(x)) for x in lines(text)] for text in texts]
            yield _observed(b.column(0).slice(at, len(texts)), found)


#: Texts that are worked on at once.
TEXTS = 2000
SEEN = "doc_id long, codes array<int>, words array<int>, sizes array<int>, keys array<int>"


def observations(documents: DataFrame) -> DataFrame:
    """(doc_id, codes, words, sizes, keys): a number and the words of each line, and the counters of all its words; written once."""
    texts = documents.where(F.length(F.trim("text")) > 0).select("doc_id", "text")
    return materialise(texts.mapInArrow(_observe, SEEN))


class _Batch:
    """A batch of observations as flat arrays: the codes, words and numbers of keys of all lines, and all keys."""

    def __init__(self, b: pa.RecordBatch):
        flat = lambda name: b.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.codes, self.n_keys, self.keys = flat("codes"), flat("sizes"), flat("keys")
        self.sizes = b.column("codes").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc_of_line = np.repeat(np.arange(len(self.sizes)), self.sizes)


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each counter in spam lines and in others, by the lines' form alone; two tables of one size."""
    model = Tables(form_only=True)
    uses, docs = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for r in batches:
        b = _Batch(r)
        spam = SPAM[model.paths(b.codes, b.sizes).astype(int)]
        of_key, doc = np.repeat(spam, b.n_keys), np.repeat(b.doc_of_line, b.n_keys)
        for k, (lines_, keys_) in enumerate(((spam, of_key), (~spam, ~of_key))):
            uses[k] += np.bincount(np.unique(doc[keys_] * BUCKETS + b.keys[keys_]) % BUCKETS, minlength=BUCKETS)
            docs[k] += len(np.unique(b.doc_of_line[lines_]))
    at = np.flatnonzero(uses.any(axis=0))
    columns = [np.append(at, -1).astype(np.int32), *(np.append(u[at], d) for u, d in zip(uses, docs))]
    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["bucket", "inside", "outside"])


def learned_words(seen: DataFrame) -> np.ndarray:
    """Which counters are those of spam words: a bit for each of ``BUCKETS``, from all documents."""
    uses = seen.select("codes", "sizes", "keys").mapInArrow(_uses, "bucket int, inside long, outside long").groupBy("bucket").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))
    # at most one row for each counter
    return tied_to_spam(uses.where(f"a >= {LEAST_DOCUMENTS} or bucket = -1").toPandas())


def tied_to_spam(rows: pd.DataFrame) -> np.ndarray:
    """The counters that Dunning's ratio ties to spam lines; ``rows(bucket, a, b)``, bucket -1 has the documents of all."""
    flags = np.zeros(BUCKETS, bool)
    total = rows[rows.bucket == -1]
    rows = rows[rows.bucket > 0]
    if not len(total) or not len(rows):
        return flags
    na, nb = float(total.a.iloc[0]), float(max(1, total.b.iloc[0]))
    a, b = rows.a.to_numpy(float), rows.b.to_numpy(float)
    part = lambda k, n, p: k * np.log(np.maximum(p, 1e-12)) + (n - k) * np.log(np.maximum(1 - p, 1e-12))
    p = (a + b) / (na + nb)
    llr = 2 * (part(a, na, a / na) + part(b, nb, b / nb) - part(a, na, p) - part(b, nb, p))
    flags[rows.bucket[(llr >= LEAST_LLR) & (a / na >= LEAST_RATIO * b / nb)].to_numpy(int)] = True
    return flags


def with_learned(b: _Batch, flags: np.ndarray) -> np.ndarray:
    """The codes of lines with the bin of the learned words; the last feature counts by ones.

    A line of learned words is neither debris nor a book's "name: text", whatever its form.
    """
    hits = np.concatenate([[0], np.cumsum(flags[b.keys])])
    ends = np.cumsum(b.n_keys)
    bins = np.digitize((hits[ends] - hits[ends - b.n_keys]) / np.maximum(b.n_keys, 1), LEARNED)
    # the features after "list" have 2 and 4 bins
    listed = b.codes // 8 % 7
    return b.codes + bins - 8 * np.where((bins >= 2) & (listed >= 5), listed, 0)


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, flags = Tables(), shared.value
        totals = [np.zeros((len(STATES), size)) for _, size in FEATURES]
        for r in batches:
            b = _Batch(r)
            rest = with_learned(b, flags)
            states = model.paths(rest, b.sizes).astype(int)
            for k in range(len(FEATURES) - 1, -1, -1):
                size = FEATURES[k][1]
                totals[k] += np.bincount(states * size + rest % size, minlength=len(STATES) * size).reshape(len(STATES), size)
                rest = rest // size
        rows = [(s, k, v, float(t[s, v])) for k, t in enumerate(totals) for s in range(len(STATES)) for v in range(t.shape[1]) if t[s, v]]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["state", "feature", "bin", "n"]).astype({"state": "int32", "feature": "int32", "bin": "int32", "n": "float64"}), preserve_index=False)

    return run


def train(seen: DataFrame, flags: np.ndarray) -> Tables:
    """One round of Viterbi training over all documents; the sums have at most states times bins rows."""
    shared = seen.sparkSession.sparkContext.broadcast(flags)
    sums = seen.select("codes", "sizes", "keys").mapInArrow(_counts(shared), "state int, feature int, bin int, n double").groupBy("state", "feature", "bin").agg(F.sum("n").alias("n"))
    counts = [np.zeros((len(STATES), size)) for _, size in FEATURES]
    for r in sums.collect():
        counts[r.feature][r.state, r.bin] = r.n
    return Tables(counts)


def judged(seen: DataFrame) -> DataFrame:
    """(doc_id, words, spam_words, states) of observed documents; states are numbers, in the order of ``STATES``."""
    flags = learned_words(seen)
    shared = seen.sparkSession.sparkContext.broadcast((train(seen, flags), flags))

    def run(batches):
        for r in batches:
            model, known = shared.value
            b = _Batch(r)
            path = model.paths(with_learned(b, known), b.sizes)
            words = r.column("words").flatten().to_numpy(zero_copy_only=False)
            sums = [np.bincount(b.doc_of_line, w, len(b.sizes)).astype(np.int64) for w in (words, words * SPAM[path.astype(int)])]
            offsets = pa.array(np.concatenate([[0], np.cumsum(b.sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([r.column("doc_id"), *map(pa.array, sums), pa.ListArray.from_arrays(offsets, pa.array(path.astype(np.int32)))], ["doc_id", "words", "spam_words", "states"])

    return seen.mapInArrow(run, "doc_id long, words long, spam_words long, states array<int>")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observations(table(spark, sf_dir, "documents"))
    return judged(seen).where(F.col("spam_words") > SHARE * F.col("words")).select("doc_id")


def p9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words stand in lines of each kind, by document."""
    seen = observations(table(spark, sf_dir, "documents"))
    return judged(seen).select("doc_id", "words", "spam_words", F.size("states").alias("n_lines"), F.array_join(F.transform("states", lambda k: F.array(*map(F.lit, STATES))[k]), " ").alias("labels"))
