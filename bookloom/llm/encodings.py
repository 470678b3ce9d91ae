"""Problem 4: text that was decoded with the wrong encoding.

A hidden Markov model labels the characters of a text.  It has one clean state,
one state per (written in, read as) pair of encodings and one for characters
that are lost.  The clean state emits as the language does: character counts
over all records.  A garbled state emits what those counts become when text of
that distribution is written in one encoding and read in the other: character by
character where the reader takes single bytes, and by counting the whole corpus
read that way where it takes several at once.  Every language has every state
that can write any of its letters; a state is entered the more easily the more
of the language it can write.  A span labelled with a state gets the state's
inverse transform, applied to as much of it as still has one; encodings that
agree on most bytes are hard to tell apart in a short span, so states that
explain the span nearly as well (``NEAR``) follow, likeliest first.

Viterbi is exact: texts whose best path cannot leave the clean state are settled
by bounds and by the best segment of each state, which take no dynamic programme.

Defined results
---------------
* null, empty and blank text: no case, restored as it is.
* a text with U+FFFD is a case, restorable or not; lost characters stay U+FFFD.
* an unknown or null language uses the counts of all such records together.
* keys delivered twice count once.  Columns other than key, text and language
  are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.alphabets import LATIN_LETTERS, own
from bookloom.llm.common import lang_code, once, once_of, table

# Fixed values: (written in, read as).
UTF8_READ_AS = ("cp1252", "latin_1", "cp1250", "cp1251", "cp1254", "cp1258", "mac_roman", "cp437", "cp850", "koi8_r", "gb18030", "gbk", "cp932")
LEGACY = (
    ("cp1251", "cp1252"),
    ("koi8_r", "cp1252"),
    ("koi8_r", "cp1251"),
    ("cp1251", "koi8_r"),
    ("cp866", "cp1251"),
    ("cp866", "cp1252"),
    ("cp874", "cp1252"),
    ("cp1256", "cp1252"),
    ("gbk", "cp1252"),
    ("big5", "cp1252"),
    ("euc_jp", "cp1252"),
    ("cp932", "cp1252"),
    ("cp1258", "cp1252"),
    ("cp1252", "cp850"),
    ("cp1252", "cp437"),
    ("cp1252", "mac_roman"),
    ("cp850", "cp1252"),
    ("mac_roman", "cp1252"),
    ("tcvn3", "cp1252"),
    ("vni", "cp1252"),
)
#: Readers that take several bytes for a character: what they make of a text depends on the letters side by side.
WIDE_READERS = ("gb18030", "gbk", "cp932")
PAIRS = [("utf_8", r) for r in UTF8_READ_AS] + [("utf_8+cp1252+utf_8", "cp1252"), ("utf_8+cp1251+utf_8", "cp1251")] + list(LEGACY)

# TCVN 5712 VN3, whose capitals are a matter of the font, from byte A1 on ("." is unused).
TCVN3 = "ĂÂÊÔƠƯĐăâêôơưđ......àảãáạ.ằẳẵắ.......ặầẩẫấậè.ẻẽéẹềểễếệìỉ...ĩíịò.ỏõóọồổỗốộờởỡớợù.ủũúụừửữứựỳỷỹýỵ"
# VNI writes a vowel and then a sign; these are the signs of (mark, tone).
VNI_SIGNS = {
    "": "øùûõï",
    "\u0302": "àáåãä",
    "\u0306": "èéúüë",
}
VNI_PLAIN = {"\u0302": "â", "\u0306": "ê"}
VNI_LETTERS = {"đ": "ñ", "ơ": "ô", "ư": "ö", "ỉ": "æ", "ĩ": "ó", "ị": "ò", "ì": "ì", "í": "í", "ỵ": "î"}
TONES = "\u0300\u0301\u0309\u0303\u0323"

#: Entering a garbled state, staying in it, and leaving it, as probabilities.
ENTER, STAY = 0.02, 0.8
#: Emission of a character that a state has never been seen to emit.
UNSEEN = 1e-8
#: A character foreign to the language is taken to be at most this likely in clean text.
FOREIGN = 1e-5
#: A state that explains a span less well than the labelled one by at most this log-likelihood is tried after it.
NEAR = 7.0
#: Characters that are worked on at once.
PART = 100_000
LOST = "�"


def _read(data: bytes, encoding: str) -> str:
    """Decode; bytes that a single-byte code page leaves undefined become C1 controls."""
    if encoding in WIDE_READERS:
        return data.decode(encoding, "replace")
    return _single(encoding).translate_bytes(data)


def _best_segment(gains: np.ndarray, starts: np.ndarray, stay: float, leave: float, last: np.ndarray | None = None) -> np.ndarray:
    """The largest sum of consecutive rows within each text, for each column.

    Staying costs, and so does leaving unless the segment ends with the text;
    ``last`` tells which of the given parts end their text (all, if not given).
    """
    step = np.asarray(gains, np.float64) + stay
    sums = np.cumsum(step, axis=0)
    before = sums - step
    # running minima start anew with each text: later texts are lifted far above earlier ones' reach
    lift = np.zeros(len(step))
    lift[starts] = 1
    lift = (np.cumsum(lift) - 1) * -1e6
    before += lift[:, None]
    low = np.minimum.accumulate(before, axis=0)
    best = sums + lift[:, None] - low + leave
    at_end = np.append(starts[1:], len(step)) - 1
    best[at_end if last is None else at_end[last]] -= leave
    return np.maximum.reduceat(best, starts, axis=0)


class _Single:
    def __init__(self, encoding: str):
        self.chars = []
        for b in range(256):
            try:
                self.chars.append(bytes([b]).decode(encoding))
            except UnicodeDecodeError:
                self.chars.append(chr(b))
        self.back = {c: bytes([b]) for b, c in reversed(list(enumerate(self.chars)))}
        self.table = "".join(self.chars)

    def translate_bytes(self, data: bytes) -> str:
        return data.decode("latin_1").translate(dict(enumerate(self.chars)))

    def to_bytes(self, text: str) -> bytes:
        # C1 controls stand for themselves: readers differ in the bytes they leave undefined
        return b"".join(self.back.get(c) or (bytes([ord(c)]) if ord(c) < 256 else b"?") for c in text)


_singles: dict[str, _Single] = {}


def _single(encoding: str) -> _Single:
    if encoding not in _singles:
        _singles[encoding] = _Single(encoding)
    return _singles[encoding]


def _parts(c: str) -> tuple[str, str, str]:
    """Base letter, mark (circumflex, breve or horn) and tone of a Vietnamese letter."""
    d = unicodedata.normalize("NFD", c)
    return d[0], "".join(x for x in d[1:] if x not in TONES), "".join(x for x in d[1:] if x in TONES)


def _tables() -> dict[str, dict[str, str]]:
    """For the Vietnamese schemes without a codec: letter -> what it looks like in cp1252."""
    letters = {unicodedata.normalize("NFC", a + m + t) for a in "aeiouyAEIOUY" for m in ("", "\u0302", "\u0306", "\u031b") for t in ("", *TONES)}
    letters = {c for c in letters if len(c) == 1 and ord(c) >= 128} | {"đ", "Đ"}
    see = _single("cp1252").chars
    tcvn = {c: see[0xA1 + i] for i, c in enumerate(TCVN3) if c != "."}
    tcvn |= {c.upper(): v for c, v in tcvn.items() if c.upper() not in tcvn}
    vni = {}
    for c in letters:
        base, mark, tone = _parts(c)
        low = c.lower()
        k = TONES.index(tone) if tone else -1
        if low in VNI_LETTERS:
            out = VNI_LETTERS[low]
        elif "\u031b" in mark:
            out = VNI_LETTERS[unicodedata.normalize("NFC", base.lower() + mark)] + (VNI_SIGNS[""][k] if tone else "")
        else:
            out = base.lower() + (VNI_SIGNS[mark][k] if tone else VNI_PLAIN[mark])
        vni[c] = out.upper() if c != low else out
    toned = {c: unicodedata.normalize("NFC", b + m) + t for c in letters for b, m, t in [_parts(c)] if t}
    return {"tcvn3": tcvn, "vni": vni, "toned": toned}


_SCHEMES: dict[str, dict[str, str]] = {}


def schemes() -> dict[str, dict[str, str]]:
    if not _SCHEMES:
        _SCHEMES.update(_tables())
    return _SCHEMES


def _unscheme(text: str, name: str) -> str:
    back: dict[str, str] = {}
    for c, v in sorted(schemes()[name].items(), key=lambda x: (x[0] != x[0].lower(), x[0])):
        back.setdefault(v, c)
    out, i = [], 0
    while i < len(text):
        for size in (3, 2, 1):
            if text[i : i + size] in back:
                out.append(back[text[i : i + size]])
                i += size
                break
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def garble(text: str, written: str, read: str) -> str:
    if written in ("tcvn3", "vni"):
        return text.translate(str.maketrans(schemes()[written]))
    if written == "cp1258":
        text = text.translate(str.maketrans(schemes()["toned"]))
    if "+" in written:
        steps = written.split("+")
        text = _read(text.encode(steps[0], "ignore"), steps[1])
        written = steps[2]
    return _read(text.encode(written, "ignore"), read)


def restore(text: str, written: str, read: str) -> str:
    """The inverse of ``garble`` as far as there is one; what is lost gives U+FFFD."""
    if written in ("tcvn3", "vni"):
        return _unscheme(text, written)
    if read in WIDE_READERS:
        data = text.replace(LOST, "").encode(read, "ignore")
    else:
        data = _single(read).to_bytes(text)
    if "+" in written:
        first, middle, last = written.split("+")
        return _single(middle).to_bytes(data.decode(last, "replace")).decode(first, "replace")
    text = data.decode(written, "replace")
    return unicodedata.normalize("NFC", text) if written == "cp1258" else text


def _writable(text: str, written: str) -> str:
    """The characters of a text that an encoding can write."""
    if written in ("tcvn3", "vni"):
        return "".join(c for c in text if c in schemes()[written])
    if written == "cp1258":
        return "".join(c for c in text if c in schemes()["toned"] or c.encode(written, "ignore"))
    return "".join(c for c in text if c.encode(written.split("+")[0], "ignore"))


class Model:
    """Log emissions of one language's states for the characters that occur in it."""

    def __init__(self, counts: dict[str, int], lang: str, wide: dict[str, dict[str, int]] | None = None):
        """``counts`` of characters and, for each wide reader, of the characters that it makes of the same texts in UTF-8."""
        alphabet = self.own = own(lang)
        self.latin = lang in LATIN_LETTERS
        total = sum(counts.values()) or 1
        self.letters = alphabet | {c for c, n in counts.items() if n > 1e-4 * total and unicodedata.category(c)[0] == "L"}
        # how letters are spread, capitals and small ones together: what the check compares
        folded: dict[str, float] = {}
        for c, n in counts.items():
            if c.isalpha():
                folded[c.lower()] = folded.get(c.lower(), 0) + n
        self.folded = {c: float(np.log(n / (sum(folded.values()) or 1))) for c, n in folded.items() if c in self.letters or ord(c) < 128}
        ordinary = lambda c: ord(c) < 128 or c in alphabet
        clean = {c: n for c, n in counts.items() if ordinary(c) or unicodedata.category(c)[0] in "LMS"}
        weights = {c: n if ordinary(c) else min(n, FOREIGN * total * 20) for c, n in clean.items() if c != LOST}
        high = {c: n for c, n in weights.items() if ord(c) >= 128}
        mass = sum(high.values())
        ascii_total = sum(n for c, n in weights.items() if ord(c) < 128) or 1
        self.states = [("", "")]
        tables, same, shares = [], [], []
        for written, read in PAIRS if high else []:
            seen = {c: garble(c, written, read) for c in high if _writable(c, written)}
            share = sum(high[c] for c in seen) / mass
            if not seen or all(c == g for c, g in seen.items()):
                continue
            found: dict[str, float] = {}
            for c, g in seen.items():
                for x in g:
                    found[x] = found.get(x, 0.0) + high[c]
            if read in WIDE_READERS and wide and wide.get(read):
                found = {c: float(n) for c, n in wide[read].items() if ord(c) >= 128}
            # half ASCII, half not: a garbled state is entered for what isn't ASCII
            size = sum(found.values()) or 1
            probability = {c: 0.5 * n / size for c, n in found.items()}
            for c, n in weights.items():
                if ord(c) < 128:
                    probability[c] = probability.get(c, 0) + 0.5 * n / ascii_total
            self.states.append((written, read))
            tables.append(probability)
            shares.append(share)
            # what an encoding pair leaves as it is tells nothing for it
            same.append({c for c, g in seen.items() if g == c})
        self.states.append(("lost", "lost"))
        tables.append({LOST: 0.9})
        same.append(set())
        shares.append(1.0)
        points = sorted({*map(ord, counts), *(ord(c) for t in tables for c in t)})
        self.points = np.array(points, np.uint32)
        ratio = np.zeros((len(points) + 1, len(self.states)), np.float32)
        for i, p in enumerate(points):
            c = chr(p)
            base = max(counts.get(c, 0), 0.5) / total
            spacing = unicodedata.category(c) in ("Zs", "Cf")
            if c == LOST:
                base = 1e-9
            elif not ordinary(c):
                base = min(base, FOREIGN)
            for k, t in enumerate(tables, 1):
                gain = np.log(max(t.get(c, 0.0), UNSEEN) / base)
                # ASCII reads alike in every pair, or is a second byte; spaces and what isn't seen are weak evidence
                most = 0.0 if ord(c) < 128 or c in same[k - 1] else 4.0 if spacing else 50.0
                ratio[i, k] = 0.0 if ord(c) < 128 and self.states[k][0] in ("cp932", "gbk", "big5", "euc_jp") else min(gain, most)
        ratio[-1, 1:] = -12
        self.ratio = ratio
        self.best = ratio.max(axis=1)
        self.gains = np.maximum(ratio[:, 1:], 0)
        self.enter = np.log(ENTER * np.array(shares) / sum(shares))
        self.stay, self.leave = np.log(STAY), np.log(1 - STAY)
        self.least = -(self.enter - self.stay)

    def stands(self, piece: str, better: str, written: str) -> bool:
        """True if a span's inverse transform gives what the language could have written.

        What UTF-8 yields is hardly ever valid by chance.  For a single-byte
        scheme something in the span must be foreign to the language (a look-alike
        or an unusual space is not), or the letters must fit far better.
        """
        high = [c for c in better if ord(c) >= 128]
        if not high:
            return False
        fit = 2 * sum(c in self.letters for c in high) >= len(high)
        if written.startswith("utf_8"):
            return fit or LOST not in better and all(unicodedata.category(c)[0] in "LMPS" for c in high)
        gain = self.plain(better) - self.plain(piece)
        if not fit or high.count(LOST) - piece.count(LOST) > 0.2 * len(high):
            return False
        if any(ord(c) >= 128 and not self.weak(c) for c in piece):
            return gain > 0
        # a code page has letters for letters; the Vietnamese ones join signs
        if written not in ("tcvn3", "vni", "cp1258") and sum(map(str.isalpha, better)) < sum(map(str.isalpha, piece)):
            return False
        return gain > 6 and sum(map(str.isalpha, piece)) >= 4

    def weak(self, c: str) -> bool:
        if c in self.own or unicodedata.category(c)[0] in "ZM" or unicodedata.category(c) == "Cf" or c in "ÐƉ":
            return True
        return self.latin and 0x0370 <= ord(c) < 0x0530

    def plain(self, text: str) -> float:
        """How likely the letters of a text are in the language, whatever their case."""
        return sum(self.folded.get(c, -14.0) for c in text.lower() if c.isalpha() or ord(c) >= 160 and c not in self.own and unicodedata.category(c)[0] not in "ZMC")

    def index(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.points, codes)
        at[at == len(self.points)] = len(self.points) - 1 if len(self.points) else 0
        return np.where(self.points[at] == codes, at, len(self.points)) if len(self.points) else np.zeros(len(codes), int)

    def candidates(self, index: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, start, end): the texts whose best path leaves the clean state, and where it can.

        States meet only through the clean one, so a path leaves it if and only
        if some segment of one state gains more than entering costs.  Two bounds
        go first: the best segment under the largest ratio of any state, and the
        sum of what a text's characters gain in each state.
        """
        ends = np.append(starts[1:], len(index))
        hot = self.best[index] > 0
        maybe = np.flatnonzero(_best_segment(self.best[index][:, None], starts, self.stay, self.leave)[:, 0] > self.least.min())
        # before the first and after the last character that any state favours, a path is clean
        spans = []
        for i in maybe:
            at = np.flatnonzero(hot[starts[i] : ends[i]])
            spans.append((int(starts[i] + at[0]), int(starts[i] + at[-1] + 1)))
        yes = np.zeros(len(maybe), bool)
        at = 0
        while at < len(maybe):
            size, stop = 0, at
            while stop < len(maybe) and (size == 0 or size + spans[stop][1] - spans[stop][0] <= PART):
                size += spans[stop][1] - spans[stop][0]
                stop += 1
            given = [index[a:b][hot[a:b]] for a, b in spans[at:stop]]
            first = np.cumsum([0] + [len(g) for g in given[:-1]])
            bound = np.add.reduceat(self.gains[np.concatenate(given)], first, axis=0) > self.least
            for k in np.flatnonzero(bound.any(axis=0)):
                some = np.flatnonzero(bound[:, k] & ~yes[at:stop]) + at
                if not len(some):
                    continue
                rows = np.concatenate([index[spans[i][0] : spans[i][1]] for i in some])
                begin = np.cumsum([0] + [spans[i][1] - spans[i][0] for i in some[:-1]])
                last = np.array([spans[i][1] == ends[maybe[i]] for i in some])
                best = _best_segment(self.ratio[rows, k + 1][:, None], begin, self.stay, self.leave, last)[:, 0]
                yes[some[best > self.least[k]]] = True
            at = stop
        return [(int(maybe[i]), *spans[i]) for i in np.flatnonzero(yes)]

    def likely(self, piece: str, label_: int) -> list[tuple[str, str]]:
        """The labelled state and those that explain a span nearly as well, likeliest first."""
        gain = self.ratio[self.index(codes(piece)), 1:].sum(axis=0) + self.enter
        order = sorted(range(len(gain)), key=lambda k: (k != label_ - 1, -gain[k], k))
        return [self.states[k + 1] for k in order if gain[k] >= gain[label_ - 1] - NEAR]

    def paths(self, rows: list[np.ndarray], last: list[bool] | None = None) -> list[np.ndarray]:
        """The state of each character of each row of indices; rows are run side by side.

        A row that doesn't end its text (``last``) has to return to the clean state.
        """
        out: list = [None] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        for a in range(0, len(order), 256):
            some = order[a : a + 256]
            width = max(len(rows[i]) for i in some)
            idx = np.full((len(some), width), len(self.points), int)
            for r, i in enumerate(some):
                idx[r, : len(rows[i])] = rows[i]
            sizes = np.array([len(rows[i]) for i in some])
            k = len(self.states)
            score = np.full((len(some), k), -1e9)
            score[:, 0] = 0
            came = np.zeros((width, len(some), k), np.int8)
            final = np.zeros((len(some), k))
            for t in range(width):
                leave = score[:, 1:] + self.leave
                j = leave.argmax(axis=1)
                top = leave[np.arange(len(some)), j]
                enter, keep = score[:, :1] + self.enter, score[:, 1:] + self.stay
                new = np.empty_like(score)
                new[:, 0] = np.maximum(score[:, 0], top)
                came[t, :, 0] = np.where(top > score[:, 0], j + 1, 0)
                into = enter > keep
                came[t, :, 1:] = np.where(into, 0, np.arange(1, k))
                new[:, 1:] = np.where(into, enter, keep)
                score = new + self.ratio[idx[:, t]]
                done = sizes == t + 1
                if done.any():
                    final[done] = score[done]
            if last is not None:
                final[[r for r, i in enumerate(some) if not last[i]], 1:] += self.leave
            back = np.zeros((width, len(some)), np.int8)
            ending, at, each = final.argmax(axis=1), np.zeros(len(some), int), np.arange(len(some))
            for t in range(width - 1, -1, -1):
                at = np.where(sizes == t + 1, ending, at)
                back[t] = at
                at = came[t, each, at]
            for r, i in enumerate(some):
                out[i] = back[: len(rows[i]), r].astype(int)
        return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def label(texts: list[str], model: Model) -> list[np.ndarray | None]:
    """The labelled states of each text; None where all of it is clean."""
    out: list = [None] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    at = 0
    while at < len(full):
        size, stop = 0, at
        while stop < len(full) and (size == 0 or size + len(texts[full[stop]]) <= 10 * PART):
            size += len(texts[full[stop]])
            stop += 1
        some = full[at:stop]
        parts = [codes(texts[i]) for i in some]
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        index = model.index(np.concatenate(parts))
        chosen = model.candidates(index, starts)
        stops = [starts[n] + len(parts[n]) for n, _, _ in chosen]
        for (n, a, b), path in zip(chosen, model.paths([index[a:b] for _, a, b in chosen], [b == e for (_, _, b), e in zip(chosen, stops)])):
            if path.any():
                full_path = np.zeros(len(parts[n]), int)
                full_path[a - starts[n] : b - starts[n]] = path
                out[some[n]] = full_path
        at = stop
    return out


def repaired(text: str, path: np.ndarray, model: Model) -> str | None:
    """The text with each labelled span's inverse transform; None if no span stands the check."""
    out, i, n, stands = [], 0, len(text), False
    while i < n:
        k = int(path[i])
        j = i
        while j < n and path[j] == k:
            j += 1
        piece = text[i:j]
        stands |= bool(k) and LOST in piece
        if k:
            for state in model.likely(piece, k):
                better = piece if state[0] == "lost" else restore(piece, *state)
                if better != piece and model.stands(piece, better, state[0]):
                    piece, stands = better, True
                    break
        out.append(piece)
        i = j
    return "".join(out) if stands else None


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Characters by language, as they are (reader '') and as the wide readers would have the same texts in UTF-8."""
    counts: dict[tuple[str, str], np.ndarray] = {}
    for b in batches:
        for lang, part in b.groupby("lang"):
            text = "\n".join(part.text)
            data = text.encode("utf-8", "replace")
            for reader in ("", *WIDE_READERS):
                if reader and text.isascii():
                    continue
                c = np.bincount(codes(data.decode(reader, "replace") if reader else text), minlength=1)
                old = counts.get((lang, reader))
                if old is not None and len(old) > len(c):
                    c, old = old, c
                if old is not None:
                    c[: len(old)] += old
                counts[lang, reader] = c
    rows = [(lang, reader, int(p), int(c[p])) for (lang, reader), c in counts.items() for p in np.flatnonzero(c)]
    yield pd.DataFrame(rows, columns=["lang", "reader", "point", "n"])


def _texts(df: DataFrame) -> DataFrame:
    return df.where(F.length("text") > 0).withColumn("lang", lang_code(F.col("lang")))


def models(records: DataFrame) -> dict[str, Model]:
    """A model per language from the characters of all records, each of which counts once.

    The collected counts have at most one row per language, reader and code point, so
    their size doesn't grow with the records.
    """
    rows = _texts(records).mapInPandas(_count, "lang string, reader string, point int, n long")
    counts: dict[str, dict[str, dict[str, int]]] = {}
    for r in rows.groupBy("lang", "reader", "point").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r.lang, {}).setdefault(r.reader, {})[chr(r.point)] = r.n
    return {lang: Model(c.get("", {}), lang, c) for lang, c in counts.items()}


def garbled(records: DataFrame, counted: DataFrame, repair: bool = False) -> DataFrame:
    """Records ``(record_id, text, lang)`` with a garbled span; with ``repair`` their restored text.

    ``counted`` are the same records, each once: they give the characters' counts.
    """
    shared = records.sparkSession.sparkContext.broadcast(models(counted))

    def find(batches):
        for b in batches:
            keys, texts = [], []
            for lang, part in b.groupby("lang"):
                model = shared.value.get(lang)
                if model is None:
                    continue
                given = list(part.text)
                for key, text, path in zip(part.record_id, given, label(given, model)):
                    better = None if path is None else repaired(text, path, model)
                    if better is not None:
                        keys.append(key)
                        texts.append(better if repair else None)
            yield pd.DataFrame({"record_id": keys, "restored": texts}).astype({"record_id": "int64", "restored": "object"})

    return _texts(records).mapInPandas(find, "record_id long, restored string")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "paragraphs").select(F.col("paragraph_id").alias("record_id"), "text", "lang")


def paragraphs_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = once_of(spark, sf_dir, "paragraphs", ["paragraph_id"], ["text", "lang"])
    return p.select(F.col("paragraph_id").alias("record_id"), "text", "lang")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(paragraphs(spark, sf_dir), paragraphs_once(spark, sf_dir)).select(F.col("record_id").alias("paragraph_id")).distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph with its text, restored where it was garbled; keys once."""
    rows = paragraphs_once(spark, sf_dir)
    fixed = once(garbled(paragraphs(spark, sf_dir), rows, repair=True), "record_id")
    return rows.join(fixed, "record_id", "left").select(
        F.col("record_id").alias("paragraph_id"), F.coalesce("restored", "text").alias("text"), F.col("restored").isNotNull().alias("was_garbled")
    )
