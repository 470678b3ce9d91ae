"""Problem 2: the subjects of each book.

Two classifier chains for each language.  The first labels paragraphs: each link is
a logistic regression over terms (words and word pairs, or character pairs and
triples in scripts without spaces), the source and the structure of the paragraph,
and the links before it.  The second labels books: its features are what the first
found in the book's paragraphs, its links learn which subjects books have together.
Both are calibrated on rows kept out of the fit, and a beam search decodes the most
likely combination of labels; a book's subjects are the second chain's combination.

Labelled examples are few.  They seed a topic model of a bounded sample of books
(``BOOKS`` and ``PARAGRAPHS`` below), whose paragraphs then fit the first chain
beside the examples; languages are fitted side by side.  Everything after that is
taken from all paragraphs and books: the labels, how often the chain takes one
subject for another (expectation maximisation over the label counts of all books,
started from the sample's), which subjects meet in one book, and how long books are.
From these the second chain's training books are drawn, whose subjects are known.

Defined results
---------------
* null, empty and blank text: no label, and not counted; a book with nothing
  else has no row.  A book without a subject at a fifth gets its most frequent
  one; of more than two, the two most frequent.  Ties go to the earlier code.
* a language without labelled examples: all its paragraphs get the subject that
  stands first in the order of frequency among the examples.
* keys delivered twice count once.  Columns not named here are not read.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookloom.llm.common import lang_code, materialise, once, table

#: The sample of the second fit: books of a language, and paragraphs of a book.
BOOKS, PARAGRAPHS = 80, 40
#: Terms of a language that the fit keeps, by how unevenly subjects use them.
TERMS = 4000
#: Terms of the topics, and the weight of a labelled example in them.
TOPIC_TERMS, SEED_WEIGHT = 1500, 3.0
#: The share of a book's paragraphs from which it has a subject.
SHARE = 0.2
BEAM = 5
#: Books drawn for the second chain of a language, and the shares that a subject has which a book only touches on.
DRAWN, TOUCHED = 4000, 0.16
#: Books drawn with any two subjects, against those drawn as the corpus has them: what a book shows has to count there too.
UNIFORM = 0.5
#: Rounds of expectation maximisation over all books.
EM_ROUNDS = 3
#: Weight of a labelled example against a paragraph of a clear book.
EXAMPLE_WEIGHT = 4.0
ROUNDS = 150

UNSPACED = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
QUOTE, DIGIT = re.compile(r"[“«„「『\"]"), re.compile(r"\d")
RUN = re.compile(r"[^\W\d_]+")
LABELS = "paragraph_id long, book_id long, lang string, mask int"


def terms(text: str) -> set[str]:
    """The terms of a paragraph."""
    low = text.lower()
    if len(UNSPACED.findall(low)) * 3 > len(low):
        out = set()
        for run in RUN.findall(low):
            out.update(run[i : i + k] for k in (2, 3, 4) for i in range(len(run) - k + 1))
        return out
    words = WORD.findall(low)
    out = set(words)
    out.update(map(" ".join, zip(words, words[1:])))
    return out


def structure(text: str, origin: str | None) -> set[str]:
    """Source and structure of a paragraph, as terms that no text can have."""
    n = len(text)
    out = {f"\x01len{0 if n < 60 else 1 if n < 150 else 2 if n < 400 else 3}", f"\x01src{origin or ''}"}
    if QUOTE.search(text):
        out.add("\x01quote")
    if DIGIT.search(text):
        out.add("\x01digit")
    return out


class Chain:
    """A classifier chain over one language's terms."""

    def __init__(self, subjects: list[str]):
        self.subjects = subjects
        self.rows: dict[str, int] = {}

    def fit(self, bags: list[set[str]], labels: np.ndarray, weights: np.ndarray) -> Chain:
        k = len(self.subjects)
        if labels.sum(axis=0).astype(bool).sum() <= 1:
            # one subject only: the chain is a constant
            self.terms_w = np.zeros((1, k))
            self.links = np.zeros((k, k))
            self.bias = np.where(labels.sum(axis=0) > 0, 6.0, -6.0)
            self.scale = 1.0
            return self
        counts: dict[str, np.ndarray] = {}
        for bag, y, w in zip(bags, labels, weights):
            for t in bag:
                if t not in counts:
                    counts[t] = np.zeros(k + 1)
                counts[t][:k] += y * w
                counts[t][k] += 1
        mass = (labels * weights[:, None]).sum(axis=0)
        share = mass / mass.sum()
        least = 2 if len(bags) < 300 else 3

        def uneven(c):
            n = c[:k].sum()
            return float(((c[:k] - n * share) ** 2 / np.maximum(n * share, 1e-9)).sum())

        kept = sorted((t for t, c in counts.items() if c[k] >= least or t[0] == "\x01"), key=lambda t: (t[0] != "\x01", -uneven(counts[t]), t))[:TERMS]
        self.rows = {t: i for i, t in enumerate(kept)}
        held = np.arange(len(bags)) % 5 == 4
        x = self.matrix(bags)
        self._descend(x[~held], labels[~held], weights[~held])
        # calibration: the scale of the scores that suits the rows kept out
        z, y, w = self.scores(x[held]), labels[held], weights[held]
        z = z + y @ np.tril(self.links, -1).T

        def loss(s):
            p = 1 / (1 + np.exp(-np.clip(s * z, -30, 30)))
            return -(w[:, None] * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum()

        self._descend(x, labels, weights, ROUNDS // 3, warm=True)
        self.scale = min((0.25, 0.4, 0.6, 0.8, 1.0, 1.3, 1.7, 2.2, 3.0), key=loss) if held.any() else 1.0
        return self

    def matrix(self, bags: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(bags), max(1, len(self.rows))), np.float32)
        for i, bag in enumerate(bags):
            at = [self.rows[t] for t in bag if t in self.rows]
            if at:
                x[i, at] = 1.0 / np.sqrt(len(at))
        return x

    def _descend(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = ROUNDS, warm: bool = False) -> None:
        """All links at once: each sees the true labels of those before it.  ``warm`` goes on from the last fit."""
        k = len(self.subjects)
        y, w = y.astype(np.float32), (w / w.mean()).astype(np.float32)[:, None]
        terms_w, links, bias = np.zeros((x.shape[1], k), np.float32), np.zeros((k, k), np.float32), np.log(np.clip(y.mean(axis=0), 0.01, 0.99))
        if warm:
            terms_w, links, bias = self.terms_w.copy(), self.links.copy(), self.bias.copy()
        lower = np.tril(np.ones((k, k), np.float32), -1)
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (terms_w, links, bias)]
        for step in range(1, rounds + 1):
            z = x @ terms_w + y @ (links * lower).T + bias
            g = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
            grads = (x.T @ g + 2e-5 * terms_w, (g.T @ y) * lower + 2e-4 * links, g.sum(axis=0))
            for p, gr, m in zip((terms_w, links, bias), grads, moments):
                m[0] = 0.9 * m[0] + 0.1 * gr
                m[1] = 0.99 * m[1] + 0.01 * gr * gr
                p -= 0.15 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        self.terms_w, self.links, self.bias = terms_w, links * lower, bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.terms_w + self.bias

    def bag_scores(self, bags: list[set[str]]) -> np.ndarray:
        get = self.rows.get
        return self._summed([[r for r in map(get, bag) if r is not None] for bag in bags])

    def text_scores(self, texts, origins) -> np.ndarray:
        """The same for texts, without making terms that the chain doesn't know."""
        if not self.rows:
            return self._summed([[] for _ in texts])
        if not hasattr(self, "single"):
            self.single = {t: r for t, r in self.rows.items() if " " not in t}
            self.pairs = {tuple(t.split(" ")): r for t, r in self.rows.items() if " " in t}
        one, two = self.single.get, self.pairs.get
        found = []
        for text, origin in zip(texts, origins):
            low = text.lower()
            if len(UNSPACED.findall(low)) * 3 > len(low):
                at = {r for r in map(one, terms(text)) if r is not None}
            else:
                words = WORD.findall(low)
                at = {*map(one, words), *map(two, zip(words, words[1:]))}
                at.discard(None)
            at.update(r for r in map(one, structure(text, origin)) if r is not None)
            found.append(list(at))
        return self._summed(found)

    def _summed(self, found: list[list[int]]) -> np.ndarray:
        """Scores of rows of term numbers, summed side by side."""
        out = np.tile(np.asarray(self.bias, np.float64), (len(found), 1))
        sizes = np.array([len(f) for f in found], int)
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.concatenate([found[i] for i in full]).astype(int)
            starts = np.cumsum(sizes[full]) - sizes[full]
            out[full] += np.add.reduceat(self.terms_w[flat].astype(np.float64), starts, axis=0) / np.sqrt(sizes[full])[:, None]
        return out

    def decode(self, z: np.ndarray, most: int | None = None) -> np.ndarray:
        """The most likely combination of at least one and at most ``most`` labels of each row, as a bit mask."""
        n, k = z.shape
        masks, logp = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for j in range(k):
            before = (masks[:, :, None] >> np.arange(k)) & 1
            s = self.scale * (z[:, [j]] + before @ self.links[j])
            yes, no = -np.logaddexp(0, -s), -np.logaddexp(0, s)
            logp = np.concatenate([logp + no, logp + yes], axis=1)
            masks = np.concatenate([masks, masks | (1 << j)], axis=1)
            if most is not None:
                logp = np.where(np.bitwise_count(masks) > most, -1e9, logp)
            if logp.shape[1] > BEAM:
                # the empty combination stays in the beam until the last link
                top = np.argsort(-logp, axis=1, kind="stable")[:, :BEAM]
                masks, logp = np.take_along_axis(masks, top, 1), np.take_along_axis(logp, top, 1)
        logp = np.where(masks == 0, -1e9, logp)
        best = np.take_along_axis(masks, logp.argmax(axis=1)[:, None], 1)[:, 0]
        return np.where(best == 0, 1 << z.argmax(axis=1), best)


def _one_hot(names: list[str], subjects: list[str]) -> np.ndarray:
    out = np.zeros((len(names), len(subjects)))
    out[np.arange(len(names)), [subjects.index(s) for s in names]] = 1
    return out


def seeded_topics(counts: np.ndarray, seeds: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Mixtures of subjects in books and terms of subjects, from counts (books x terms) and seeds (subjects x terms).

    Expectation maximisation; the seeds stay as pseudo-counts all along.
    """
    overall = counts.sum(axis=0) + 0.1
    overall = overall / overall.sum()
    phi = seeds * SEED_WEIGHT + 2.0 * len(overall) * overall * 0.05
    phi /= phi.sum(axis=1, keepdims=True)
    theta = np.full((len(counts), len(seeds)), 1 / len(seeds))
    for _ in range(rounds):
        mix = np.maximum(theta @ phi, 1e-12)
        ratio = counts / mix
        new_theta = theta * (ratio @ phi.T) + 0.05
        phi = phi * (theta.T @ ratio) + seeds * SEED_WEIGHT + 0.05 * len(overall) * overall
        phi /= phi.sum(axis=1, keepdims=True)
        theta = new_theta / new_theta.sum(axis=1, keepdims=True)
    return theta, phi


def pseudo_labels(bags: list[set[str]], books: np.ndarray, own: list[set[str]], y: np.ndarray) -> np.ndarray:
    """A subject for each unlabelled paragraph (its index), by topics seeded with the labelled ones."""
    names, at = np.unique(books, return_inverse=True)
    size = np.bincount(at).astype(float)
    df: Counter = Counter(t for bag in bags for t in bag if t[0] != "\x01")
    common = [t for t, n in df.items() if n >= 6]
    rows = {t: i for i, t in enumerate(common)}
    counts = np.zeros((len(names), len(common)))
    for bag, b in zip(bags, at):
        for t in bag:
            if t in rows:
                counts[b, rows[t]] += 1
    expected = size[:, None] * (counts.sum(axis=0) / size.sum())
    spread = ((counts - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=0) / max(1, len(names) - 1)
    kept = np.argsort(-spread, kind="stable")[:TOPIC_TERMS]
    kept = kept[spread[kept] > 1.25]
    terms_at = {common[i]: j for j, i in enumerate(kept)}
    seeds = np.zeros((y.shape[1], len(kept)))
    for bag, label_ in zip(own, y):
        for t in bag:
            if t in terms_at:
                seeds[:, terms_at[t]] += label_
    theta, phi = seeded_topics(counts[:, kept], seeds)
    log_phi, log_theta = np.log(phi + 1e-9), np.log(theta + 1e-3)
    base = log_phi.mean(axis=0)
    out = np.zeros(len(bags), int)
    for i, (bag, b) in enumerate(zip(bags, at)):
        js = [terms_at[t] for t in bag if t in terms_at]
        out[i] = int((log_theta[b] + (0.5 * (log_phi[:, js] - base[js]).sum(axis=1) if js else 0)).argmax())
    return out


def fit_language(own: pd.DataFrame, part: pd.DataFrame, order: list[str]) -> tuple[Chain, np.ndarray]:
    """The chain of paragraphs of one language and its confusion of subjects in the sample, from labelled examples and
    unlabelled ``part(book_id, text, origin)``."""
    k = len(order)
    bags = [terms(t) | structure(t, None) for t in own.text]
    y, w = _one_hot(list(own.subject), order), np.full(len(own), EXAMPLE_WEIGHT)
    if y.any(axis=0).sum() <= 1 or not len(part):
        return Chain(order).fit(bags, y, w), np.eye(k)
    more = [terms(t) | structure(t, o) for t, o in zip(part.text, part.origin)]
    told = pseudo_labels(more, part.book_id.to_numpy(), bags, y)
    found = np.eye(k)[told]
    size = found.sum(axis=0)
    balance = np.sqrt(size[size > 0].mean() / np.maximum(size, 1))[told]
    chain = Chain(order).fit(bags + more, np.concatenate([y, found]), np.concatenate([w, balance]))
    masks = chain.decode(chain.bag_scores(more))
    table_ = np.zeros((k, k)) + 0.5 * np.eye(k)
    for s, m in zip(told, masks):
        got = [j for j in range(k) if m >> j & 1]
        table_[s, got] += 1 / len(got)
    return chain, table_ / table_.sum(axis=1, keepdims=True)


def fit(examples: pd.DataFrame, sample: DataFrame) -> tuple[dict[str, Chain], dict[str, np.ndarray]]:
    """Of each language a chain and its confusion of subjects; a language's sample, of bounded size, is one task."""
    order = [s for s, _ in sorted(Counter(examples.subject).items(), key=lambda x: (-x[1], x[0]))]
    k = len(order)
    shared = sample.sparkSession.sparkContext.broadcast(examples)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        lang = part.lang.iloc[0]
        own = shared.value[shared.value.lang == lang]
        rows = part.sort_values(["book_id", "paragraph_id"]) if part.text.notna().any() else part.iloc[:0]
        return pd.DataFrame({"lang": [lang], "model": [pickle.dumps(fit_language(own, rows[rows.text.notna()], order))]})

    known = list(dict.fromkeys(examples.lang))
    asked = sample.where(F.col("lang").isin(known))
    # a language without a sample is fitted from its examples
    empty = sample.sparkSession.createDataFrame([(x,) for x in known], "lang string").select("lang", *[F.lit(None).cast(t).alias(c) for c, t in sample.drop("lang").dtypes])
    models = asked.unionByName(empty).groupBy("lang").applyInPandas(run, "lang string, model binary").collect() if known else []
    chains, confusion = {}, {}
    for r in models:
        chains[r.lang], confusion[r.lang] = pickle.loads(bytes(r.model))
    chains.setdefault("other", Chain(order).fit([set()], np.eye(k)[:1], np.ones(1)))
    confusion.setdefault("other", np.eye(k))
    return chains, confusion


def sampled(paragraphs: DataFrame) -> DataFrame:
    """At most BOOKS books of a language and PARAGRAPHS paragraphs of each, by hash."""
    books = paragraphs.select("lang", "book_id").distinct()
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("book_id"), "book_id")
    some = books.withColumn("r", F.row_number().over(rank)).where(f"r <= {BOOKS}").drop("r")
    inside = Window.partitionBy("lang", "book_id").orderBy(F.xxhash64("paragraph_id"), "paragraph_id")
    rows = paragraphs.join(F.broadcast(some), ["lang", "book_id"])  # at most BOOKS rows a language
    keys = rows.select("lang", "book_id", "paragraph_id").distinct().withColumn("r", F.row_number().over(inside)).where(f"r <= {PARAGRAPHS}")
    chosen = keys.select("paragraph_id")  # at most BOOKS * PARAGRAPHS rows a language
    return once(rows.join(F.broadcast(chosen), "paragraph_id"), "paragraph_id").select("lang", "book_id", "paragraph_id", "text", "origin")


def label(paragraphs: DataFrame, chains: dict[str, Chain]) -> DataFrame:
    """(paragraph_id, book_id, mask) of ``paragraphs(paragraph_id, book_id, text, lang, origin)``."""
    shared = paragraphs.sparkSession.sparkContext.broadcast(chains)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            masks = np.zeros(len(b), np.int64)
            for lang, rows in b.groupby("lang").indices.items():
                chain = shared.value.get(lang) or shared.value["other"]
                texts, origins = b.text.to_numpy()[rows], b.origin.to_numpy()[rows]
                masks[rows] = chain.decode(chain.text_scores(texts, origins))
            yield pd.DataFrame({"paragraph_id": b.paragraph_id, "book_id": b.book_id, "lang": b.lang, "mask": masks.astype(np.int32)})

    return paragraphs.mapInPandas(run, LABELS)


def unmixed(seen: np.ndarray, c: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Shares of subjects in books from the counts of labels: the mixture that the chain's confusions explain best."""
    own = seen / np.maximum(seen.sum(axis=1, keepdims=True), 1e-9)
    mix = np.maximum(own, 1e-6)
    for _ in range(rounds):
        mix = mix * ((own / np.maximum(mix @ c, 1e-9)) @ c.T)
        mix = mix / np.maximum(mix.sum(axis=1, keepdims=True), 1e-12)
    return mix


def _gathered(k: int, confusion: dict[str, np.ndarray]):
    """Of each language, over all books: how often subject s came out as label t ('c'), and the books that have s and t
    together ('m', with s = t for a book of one subject), and what share t has in books of s alone ('t').  At most
    languages x 3 x k x k rows a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            seen_all = b[[f"s{i}" for i in range(k)]].to_numpy(float)
            for lang, at in b.groupby("lang").indices.items():
                c, seen = confusion.get(lang, confusion["other"]), seen_all[at]
                mix = unmixed(seen, c)
                total = sums.setdefault(lang, np.zeros((3, k, k)))
                total[0] += (mix.T @ (seen / np.maximum(mix @ c, 1e-9))) * c
                top = np.argsort(-mix, axis=1, kind="stable")[:, :2]
                both = mix[np.arange(len(mix)), top[:, -1]] >= SHARE
                np.add.at(total[1], (top[:, 0], np.where(both, top[:, -1], top[:, 0])), 1)
                np.add.at(total[2], top[~both, 0], mix[~both])
        rows = [(lang, kind, i, j, float(t[n, i, j])) for lang, t in sums.items() for n, kind in enumerate("cmt") for i in range(k) for j in range(k) if t[n, i, j]]
        yield pd.DataFrame(rows, columns=["lang", "kind", "i", "j", "n"])

    return run


def over_all_books(books: DataFrame, confusion: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The confusions re-estimated over the label counts of all books, and of each language which subjects meet
    and which ones a book of another only touches on."""
    k = len(confusion["other"])
    meet: dict[str, np.ndarray] = {}
    for _ in range(EM_ROUNDS):
        got = books.mapInPandas(_gathered(k, confusion), "lang string, kind string, i int, j int, n double").groupBy("lang", "kind", "i", "j").agg(F.sum("n").alias("n"))
        tables: dict[str, np.ndarray] = {}
        for r in got.collect():  # at most languages x 3 x k x k rows
            tables.setdefault(r.lang, np.zeros((3, k, k)))["cmt".index(r.kind), r.i, r.j] = r.n
        new = dict(confusion)
        for lang, t in tables.items():
            if lang in confusion:
                # the sample's table counts as much as a hundred labels of each subject
                c = t[0] + 100 * confusion[lang]
                new[lang] = c / c.sum(axis=1, keepdims=True)
            meet[lang] = t[1:]
        confusion = new
    return confusion, meet


class BookChain(Chain):
    """The chain over books: features are the unmixed shares, and how far they can be trusted."""

    def features(self, seen: np.ndarray, c: np.ndarray) -> np.ndarray:
        mix, n = unmixed(seen, c), seen.sum(axis=1, keepdims=True)
        near = np.clip((mix - SHARE / 2) / SHARE, -1, 1)
        return np.hstack([3 * mix, 3 * near, 3 * near * np.minimum(1, n / 20), 1 / np.sqrt(np.maximum(n, 1))]).astype(np.float32)

    def fit_drawn(self, c: np.ndarray, meet: np.ndarray, sizes: np.ndarray, seed: int = 11) -> BookChain:
        """Fit on books drawn from what all books show: which subjects meet, how many paragraphs they have, and how the
        paragraphs' chain confuses subjects."""
        k, rng = len(self.subjects), np.random.default_rng(seed)
        meet, touched = meet
        prior = meet + meet.T - np.diag(np.diag(meet)) + UNIFORM * max(1.0, meet.sum()) / k**2
        pick = rng.choice(k * k, DRAWN, p=(prior / prior.sum()).ravel())
        first, second = pick // k, pick % k
        n = np.maximum(1, rng.choice(sizes, DRAWN))
        share = np.where(first == second, rng.uniform(0, TOUCHED, DRAWN), rng.uniform(SHARE, 0.5, DRAWN))
        stray = touched * (1 - np.eye(k)) + 1e-3
        other = np.where(first == second, [rng.choice(k, p=stray[s] / stray[s].sum()) for s in first], second)
        theta = np.zeros((DRAWN, k))
        theta[np.arange(DRAWN), first] = 1 - share
        theta[np.arange(DRAWN), other] += share
        y = np.zeros((DRAWN, k))
        y[np.arange(DRAWN), first] = 1
        y[np.arange(DRAWN), second] = 1
        seen = np.stack([rng.multinomial(m, p / p.sum()) for m, p in zip(n, theta @ c)]).astype(float)
        x, held = self.features(seen, c), np.arange(DRAWN) % 5 == 4
        self._descend(x[~held], y[~held], np.ones((~held).sum()), 3 * ROUNDS)
        z = self.scores(x[held]) + y[held] @ np.tril(self.links, -1).T
        loss = lambda s: -np.log(1e-9 + np.where(y[held] > 0, 1 / (1 + np.exp(-np.clip(s * z, -30, 30))), 1 / (1 + np.exp(np.clip(s * z, -30, 30))))).sum()
        self.scale = min((0.4, 0.6, 0.8, 1.0, 1.3, 1.7, 2.2, 3.0), key=loss)
        return self


def _decoded(chains: dict[str, BookChain], confusion: dict[str, np.ndarray]):
    """Each book with its subjects' bit mask and the shares of all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = len(confusion["other"])
            seen = b[[f"s{i}" for i in range(k)]].to_numpy(float)
            masks, mix = np.zeros(len(b), np.int64), np.zeros((len(b), k))
            for lang, at in b.groupby("lang").indices.items():
                c = confusion.get(lang, confusion["other"])
                chain = chains.get(lang) or chains["other"]
                mix[at] = unmixed(seen[at], c)
                masks[at] = chain.decode(chain.scores(chain.features(seen[at], c)), most=2)
            yield pd.DataFrame({"book_id": b.book_id, "n_paragraphs": b.n_paragraphs, "mask": masks.astype(np.int32), "shares": list(mix)})

    return run


def book_subjects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """(book_id, n_paragraphs, mask, shares) of every book, and the subjects that the bits and shares stand for.

    Labels are summed up by book, so a book with a third of all paragraphs is one row of counts like any other.
    """
    p = table(spark, sf_dir, "paragraphs").where(F.length(F.trim("text")) > 0)
    p = p.select("paragraph_id", "book_id", "text", lang_code(F.col("lang")).alias("lang"), "origin")
    examples = table(spark, sf_dir, "subject_examples").where("text is not null").select("example_id", lang_code(F.col("lang")).alias("lang"), "subject", "text")
    chains, confusion = fit(examples.orderBy("example_id").toPandas(), sampled(p))  # the examples are a fixed table
    order = chains["other"].subjects
    got = label(p, chains).dropDuplicates(["paragraph_id"])
    weight = 1 / F.bit_count("mask")
    sums = [F.sum(F.when(F.expr(f"shiftright(mask, {i}) & 1 = 1"), weight).otherwise(0.0)).alias(f"s{i}") for i in range(len(order))]
    books = materialise(got.groupBy("book_id").agg(F.max("lang").alias("lang"), F.count("*").alias("n_paragraphs"), *sums))
    confusion, meet = over_all_books(books, confusion)
    quantiles = books.groupBy("lang").agg(F.percentile_approx("n_paragraphs", [x / 20 for x in range(1, 20)]).alias("q"))
    sizes = {r.lang: np.array(r.q, int) for r in quantiles.collect()}  # one row for each of at most twelve languages
    second = {lang: BookChain(order).fit_drawn(confusion.get(lang, confusion["other"]), m, sizes[lang]) for lang, m in meet.items()}
    second.setdefault("other", BookChain(order).fit_drawn(confusion["other"], np.ones((2, len(order), len(order))), np.array([20])))
    return books.mapInPandas(_decoded(second, confusion), "book_id long, n_paragraphs long, mask int, shares array<double>"), order


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, order = book_subjects(spark, sf_dir)
    bits = F.filter(F.array(*[F.when(F.expr(f"shiftright(mask, {i}) & 1 = 1"), F.lit(s)) for i, s in enumerate(order)]), lambda x: x.isNotNull())
    return books.select("book_id", F.explode(bits).alias("subject"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composition of the collection: books and (estimated) paragraphs of each subject."""
    books, order = book_subjects(spark, sf_dir)
    each = books.select("n_paragraphs", "mask", F.posexplode("shares").alias("i", "share"))
    about = F.expr("shiftright(mask, i) & 1")
    names = F.array(*map(F.lit, order))
    return each.groupBy(F.get(names, F.col("i")).alias("subject")).agg(
        F.sum(about.cast("long")).alias("n_books"), F.round(F.sum(F.col("share") * F.col("n_paragraphs")), 3).alias("n_paragraphs")
    )
