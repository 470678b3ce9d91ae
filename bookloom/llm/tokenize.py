"""Problem 7: encoding of the whole corpus with a public byte-level BPE.

Each Python worker holds the tokenizer's merge table in an in-memory DuckDB.
The distinct new words of a batch, cut where no token of the vocabulary holds the
two bytes, become rows (word, position, token); one recursive query joins neighbouring tokens to the merge table and contracts, in
each word, the pairs of the least rank from the left, until no pair is left.  An
ordered aggregation yields each word's ids.  Words seen before come from a
bounded cache, so a word is worked out once for each worker.

Contracting every non-overlapping pair of a word's least rank at once gives the
same ids as contracting the leftmost one at a time: all of them are the same
pair, and no later merge has a lower rank than one that made its parts.

Defined results
---------------
* null and empty text: an empty list.  Special tokens' strings are ordinary text.
* lone surrogates (which Spark's strings cannot hold) aside, any text has ids.
* one row for each row of the input; columns other than the key and the text
  are not read.

A piece of more than ``LONG_WORD`` bytes runs the same recursion step by step,
keeping only its last state; the ids are the same.  DuckDB never spills: what a
query holds is bounded by ``QUERY_BYTES`` or by one long piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bookloom.llm.common import table

#: Where the public tokenizers' files are; the package that ships them tells.
TOKENIZER = "byte_bpe_50k.json"
#: Words kept by a worker.
CACHE_WORDS = 300_000
#: Texts that are worked on at once.
TEXTS = 1000
#: Bytes of new words that one recursive query takes; a longer word goes alone, step by step.
QUERY_BYTES = 400_000
LONG_WORD = 5_000
IDS = "doc_id long, ids array<int>"

STEP = """
  SELECT w, it + 1 AS it, row_number() OVER (PARTITION BY w ORDER BY pos)::INTEGER AS pos, tok FROM (
    SELECT w, it, pos, CASE WHEN chosen THEN merged ELSE tok END AS tok,
           coalesce(lag(chosen) OVER (PARTITION BY w ORDER BY pos), false) AS gone, changes
    FROM (
      SELECT *, coalesce(lowest AND (row_number() OVER (PARTITION BY w, lowest, pos - nth ORDER BY pos)) % 2 = 1, false) AS chosen
      FROM (
        SELECT *, CASE WHEN lowest THEN sum(CASE WHEN lowest THEN 1 ELSE 0 END) OVER (PARTITION BY w ORDER BY pos) ELSE 0 END AS nth
        FROM (
          SELECT *, rank IS NOT NULL AND rank = min(rank) OVER (PARTITION BY w) AS lowest, min(rank) OVER (PARTITION BY w) IS NOT NULL AS changes
          FROM (SELECT n.*, m.rank, m.merged FROM (
                  SELECT w, it, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM {state}) n
                LEFT JOIN merges m ON m.l = n.tok AND m.r = n.nxt))))
    WHERE changes)
  WHERE NOT gone"""

RECURSIVE = f"""
WITH RECURSIVE state(w, it, pos, tok) AS (
  SELECT w, 0, pos, tok FROM units
  UNION ALL
  {STEP.format(state="state")}
), last AS (SELECT w, max(it) AS it FROM state GROUP BY w)
SELECT w, list(tok ORDER BY pos) AS ids FROM state JOIN last USING (w, it) GROUP BY w"""


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = (chr(0x100 + k) for k in range(256))
    return [chr(b) if b in prints else next(spare) for b in range(256)]


class Encoder:
    """One worker's tokenizer."""

    def __init__(self, path: str):
        import duckdb
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bytes = np.array([vocabulary[c] for c in byte_letters()], np.int32)
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.cache: dict[str, list[int]] = {}
        self.pieces: dict[bytes, list[int]] = {}
        # which bytes stand side by side in some token: no merge ever joins others
        letter = {c: b for b, c in enumerate(byte_letters())}
        self.joins = np.zeros((256, 256), bool)
        for token in vocabulary:
            if all(c in letter for c in token):
                raw = [letter[c] for c in token]
                self.joins[raw[:-1], raw[1:]] = True
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        merges = pa.table({
            "l": pa.array([vocabulary[a] for a, _ in pairs], pa.int32()),
            "r": pa.array([vocabulary[b] for _, b in pairs], pa.int32()),
            "merged": pa.array([vocabulary[a + b] for a, b in pairs], pa.int32()),
            "rank": pa.array(range(len(pairs)), pa.int32()),
        })
        self.db.register("merges_given", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_given")
        self.db.unregister("merges_given")

    def split(self, word: str) -> list[bytes]:
        """A word's pieces between which no merge can take place."""
        raw = word.encode("utf-8")
        data = np.frombuffer(raw, np.uint8)
        cuts = (np.flatnonzero(~self.joins[data[:-1], data[1:]]) + 1).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]

    def _units(self, pieces: list[bytes]) -> pa.Table:
        sizes = np.array([len(r) for r in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        return pa.table({"w": word, "pos": (np.arange(len(data)) - first + 1).astype(np.int32), "tok": self.bytes[data]})

    def learn(self, words: list[str]) -> None:
        """Work out the ids of words that the cache doesn't hold."""
        split = [self.split(w) for w in words]
        group: list[bytes] = []
        size = 0
        for p in dict.fromkeys(p for parts in split for p in parts if p not in self.pieces):
            if len(p) > LONG_WORD:
                self._long(p)
                continue
            if group and size + len(p) > QUERY_BYTES:
                self._query(group)
                group, size = [], 0
            group.append(p)
            size += len(p)
        if group:
            self._query(group)
        for w, parts in zip(words, split):
            self.cache[w] = self.pieces[parts[0]] if len(parts) == 1 else list(chain.from_iterable(self.pieces[p] for p in parts))

    def _query(self, pieces: list[bytes]) -> None:
        self.db.register("units", self._units(pieces))
        for w, ids in self.db.execute(RECURSIVE).fetchall():
            self.pieces[pieces[w]] = ids
        self.db.unregister("units")

    def _long(self, piece: bytes) -> None:
        """The same steps for one long piece, keeping only its last state."""
        self.db.register("units", self._units([piece]))
        self.db.execute("CREATE OR REPLACE TEMP TABLE now AS SELECT w, 0 AS it, pos, tok FROM units")
        while True:
            self.db.execute("CREATE OR REPLACE TEMP TABLE later AS " + STEP.format(state="now"))
            if not self.db.execute("SELECT count(*) FROM later").fetchall()[0][0]:
                break
            self.db.execute("DROP TABLE now; ALTER TABLE later RENAME TO now")
        self.pieces[piece] = self.db.execute("SELECT list(tok ORDER BY pos) FROM now").fetchall()[0][0]
        self.db.unregister("units")

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.words.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        new = list(dict.fromkeys(w for words in split for w in words if w not in self.cache))
        if new:
            self.learn(new)
        get = self.cache.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This process' tokenizer; without a path the one that its own installation ships."""
    if path not in _encoders:
        _encoders[path] = Encoder(path or tokenizer_path())
    return _encoders[path]


def _encode(path: str | None, lengths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for b in batches:
            names = b.schema.names[:-1]
            # parts bound what one batch of long texts needs
            for at in range(0, b.num_rows, TEXTS):
                ids = coder.encode(b.column(len(names)).slice(at, TEXTS).to_pylist())
                kept = [b.column(k).slice(at, len(ids)) for k in range(len(names))]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                if lengths:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes)], [*names, "n_tokens"])
                    continue
                values = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(offsets, values)], [*names, "ids"])

    return run


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of ``documents(doc_id, text)``."""
    return documents.select("doc_id", "text").mapInArrow(_encode(path, False), IDS)


def token_counts(documents: DataFrame, path: str | None = None, keep: str = "") -> DataFrame:
    """(doc_id, n_tokens): the lengths of the same ids, which needn't be sent back; ``keep`` names a string column that goes along."""
    columns = ["doc_id", *([keep] if keep else [])]
    shape = "doc_id long, " + (f"{keep} string, " if keep else "") + "n_tokens long"
    return documents.select(*columns, "text").mapInArrow(_encode(path, True), shape)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
