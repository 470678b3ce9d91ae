"""Scanned pages come out as continuous paragraphs."""

import re
from collections import Counter
from itertools import product

import pandas as pd

from bookloom.llm import queries, scans


def whole(parts):
    out = []
    for page, line, begins, gap, text in parts:
        if begins:
            out.append((page, line, text))
        else:
            p, i, t = out.pop()
            out.append((p, i, t + gap + text if text else t))
    return out


def test_paragraphs_go_over_lines_and_pages():
    join = lambda i, a, b, good: {"line_no": i, "a": a, "b": b, "mark": "-", "good": good}
    first = ["1. The Tide", "The lan-", "tern went out, a half-", "open door, and the wa-", "7"]
    second = ["THE TIDE", "ter rose to tlie sill.", "Then it fell away as fast"]
    pages = [
        (1, 7, "en", first, [4], 0, [join(1, "lan", "tern", True), join(2, "half", "open", False), join(3, "wa", "ter", True)], None),
        (2, 8, "en", second, [0], None, None, [{"line_no": 1, "a": "tlie", "reading": "the"}]),
        (3, 10, "en", ["as it came"], None, None, None, None),
    ]
    assert whole(scans.page_paragraphs(pages, 25, False)) == [
        (1, 0, "1. The Tide"), (1, 1, "The lantern went out, a half-open door, and the water rose to the sill. Then it fell away as fast"), (3, 0, "as it came"),
    ]
    lines = ["Ein Satz.", "", "Noch einer, der", "weitergeht.", ""]
    assert whole(scans.page_paragraphs([(4, 1, "de", lines, None, None, None, None), (5, 2, "de", ["Neu."], None, None, None, None)], 20, True)) == [(4, 0, "Ein Satz."), (4, 2, "Noch einer, der weitergeht."), (5, 0, "Neu.")]


def test_titles_of_other_books_are_dropped():
    row = {"record_id": 1, "book_id": 1, "lang": "en", "text": "They came\nThe Tide\nhome late.", "page_start": 1, "page_end": 2, "keys": None, "titles": [scans.fold("The Tide")], "joins": None, "words": None}
    assert list(next(scans._repair(iter([pd.DataFrame([row])]))).text) == ["They came home late."]


def test_pages_come_out(spark, odd):
    got = {(r.record_table, r.record_id, r.line_no): r.text for r in queries()["p5_paragraphs"](spark, odd).collect()}
    assert got["source_pages", 2, 1].startswith("Text geht weiter") and "Kopf" not in " ".join(t for (n, *_), t in got.items() if n == "source_pages")
    assert any(n == "paragraphs" for n, *_ in got)


def test_long_books_in_chunks_give_the_same(spark, monkeypatch):
    lines = [[f"Zeile {n} geht ohne", "Ende weiter und wei-" if n % 3 else "Ende. Und noch eine."] if n % 4 else [f"ter {n}. Schluss.", "", "Neu und"] for n in range(200)]
    schema = "page_id long, book_id long, page_number int, lang string, lines array<string>, furniture array<int>, heading int, joins array<struct<line_no: int, a: string, b: string, mark: string, good: boolean>>, words array<struct<line_no: int, a: string, reading: string>>"
    join = [(1, "wei", "ter", "-", True)]
    pages = spark.createDataFrame([(n, 1, n, "de", x, None, None, join if n % 3 and n % 4 == 3 else None, None) for n, x in enumerate(lines)], schema)
    got = {}
    for size in (1000, 7):
        monkeypatch.setattr(scans, "CHUNK", size)
        got[size] = sorted(map(tuple, scans.leaf_paragraphs(pages).collect()))
    assert got[7] == got[1000] and any("weiter 8. Schluss." in r[4] for r in got[7])


def test_caps_are_gone():
    assert "lililililili" in scans.variants("l1l1l1l1l1l1") and scans.variants("1" * 9 + "a") == set()
    assert [t[2:4] for t in scans._hyphens("x" * 80 + "-\nyz", "de")] == [("x" * 80, "yz")]
    text = "The man at the\no7 walked on and on."
    assert scans.paragraph_furniture(text, 7, 7, []) == [(15, 18)]
    title = "the " * 60 + "end"
    assert scans.paragraph_furniture(f"One day\n{title}\nit rained.", 1, 2, [scans.fold(title)]) == [(8, 8 + len(title))]
    assert scans.paragraph_furniture("It was late\n1234 when", 1, 5000, []) == [(12, 17)]


def test_headers_that_differ_by_a_letter_meet(spark):
    rows = [(p, 1, "the house of winds" if p < 5 else "the hause of winds") for p in range(6)] + [(8, 1, "l. the house of winds"), (8, 1, "2. the house of winds"), (7, 1, "2. the house of winds")] + [(9, 1, "another long line"), (9, 2, "the hause of winds")]
    got = scans.same_lines(spark.createDataFrame(rows, "page_id long, book_id long, key string")).collect()
    assert [tuple(r) for r in got] == [(1, "the hause of winds", "the house of winds")]


def test_headers_meet_every_line_that_is_near(spark):
    # the most frequent line of the same beginning is another one; edits stand at both ends; the best partner is the most frequent one
    often = {"winter house and gardens": 5, "winter house and the stranger": 3, "winter house and the strangest": 2}
    once = ["winter house and the strangex", "wintar house and the strangar", "inter house and the strangers", "wintar hause ond the stranger"]
    texts = [k for k, n in often.items() for _ in range(n)] + once
    got = scans.same_lines(spark.createDataFrame([(p, 1, k) for p, k in enumerate(texts)] + [(99, None, once[0])], "page_id long, book_id long, key string"))
    want = [(1, k, "winter house and the stranger") for k in [*once[:3], "winter house and the strangest"]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pieces_of_near_lines_stand_where_they_are_looked_for():
    key = "abcabcaabbccabcacbacbacbabcabccaab"
    near = {key}
    for _ in range(2):
        near |= {x for k in near for i in range(0, len(k), 3) for x in (k[:i] + "x" + k[i + 1 :], k[:i] + "a" + k[i:], k[:i] + k[i + 1 :])}
    pieces = [key[s:e] for s, e in scans._pieces(len(key))]
    assert "".join(pieces) == key and len(pieces) == 4
    assert all(any(k[s:e] == pieces[i] for i, s, e in scans._places(len(k), len(key))) for k in near)


def test_plain_words_are_counted_without_being_parted(monkeypatch):
    class Counted:
        asked = []

        def findall(self, text):
            self.asked.append(text)
            return pattern.findall(text)

    pattern = scans.VOCABULARY_TOKEN
    texts = ["The lantern went out and the lantern fell.", "A well-known man's 'quote' -- it's - so_so, rock’n’roll-ing- क्या कि"]
    want = Counter(w for x in texts for w in pattern.findall(x.lower()))
    monkeypatch.setattr(scans, "VOCABULARY_TOKEN", Counted())
    (got,) = scans._words(iter([pd.DataFrame({"lang": "en", "clean": True, "text": texts})]))
    assert dict(zip(got.word, got.n_clean)) == want
    assert not {"lantern", texts[0].lower()} & set(Counted.asked)


def test_gaps_are_white_space_with_a_break_or_longer_than_a_sign():
    told = re.compile(r"[^\S\n]*[\r\n]+\s*|[^\S\n]{2,}")
    for n in range(6):
        for signs in product("a \t\r\n\x85", repeat=n):
            text = "".join(signs)
            assert [m.span() for m in scans.GAP.finditer(text)] == [m.span() for m in told.finditer(text)], repr(text)


def test_page_numbers_run_at_a_distance(spark):
    words = "apple birch cedar dwarf elder frost grape hazel ivory jewel koala lemon mango north olive".split()
    pages = [(n, 1, n + 10, [f"{w} {w} {w} was there." for w in words[3 * n - 3 : 3 * n]] + [str(n)], "en") for n in range(1, 6)]
    pages += [(50, 1, 90, ["Nothing", "more", "1492"], "en")]
    pages = spark.createDataFrame(pages, "page_id long, book_id long, page_number int, lines array<string>, lang string")
    chapters = spark.createDataFrame([], "chapter_id long, book_id long, chapter_title string, page_start int")
    lines, *_ = scans.furniture(pages, chapters)
    assert sorted(map(tuple, lines.collect())) == [(n, 3) for n in range(1, 6)]
