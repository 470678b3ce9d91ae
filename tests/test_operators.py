"""Operators against brute force on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from bookloom.functions import arrays as A
from bookloom.operators import chapters as C
from bookloom.operators import segments as S
from bookloom.operators.tables import once, running


@pytest.mark.parametrize("hot", [True, False])
def test_running_values_over_a_hot_key(spark, hot):
    rng = random.Random(1)
    rows = [(7 if i % 3 else rng.randrange(20), i, rng.choice([None, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, o int, v double")
    got = {(r.k, r.o): r for r in running(df, ["k"], ["o"], hot=hot, s=("v", "sum"), m=("v", "max"), n=("v", "count"), l=("v", "last"), g=("v", "lag"), b=("v", "before")).collect()}
    assert len(got) == len(rows)
    state: dict = {}
    for k, o, v in sorted(rows):
        s, m, n, last, lag = state.get(k, (None, None, 0, None, None))
        assert (got[k, o].g, got[k, o].b) == (lag, last)
        if v is not None:
            s, m, n, last = (s or 0) + v, v if m is None else max(m, v), n + 1, v
        state[k] = (s, m, n, last, v)
        r = got[k, o]
        assert (r.m, r.n, r.l) == (m, n, last) and (r.s is None) == (s is None) and (s is None or abs(r.s - s) < 1e-9)


def test_chapter_markers_cover_the_time_line(spark):
    rows = [(1, c, s, d) for c in range(1, 4) for s, d in enumerate([1.0, None, -2.0, 0.5])]
    df = spark.createDataFrame(rows, "book_id int, chapter_index int, segment_no int, seconds double")
    got = S.chapter_markers(df).orderBy("chapter_index").collect()
    assert [(r.start_s, r.end_s) for r in got] == [(0.0, 1.5), (1.5, 3.0), (3.0, 4.5)]


def test_quality_of_empty_tables(spark):
    segments = spark.createDataFrame([], "segment_id long, book_id long, chapter_index int")
    timings = spark.createDataFrame([], "segment_id long, audio_duration_seconds double")
    assert S.quality(segments, timings).count() == 0 and S.missing_segments(segments, timings).count() == 0


def detected(spark, pages, numbers_alone=False):
    df = spark.createDataFrame([(i, b, n, x) for i, (b, n, x) in enumerate(pages)], "page_id long, book_id long, page_number int, lines array<string>")
    return [(r.book_id, r.chapter_no, r.title, list(r.paragraphs)) for r in C.detect_chapters(df, numbers_alone).orderBy("book_id", "chapter_no").collect()]


def test_chapters(spark):
    pages = [
        (1, 1, ["MỤC LỤC", "Một ..... 3", "Hai ..... 9"]),
        (1, 2, ["PHẦN THỨ NHẤT", "CHƯƠNG I", "MÙA ĐÔNG", "THỨ HAI", "Câu một.", "câu", "hai."]),
        (1, 3, ["Chương 2: Lá thư", "Thân bài.", "PHỤ LỤC", "bỏ qua."]),
        (2, 1, ["only body"]),
        (3, 1, None),
        (4, 1, []),
        (5, 1, ["Chapter 1"]),
        (5, 2, ["TITLE", "Body goes"]),
        (5, 3, ["title", "on. New one."]),
        (5, 4, ["Chapter 2: Tide", "It rose"]),
        (5, 5, ["CHAPTER 2: TIDE", "and fell."]),
        (5, None, ["lost"]),
    ]
    part = "PHẦN THỨ NHẤT - "
    assert detected(spark, pages) == [
        (1, 0, part + "MÙA ĐÔNG THỨ HAI", ["Câu một.", "câu hai."]),
        (1, 1, part + "Chương 2: Lá thư", ["Thân bài."]),
        (2, 0, C.FALLBACK_TITLE, ["only body"]),
        (5, 0, "TITLE", ["Body goes on. New one."]),
        (5, 1, "Chapter 2: Tide", ["It rose and fell."]),
    ]


def test_chapters_of_paged_and_plain_books(spark):
    leaders = [f"Chương {n} {'.' * 30} {k}0" for n, k in zip(("I", "II", "III", "IV"), range(1, 5))]
    paged = [(1, 1, ["MỤC LỤC", *leaders]), (1, 2, ["CHƯƠNG NHẤT", "MUỐN LẤY MẬT ĐỪNG PHÁ TỔ ONG", "Đây là nội dung chương đầu tiên."])]
    assert detected(spark, paged) == [(1, 0, "MUỐN LẤY MẬT ĐỪNG PHÁ TỔ ONG", ["Đây là nội dung chương đầu tiên."])]
    text = "\nLỜI NHÀ XUẤT BẢN\nPhần phụ này không đưa vào TTS.\n\nChương 1: Mở đầu\nĐây là chương một.\n\n01\nCHƯƠNG HAI\nĐây là chương hai.\n"
    plain = C.text_pages(spark.createDataFrame([(1, text), (2, "Một đoạn văn không có tiêu đề chương.\nMột đoạn khác."), (3, None)], "book_id long, text string"))
    got = C.detect_chapters(plain, numbers_alone=True).orderBy("book_id", "chapter_no").collect()
    assert [(r.book_id, r.title, list(r.paragraphs)) for r in got] == [
        (1, "Chương 1: Mở đầu", ["Đây là chương một."]),
        (1, "CHƯƠNG HAI", ["Đây là chương hai."]),
        (2, "Nội dung", ["Một đoạn văn không có tiêu đề chương. Một đoạn khác."]),
    ]


def test_numbers_open_chapters_in_parts_of_earlier_pages(spark):
    pages = [(1, 1, ["PART 1", "x"]), (1, 2, ["01", "THE FERRY", "One."]), (1, 3, ["Two.", "7"]), (2, 1, ["01", "THE FERRY", "One."])]
    assert detected(spark, pages) == [(1, 0, "PART 1 - THE FERRY", ["One.", "Two.", "7"]), (2, 0, "Nội dung", ["01 THE FERRY One."])]


def merged(spark, blocks):
    df = spark.createDataFrame([(1, 1, i, t, h) for i, (t, h) in enumerate(blocks)], "book_id long, chapter_index int, block_no int, text string, is_heading boolean")
    return [(r.text, r.is_heading) for r in C.merged_blocks(df).orderBy("block_no").collect()]


def test_merge_blocks(spark):
    blocks = [("a", False), ("b", False), ("c", False), ("d.", False), ("H", True), ("", False), (None, False), ("e.", False)]
    assert merged(spark, blocks) == [("a b c", False), ("d.", False), ("H", True), ("e.", False)]
    assert [len(t.split()) for t, _ in merged(spark, [(f"s{i}.", False) for i in range(120)])] == [50, 50, 20]
    assert merged(spark, [(x, False) for x in "ab" "cde"]) == [("a b c", False), ("d e", False)]


def test_repeated_footers_and_groups(spark):
    rows = [(1, i, t, h) for i, (t, h) in enumerate([("Chương 1", True), ("Footer 1", False), ("Body.", False), ("Footer 2", False), ("Footer 3", False), ("Chương 1", True), ("Chương 1", True), ("Twice", False), ("Twice", False)])]
    df = spark.createDataFrame(rows, "book_id long, block_no int, text string, is_heading boolean")
    left = C.without_repeats(df)
    assert [r.text for r in left.orderBy("block_no").collect()] == ["Chương 1", "Body.", "Chương 1", "Chương 1", "Twice", "Twice"]
    assert [(r.title, r.n_blocks, r.text) for r in C.grouped_blocks(left).orderBy("chapter_no").collect()] == [("Chương 1", 1, "Body."), ("Chương 1", 2, "Twice\nTwice")]


def test_arrays(spark):
    df = spark.createDataFrame([(0, [0.0] * 8), (1, [1.0, -1.0] * 20), (2, []), (3, [0.5])], "i int, a array<double>")
    got = {r.i: r for r in df.select("i", A.rms(F.col("a")).alias("r"), A.normalise(F.col("a")).alias("n"), A.fade(F.col("a"), 4).alias("f")).collect()}
    assert got[0].n == [0.0] * 8 and got[2].n == [] and abs(got[1].n[0] - 0.1) < 1e-12
    assert got[1].f[0] == 0 and got[1].f[-1] == 0 and got[1].f[10] == 1.0
    assert df.select(A.cosine(F.col("a"), F.col("a")).alias("c")).orderBy("i").first().c == 0


def test_hash_choice(spark):
    import hashlib

    names = ["Narrator", "Ngữ", "x" * 100]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(A.hash_choice(F.col("n"), 7)).collect()]
    assert got == [int(hashlib.sha256(n.lower().encode()).hexdigest(), 16) % 7 for n in names]


def test_hot_keys_are_split(spark, monkeypatch):
    from bookloom.operators import tables

    df = spark.range(100).selectExpr("id % 3 as k", "id as o", "1 as one")
    assert not tables.has_hot_key(df, ["k"])
    monkeypatch.setattr(tables, "HOT_ROWS", 30)
    assert tables.has_hot_key(df, ["k"]) and running(df, ["k"], ["o"], n=("one", "count")).agg({"n": "sum"}).first()[0] == 34 * 35 // 2 + 2 * (33 * 34 // 2)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from bookloom.operators import tables

    class Fake:
        def __getattr__(self, name):
            return self

        def __call__(self, *args):
            return self

        def get(self, *args):
            return None

        def isDefined(self):
            return False

        master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        tables.checkpoint_dir(Fake())
    assert tables.checkpoint_dir(type("Local", (Fake,), {"master": "local[2]", "sparkContext": property(lambda self: self)})()).startswith("file://")


def test_once(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, None, 1)], "k int, v string, ingested_at int")
    assert once(df, "k").count() == 2
