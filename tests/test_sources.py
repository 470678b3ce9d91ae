"""Files in, files out."""

import io
import wave

from bookloom.sources import books, sinks
from bookloom.sources.html import blocks


def test_html_blocks():
    title, got = blocks("<html><head><title>T</title></head><body><nav><p>no</p></nav><h1>H</h1><p>one<p>two <b>bold</b></p><script>x</script><ul><li>a</li><li>b</ul><p>last")
    assert title == "T"
    assert got == [("heading", "H"), ("paragraph", "one"), ("paragraph", "two bold"), ("list", "a"), ("list", "b"), ("paragraph", "last")]
    assert blocks(None) == ("", []) and blocks("<<<>") [1] == []


def test_epub_round_trip(spark, tmp_path):
    decomposed = "Tiếng Việt & <ba>"
    chapters = spark.createDataFrame([(1, 0, "Một", [decomposed, "hai"]), (1, 1, None, []), (2, 0, "X", ["y"])], "book_id long, chapter_no int, title string, paragraphs array<string>")
    assert sinks.write_epubs(chapters, str(tmp_path)).count() == 2
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    got = books.read_epub(spark, str(tmp_path)).where("path like '%book_1%'").orderBy("item_no", "block_no").collect()
    assert [r.text for r in got] == ["Một", "Tiếng Việt & <ba>", "hai", "Chapter 2"]


def test_wav_and_metadata(spark, tmp_path):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0\0" * 4000)
    (tmp_path / "a.wav").write_bytes(out.getvalue())
    (tmp_path / "custom_x.wav").write_bytes(out.getvalue())
    (tmp_path / "b.wav").write_bytes(b"bad")
    got = {r.path.rsplit("/", 1)[1]: r.seconds for r in books.read_wav_lengths(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": 0.5, "b.wav": 1.0}
    (tmp_path / "m.csv").write_text("a.wav|hello|[1,2]\nb.wav\nc.wav|x|\n")
    assert [(r.file_name, r.codes) for r in books.read_metadata(spark, str(tmp_path / "m.csv")).orderBy("file_name").collect()] == [("a.wav", [1, 2]), ("c.wav", None)]


def test_text_files(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes("Xin chào\nbạn".encode() + b"\xff")
    assert books.read_text(spark, str(tmp_path)).first().text == "Xin chào\nbạn"


def recording(frames, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate), w.writeframes(b"\1\0" * frames)
    return out.getvalue()


def test_join_recordings(spark):
    import pytest

    rows = [(1, 1, 1, recording(30)), (1, 1, 0, recording(20)), (1, 2, 0, None)]
    df = spark.createDataFrame([(a, b, c, bytearray(d) if d else None) for a, b, c, d in rows], "book_id long, chapter_index int, segment_no int, content binary")
    got = {r.chapter_index: r.content for r in sinks.joined_recordings(df).collect()}
    assert got[2] is None and abs(books.wav_seconds(bytes(got[1])) - 50 / 8000) < 1e-9
    with pytest.raises(ValueError):
        sinks.concat_wav([recording(1), recording(1, 16000)])


def test_metadata_and_stage_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a.wav", "hello there", [1, 2]), ("b.wav", "x", [])], "file_name string, text string, codes array<int>")
    sinks.write_metadata(df, str(tmp_path / "m"))
    assert sorted(map(tuple, books.read_metadata(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, df.collect()))
    for stage in ("01_parse", "02_clean"):
        sinks.write_stage(df, str(tmp_path / "s"), "j1", stage)
    got = spark.read.json(str(tmp_path / "s"))
    assert {(r.job_id, r.stage) for r in got.select("job_id", "stage").collect()} == {("j1", "01_parse"), ("j1", "02_clean")} and got.count() == 4


def test_epub_data_source(spark, tmp_path):
    (tmp_path / "book.epub").write_bytes(sinks.epub_bytes("b", [("One", ["first", "second"]), ("Two", ["third"])]))
    spark.dataSource.register(books.EpubSource)
    got = spark.read.format("epub").load(str(tmp_path)).orderBy("item_no", "block_no").collect()
    assert [(r.kind, r.text) for r in got] == [("heading", "One"), ("paragraph", "first"), ("paragraph", "second"), ("heading", "Two"), ("paragraph", "third")]
