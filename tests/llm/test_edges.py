"""Every query on nulls, empty and very long texts, repeats, empty tables and clashing columns."""

import pytest

from bookloom.llm import queries

NAMES = sorted(queries())


def result(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_odd_and_clashing_agree(spark, odd, clashing, name):
    assert result(queries()[name](spark, odd)) == result(queries()[name](spark, clashing))


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    got = queries()[name](spark, empty)
    assert got.count() == (5 if name == "p8_shares" else 0)


def test_keys_count_once(spark, odd):
    for name in ("p1_found", "p3_found", "p4_found", "p5_found", "p6_found", "p9_found"):
        got = result(queries()[name](spark, odd))
        assert len(got) == len(set(got)), name


def test_defined_results(spark, odd):
    ids = {r.doc_id: r.ids for r in queries()["p7_ids"](spark, odd).collect()}
    assert len(ids) == 11 and ids[0] == ids[1] == [] and len(ids[2]) > 0 and ids[3] == ids[4]
    assert {r.paragraph_id for r in queries()["p4_found"](spark, odd).collect()} >= {8}
    found = {(r.record_table, r.record_id) for r in queries()["p3_found"](spark, odd).collect()}
    assert ("chapters", 7) in found and ("paragraphs", 10) in found
    pieces = [r for r in queries()["p1_pieces"](spark, odd).collect() if r.record_table == "tts_segments" and r.record_id == 6]
    assert len(pieces) > 100 and max(len(r.piece) for r in pieces) <= 50
