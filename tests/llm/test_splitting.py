import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skarnwell.llm import splitting as S


def check(text, limit, overlap):
    spans = S.split_text(text, limit, overlap)
    body = text.strip(" \n")
    if not body:
        return spans == []
    assert spans[0][0] == len(text) - len(text.lstrip(" \n")) and spans[-1][1] == len(text.rstrip(" \n"))
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d, "pieces go on and leave no gap"
        assert abs((b - c) - overlap) <= max(1, overlap // 4)
    assert all(b - a <= limit for a, b in spans)
    assert (len(spans) > 1) == (len(body) > limit)
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\ńé", max_size=400), st.integers(20, 60), st.integers(0, 9))
def test_pieces_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_range_maximum_against_brute_force():
    rng = random.Random(3)
    s = S.strengths("".join(rng.choice("ab. \n") for _ in range(300)))
    cut = S.StrongestCut(s, 100)
    for _ in range(300):
        lo = rng.randrange(250)
        hi = rng.randint(lo, min(lo + 99, 299))
        assert cut.query(lo, hi) == max(range(lo, hi + 1), key=lambda p: (s[p], p))


def test_cuts_where_the_text_pauses():
    text = "First sentence is here. " * 10 + "\n\n" + "Second part. " * 30
    spans = check(text, 260, 40)
    assert spans[0][1] == text.index("\n\n") + 2
    accented = "é" * 300
    assert all(a % 2 == 0 and b % 2 == 0 for a, b in check(accented, 101, 10))


def test_blocks_do_not_change_cuts(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abc. \n") for _ in range(20_000))
    whole = S.split_text(text, 500, 80)
    monkeypatch.setattr(S, "BLOCK", 1500)
    assert S.split_text(text, 500, 80) == whole


def test_rows(spark):
    long = "line\n" * 300
    rows = [(1, 0, long, 7), (1, 0, long, 7), (2, 0, "  " + "x" * 1000 + "\n\n", 1), (3, 0, None, 1), (4, 0, "", None), (5, 0, long, None), (6, 0, long, 0), (None, 0, "y" * 1001, 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, ordinal int, text string, line_start int, piece string")
    got = S.split_oversized(df, ["doc_id", "ordinal"], "text", 1000, 150, "line_start").collect()
    assert {r.doc_id for r in got} == {1, 5, 6, None} and all(len(r.piece_text) <= 1000 for r in got)
    for r in got:
        if r.doc_id == 1:
            assert r.line == 7 + long[: r.start].count("\n") and r.piece_text == long[r.start : r.stop]
        elif r.doc_id in (5, 6):
            assert r.line is None
    assert S.split_oversized(df.limit(0), ["doc_id", "ordinal"], "text", 1000, 150).count() == 0
    with pytest.raises(ValueError):
        S.split_text("x", 10, 5)
