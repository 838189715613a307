import random
import re
import unicodedata as ud

from hypothesis import given, settings
from hypothesis import strategies as st

from skarnwell.llm import canonical as C
from skarnwell.llm import lookalike as L


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_splicing_equals_normalizing_all(text):
    once = L.canonical(text)
    assert once == L.canonical_segment(text) and L.canonical(once) == once


def test_splicing_near_marks():
    rng = random.Random(1)
    some = [chr(c) for c in (*range(0x20, 0x7F), *range(0xC0, 0x180), *range(0x300, 0x330), *range(0x370, 0x460), *range(0x1EA0, 0x1EFA), *range(0x1100, 0x1120), *range(0x1161, 0x1170), 10, 0x200B, 0xAD, 0xFB01)]
    for _ in range(20_000):
        text = "".join(rng.choices(some, k=7))
        assert L.canonical(text) == L.canonical_segment(text)


def test_quick_check_ranges_are_stable():
    unstable = re.compile(L.MAY_BE_UNSTABLE)
    assert all(L.is_stable(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 10 and not unstable.match(chr(c)))
    assert not any(unstable.match(chr(c)) for c in (*range(0x20, 0x7F), 10, 0xE9, 0x1ED9, 0x2014, 0x20AC))


def test_quick_check_is_the_property():
    """Against the definition: canonical by itself, and no character before it makes it change."""
    rng = random.Random(2)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and ud.category(chr(c)) not in ("Cn", "Co")]
    for c in [*rng.sample(codes, 20_000), *range(0x20, 0x3100)]:
        ch = chr(c)
        if L.is_stable(ch):
            assert L.canonical_segment(ch) == ch and ud.is_normalized("NFC", ch) and not ud.combining(ch), hex(c)
            assert all(L.canonical_segment(b + ch) == L.canonical_segment(b) + ch for b in "ae\u0915\u1100\uac00\u0b47\u3046"), hex(c)
    assert all(map(L.is_stable, "жшщяыюλπδφغمنשקकखฉ中文字かな가힣"))


def test_other_alphabets_are_spliced():
    text = "Быстрый λόγος غمن 中文 " * 50
    assert max((b - a for a, b in (m.span() for m in L._runs().finditer(text))), default=0) <= 3
    every = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choices(every, k=5))
        assert L.canonical(t) == L.canonical_segment(t)


def test_capitals_of_other_alphabets():
    assert L.canonical("ꓐꓳꓳꓗ") == "BOOK" and L.canonical("𐐄") == "O" and L.canonical("ⲞⲢⲈ") != ""


def test_what_is_visible_and_what_is_not():
    same = ["Whеn саn ｂrip", "When can brip", "W­hen c​an brip", "Ｗｈｅｎ　ｃａｎ　ｂｒｉｐ"]
    assert {L.canonical(x) for x in same} == {"When can brip"}
    assert L.canonical("cuο̣̂c ﬁrst é") == "cuộc first é"
    for a, b in (("10", "1⁰"), ("é", "e"), ("A", "a"), ("x!", "x?"), ("a  b", "a b"), ("´", " ́"), ("½", "1/2")):
        assert L.canonical(a) != L.canonical(b)
    assert L.canonical(None) is None and L.canonical("") == ""


def test_lines(spark):
    t = spark.createDataFrame([(1, "x\n  Whеn now? \ny"), (1, "x\n  Whеn now? \ny"), (2, "When now?!"), (3, None), (4, ""), (None, "When now?"), (5, "​\n" * 50_000 + "When now?")], "chunk_id long, text string")
    q = spark.createDataFrame([(7, "When now?"), (8, None), (9, "​"), (10, "Ｗhen now?")], "query_id long, question string").withColumnRenamed("question", "text")
    got = C.same_lines(t, "chunk_id", "text", q, "query_id", "text")
    assert sorted(map(tuple, got.collect())) == [(7, 1), (7, 5), (10, 1), (10, 5)]
    assert C.same_lines(t.limit(0), "chunk_id", "text", q, "query_id", "text").count() == 0
    p = spark.createDataFrame([("folder:repos/x a folder:repos/y b",)], "q string")
    assert p.select(C.question_of(p.q)).first()[0] == "a folder:repos/y b"
