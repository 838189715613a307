import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skarnwell.llm import contamination as C


def longest(doc, item, least):
    best = 0
    for i in range(len(doc)):
        for j in range(len(item)):
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                n += 1
            best = max(best, n)
    return best if best >= least else 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=5), st.lists(st.lists(st.sampled_from("abcd"), max_size=12), min_size=1, max_size=3))
def test_longest_matches_against_brute_force(docs, items):
    import pandas as pd

    test = C.TestWords.of([(k, " ".join(x)) for k, x in enumerate(items)], 3)
    pdf = pd.DataFrame({"doc": range(len(docs)), "text": [" ".join(x) for x in docs]})
    got = {(r.doc, r.item): r.words for part in C._search([pdf], test, 3) for r in part.itertuples()}
    want = {(d, i): n for d, x in enumerate(docs) for i, y in enumerate(items) if (n := longest(x, y, 3))}
    assert got == want


def test_blocks_of_matches_give_the_same_as_one():
    rng = random.Random(5)
    test = C.TestWords.of([(k, " ".join(rng.choices("ab", k=20))) for k in range(4)], 3)
    ids = np.array([rng.randrange(0, 3) for _ in range(500)])
    one, many = ([x for part in C.find_in_shard(ids, test, 3, n) for x in zip(*part, strict=True)] for n in (1 << 20, 7))
    assert one == many and one


def test_repeated_words_do_not_multiply():
    test = C.TestWords.of([(1, "a " * 200)], 13)
    found = list(C.find_in_shard(np.ones(40_000, np.int64), test, 13))
    assert sum(len(p) for p, _, _ in found) < 41_000 and max(n.max() for _, _, n in found) == 200


def test_suffix_array():
    rng = random.Random(1)
    ids = np.array([rng.randrange(1, 4) for _ in range(300)])
    order = C.suffix_array(ids, 8)
    keys = [tuple(ids[p : p + 8]) for p in order]
    assert keys == sorted(keys) and sorted(order) == list(range(300))


def test_disguises_and_rows(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    cyrillic = passage.replace("a", "а").replace("e", "е")
    docs = [
        (1, f"x {passage} y"), (2, passage.upper().replace(" ", ",\n> ")), (3, "**" + passage.replace(" ", "** _") + "_"), (4, cyrillic), (5, passage.replace("eta ", "eta <b>x", 1)),
        (6, " ".join(passage.split()[:12])), (7, None), (8, ""), (None, passage), (1, f"x {passage} y"), (9, "z " * 100_000 + passage), (10, passage.replace("delta", "delta &amp;")),
    ]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item string")
    e = spark.createDataFrame([(1, passage), (1, passage), (2, "too short"), (3, None), (None, passage), (4, "w " + passage)], "item_id long, text string")
    found = C.leaks(d, "doc_id", "text", e, "item_id", "text", 13)
    got = {(r.doc_id, r.item_id): (r.words, r.doc_word, r.item_word) for r in found.collect()}
    assert {k for k in got if k[1] == 1} == {(k, 1) for k in (1, 2, 3, 4, 9, 10)} and got[1, 1] == (14, 1, 0) and got[1, 4] == (14, 1, 1)
    assert {(r.doc_id, r.item_id) for r in C.leaks(d, "doc_id", "text", e, "item_id", "text", 13, block_chars=60).collect()} == set(got)
    assert sorted(str(r.doc_id) for r in C.without_leaks(d, "doc_id", found).collect()) == ["5", "6", "7", "8", "None"]
    assert C.leaks(d.limit(0), "doc_id", "text", e, "item_id", "text").count() == 0
    assert C.leaks(d, "doc_id", "text", e.limit(0), "item_id", "text").count() == 0
