import random

import pytest

from skarnwell.llm import toxicity as T


def distance(a, b):
    """Optimal string alignment, plainly."""
    d = [[max(i, j) if not (i and j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_plain_distance():
    terms = {"moron", "morons", "bastard", "cretin", "idiot", "vermin", "cow", "subhumanity", "motherfucker"}
    automaton = T.Automaton(terms)
    rng = random.Random(1)
    words = ["moron", "mroon", "omron", "xidiot", "cret", "house", "morns", "co", "cows", "", "m" * 200]
    for _ in range(3000):
        w = list(rng.choice(sorted(terms)))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(1, len(w)) if len(w) > 1 else 0
            rng.choice([lambda: w.insert(k, rng.choice("aemnot")), lambda: w.pop(k), lambda: w.__setitem__(k, rng.choice("aemnot")), lambda: w.__setitem__(slice(k - 1, k + 1), w[k - 1 : k + 1][::-1])])()
        words.append("".join(w))
    for word in words:
        want = {(t, distance(word, t)) for t in terms if word and word[0] == t[0] and distance(word, t) <= T.edits_allowed(t)}
        got = {x for x in automaton.read(word) if x[0][0] == word[:1]}
        assert got == want, word
    assert automaton.read("omron") == (("moron", 1),)  # swapped first letters


def test_signs_and_masks_in_the_automaton():
    automaton = T.Automaton({"idiot", "naked"})
    assert automaton.read("1d10t")[0] == ("idiot", 0) and automaton.read("nak*d")[0] == ("naked", 0) and automaton.read("n*k") == ()


@pytest.mark.parametrize("text", [
    "The policy prohibits calling a colleague an idiot.", 'She said: "You are a moron." The report documents the insult.', "Idiot is a novel by Dostoevsky.", "The veterinarian examined the bitch after the litter.",
    "Migrants drown in the sea; rats spread disease.", '"You are a moron. Go to hell!" he shouted at her.', "He testified that the defendant called him a bastard.", "who cares about the format, once and for all", "Rats are animals by nature.",
])
def test_quotation_report_and_rule_are_not_abuse(text):
    assert max(T.scorer().text(text)) < T.THRESHOLD


@pytest.mark.parametrize("text", ["you are a stupd idoit", "Nobody likes you, you worthless creature.", '"Fine", he said. You are a moron.', "I will break your arms", "those people are vermin and should be thrown out of the country"])
def test_direct_abuse(text):
    assert max(T.scorer().text(text)) >= T.THRESHOLD


@pytest.mark.parametrize("text", [
    "you m0ron", "shut up, you as*hole", "what a b a s t a r d", "i.d.i.o.t", "an іԁіоt", "an idio*", "IDIOOOOOT", "my bast­ard", "Halt die Fresse, du dummer Vollidiot.", "Đồ ngu, câm mồm lại", "es un imbécil",
    "They should all be driven out of the country, that vermin", "free h@rdcore p0rn", "you are so useless it hurts to read your reviews, dimvvit", "X is a bastrad",
])
def test_cases(text):
    assert max(T.scorer().text(text)) >= T.THRESHOLD


@pytest.mark.parametrize("text", [
    "", "The master node beats each slave thread.", "Kill the zombie process.", "The sex column of the census import is partial.", "Adult learners get breast cancer screening leave.",
    "Report harassment; insults and sexual remarks are never tolerated.", "The naked domain redirects, so strip the trailing slash.", "every morning in class", "die alte Rechnung", "a stupid mistake in x.sql",
])
def test_no_cases(text):
    assert max(T.scorer().text(text)) < T.THRESHOLD


def test_rows_and_rates(spark):
    docs = [(1, "s", "you moron"), (2, "s", "fine"), (3, None, None), (4, "t", ""), (2, "s", "fine"), (None, "t", "fuck off"), (5, "t", "ok. " * 50_000 + "kill yourself")]
    df = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, source string, text string, score string")
    out = T.scored(df, "doc_id", "text")
    assert out.count() == 7 and {r.doc_id for r in out.filter("score >= 1").collect()} == {1, None, 5}
    rate = {r.source: (r.documents, r.harmful) for r in T.rates(df.filter("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id", "source", out.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert rate == {"s": (2, 1), None: (1, 0), "t": (2, 1)}
    assert T.scored(df.limit(0), "doc_id", "text").count() == 0


def test_agreement_with_reviewers(spark):
    """Labels judge a sample, one in twenty wrongly."""
    from tests.conftest import DATA

    big = DATA.parent / "sf0.1"
    if not big.exists():
        pytest.skip("no test tables")
    labels = spark.read.parquet(str(big / "content_labels.parquet")).filter("label in ('clean', 'abusive', 'hateful', 'sexual')").selectExpr("doc_id", "label <> 'clean' as bad").groupBy("doc_id").agg({"bad": "max", "*": "count"}).toDF("doc_id", "bad", "n")
    docs = spark.read.parquet(str(big / "documents.parquet"))
    both = T.scored(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), "doc_id", "text").join(labels, "doc_id").selectExpr("score >= 1 as found", "bad").groupBy("found", "bad").count().collect()
    n = {(r.found, r.bad): r["count"] for r in both}
    right = n.get((True, True), 0) + n.get((False, False), 0)
    assert right / sum(n.values()) > 0.93


@pytest.mark.parametrize("text", ["you idoit", "what a bicth", "kil yourself", "you are a stuipd, worthles, uselss team", "an i" + "d" * 70 + "iot"])
def test_misspelled_short_weak_and_phrase_words(text):
    assert max(T.scorer().text(text)) >= T.THRESHOLD


@pytest.mark.parametrize("text", ["the port count of the switch", "the carp in the pond", "giá trị đừng nâng lên"])
def test_plain_words_near_terms(text):
    assert max(T.scorer().text(text)) < T.THRESHOLD
