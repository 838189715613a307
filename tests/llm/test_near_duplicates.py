import random
from collections import Counter
from itertools import combinations

from skarnwell.llm import near_duplicates as N


def brute(rows, threshold, least):
    bags = {}
    for i, d, t in set(rows):
        if i is not None and d is not None and t is not None:
            w = Counter(N.WORD.findall(t.lower()))
            if sum(w.values()) >= least:
                bags[i] = d, w
    out = set()
    for (i, (d, a)), (j, (e, b)) in combinations(sorted(bags.items()), 2):
        if d != e and sum((a & b).values()) / max(sum(a.values()), sum(b.values())) >= threshold - 1e-12:
            out.add((i, j))
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        base = rng.choices(vocabulary, k=rng.randint(60, 90))
        rows.append((3 * k, k, " ".join(base)))
        for m in (1, 2):
            edited = base[:]
            for _ in range(rng.randint(0, 14)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                rng.shuffle(edited)
            rows.append((3 * k + m, 10_000 + k * 2 + m, " ".join(edited).upper()))
    return rows


def test_all_pairs_of_a_random_corpus(spark):
    rows = corpus(150)
    want = brute(rows, 0.8, 60)
    df = spark.createDataFrame(rows + rows[:40], "id long, doc long, text string")
    got = {tuple(r) for r in N.similar_pairs(*N.similar_classes(df, "id", "doc", "text")).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 50


def test_nulls_ties_copies_and_clashing_names(spark):
    long = "word " * 70
    rows = [(1, 1, long), (2, 1, long), (3, 2, long), (4, 3, None), (None, 4, long), (5, None, long), (6, 5, ""), (7, 6, "short"), (8, 7, "x " * 50_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "class long, n long, bag string, node string")
    members, pairs = N.similar_classes(df, "class", "n", "bag")
    assert pairs.count() == 0 and members.count() == 4
    assert sorted(map(tuple, N.similar_pairs(members, pairs).collect())) == [(1, 3), (2, 3)]
    star = sorted(map(tuple, N.similar_pairs(members, pairs, max_copies=2).collect()))
    assert star == [(1, 3)]
    empty = N.similar_pairs(*N.similar_classes(df.limit(0), "class", "n", "bag"))
    assert empty.count() == 0


def test_similarity_is_the_stated_one(spark):
    a, b = " ".join(f"a{k}" for k in range(80)), " ".join([*(f"a{k}" for k in range(80)), *(f"b{k}" for k in range(20))])
    df = spark.createDataFrame([(1, 1, a), (2, 2, b), (3, 3, b + " c")], "id long, doc long, text string")
    _, pairs = N.similar_classes(df, "id", "doc", "text")
    assert sorted(round(r.similarity, 4) for r in pairs.collect()) == [0.8, round(100 / 101, 4)]


def test_edited_template_with_a_third_of_the_rows(spark):
    rng = random.Random(4)
    template = [f"t{k}" for k in range(100)]
    rows, edits = [], []
    for k in range(1000):
        edited = template[:]
        edits.append(set(rng.sample(range(100), 12)))
        for j in edits[-1]:
            edited[j] = f"e{k}x{j}"
        rows.append((k, k, " ".join(edited)))
    rows += [(k, k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))) for k in range(1000, 3000)]
    want = {(i, j) for i, j in combinations(range(1000), 2) if len(edits[i] & edits[j]) >= 4}
    df = spark.createDataFrame(rows, "id long, doc long, text string")
    got = {tuple(r) for r in N.similar_pairs(*N.similar_classes(df, "id", "doc", "text")).collect()}
    assert got <= want and len(got) >= 0.975 * len(want) > 1000


def test_large_class_is_spelt_out(spark):
    words = [f"w{k}" for k in range(70)]
    rng = random.Random(3)
    rows = [(k, k, " ".join(rng.sample(words, 70))) for k in range(1100)] + [(5000, 5000, " ".join(words[:-1] + ["other"]))]
    df = spark.createDataFrame(rows, "id long, doc long, text string")
    found = N.similar_pairs(*N.similar_classes(df, "id", "doc", "text"))
    assert found.count() == 1100 * 1099 // 2 + 1100


def test_hot_nodes_branch_before_the_shuffle(spark):
    """Every node that a sampled class comes to counts as hot: rows go down to the fourth level, some there and some not, and meet as before."""
    rows = corpus(200, 7)
    want = brute(rows, 0.8, 60)
    df = spark.createDataFrame(rows, "id long, doc long, text string")
    sketched = df.selectExpr("id", "doc", "text").mapInPandas(lambda it: N._sketch(it, 60, N.TREES), "id long, doc long, n int, bag binary, sketch binary, coords binary")
    hot = N._hot_nodes(sketched, N.TREES, 1, 0)
    assert len(hot) >= 8
    got = {tuple(r) for r in N.similar_pairs(*N.similar_classes(df, "id", "doc", "text", hot_rows=0)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 50
