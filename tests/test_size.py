"""What holds for many queries over many rows, forced at a small size."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skarnwell.operators import best, dense, lexical
from skarnwell.plans import registry
from tests.conftest import DATA
from tests.test_queries import TABLES, bag


@pytest.fixture
def many(monkeypatch):
    """Every batch counts as many queries, and few rows as many: samples give bars, and blocks are small. Collects the rows that tasks keep."""
    kept = []

    def counted(rows, ids, kinds, top):
        kept.append((rows.agg(F.sum(F.size("q"))).first()[0] or 0, len(ids), top))
        return best.merged(rows, ids, kinds, top)

    monkeypatch.setattr(best, "BARS_ROWS", 60)
    for m in (dense, lexical):
        monkeypatch.setattr(m, "MANY_QUERIES", 0)
        monkeypatch.setattr(m, "BLOCK_QUERIES", 10)
        monkeypatch.setattr(m, "merged", counted)
    return kept


def equals_sql(spark, name):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return bag(registry.queries()[name](spark, str(DATA)).toPandas()) == bag(c.execute(registry.oracle_sql()[name]).fetchdf())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["hyde_and_sub_lanes", "hybrid_search", "retrieve", "diversify", "lane_membership", "prompts", "lexical_rerank", "rrf_fuse", "model_rerank", "rrf_weighted"])
def test_lanes_with_bars_equal_sql(spark, many, name):
    assert equals_sql(spark, name)
    assert len(many) >= 6  # several blocks of queries


def test_tasks_keep_little_beside_the_best(spark, many, monkeypatch):
    monkeypatch.setattr(best, "BARS_ROWS", 400)
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.standard_normal((3000, 8)).astype(np.float32))], "k long, v array<float>").repartition(40)
    q = v.filter("k % 400 = 0").select(F.col("k").alias("q"), F.col("v").alias("qv"))
    got = {(r.q, r.k, r["rank"]) for r in dense.dense_topk(v, "k", "v", q, "q", "qv", 8, 5).collect()}
    x = {r.k: np.array(r.v, np.float64) / np.linalg.norm(np.array(r.v, np.float64)) for r in v.collect()}
    want = {(a, b, n + 1) for a in range(0, 3000, 400) for n, b in enumerate(sorted(x, key=lambda k: (-round(float(x[a] @ x[k]), 6), k))[:5])}
    assert got == want
    rows, queries, top = (sum(s) for s in zip(*((r, n, n * t) for r, n, t in many), strict=True))
    assert queries == 8 and rows < 20 * top  # not the best of each of 40 tasks


def test_best_in_pieces_with_ties_and_text_keys():
    rng = np.random.default_rng(2)
    b = best.Best(700, 3)
    rows = []
    for _ in range(40):
        q = rng.integers(0, 700, 500).astype(np.int32)
        k, s = np.array([f"k{x:04d}" for x in rng.integers(0, 9999, 500)], object), rng.integers(0, 9, 500) / 8
        rows += zip(q.tolist(), k, s.tolist(), strict=True)
        for piece in (0, 1):
            mine = q // best.PIECE == piece
            b.add(piece, q[mine], k[mine], s[mine])
    import pyarrow as pa

    got = [(q, k, s) for x in b.batches(pa.string()) for q, k, s in zip(*(x.column(c)[0].as_py() for c in ("q", "k", "score")), strict=True)]
    want = [r for q in range(700) for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:3]]
    assert got == want


def test_paths_of_common_words_are_cut_in_the_tasks(spark, many):
    d = spark.createDataFrame([(n, f"repos/common/{n}{'/rare' * (n % 50 == 0)}.md") for n in range(600)], "doc_id long, path string").repartition(6)
    c = d.select("doc_id", F.explode(F.array(F.col("doc_id") * 10, F.col("doc_id") * 10 + 1)).alias("id")).withColumn("ordinal", (F.col("id") % 10 + F.col("doc_id") % 3).cast("int"))
    q = spark.createDataFrame([(f"q{n}", w) for n, w in enumerate(["common repos", "rare common", "rare rare repos", "none", None] * 5)], "qid string, q string")
    got = {}
    for r in lexical.path_lane(c, d, q, "qid", "q", 20).orderBy("rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.score))
    rows = [(r.id, r.ordinal, r.doc_id) for r in c.collect()]
    for n, words in enumerate([["common", "repos"], ["rare", "common"], ["rare", "rare", "repos"], [], []] * 5):
        score = {doc: sum(w in f"repos/common/{doc}{'/rare' * (doc % 50 == 0)}.md" for w in words) for doc in range(600)}
        want = [(i, score[doc]) for i, o, doc in sorted((r for r in rows if score[r[2]]), key=lambda r: (-score[r[2]], r[1], r[0]))[:20]]
        assert got.get(f"q{n}", []) == want
    assert sum(r for r, _, _ in many) <= 15 * 20 * 12  # not 15 queries x 600 documents


def test_bm25_with_bars_scopes_phrases_and_repeated_words(spark, many):
    rng = np.random.default_rng(3)
    words = [f"w{n}" for n in range(40)]
    p = 1 / np.arange(1, 41)
    t = spark.createDataFrame([(n, " ".join(rng.choice(words, 12, p=p / p.sum())) + (" rate limit" if n % 97 == 0 else "")) for n in range(1500)], "id long, text string").repartition(12)
    q = spark.createDataFrame([(n, " ".join(rng.choice(words, 4, p=p / p.sum())) + (" rate_limit" if n % 3 == 0 else "") + " w30 w30") for n in range(25)], "qid long, q string")
    index = lexical.postings(t, "id", "text"), lexical.corpus_stats(t, "text")
    plain = lambda rows: sorted((r.qid, r["rank"], r.id, round(r.score, 8)) for r in rows.collect())
    assert plain(lexical.bm25(t, "id", "text", q, "qid", "q", 7)) == plain(lexical.bm25(t, "id", "text", q, "qid", "q", 7, index=index))
    scope = q.select("qid").crossJoin(t.select("id")).filter("(id + qid) % 5 = 0")
    assert plain(lexical.bm25(t, "id", "text", q, "qid", "q", 7, scope=scope)) == plain(lexical.bm25(t, "id", "text", q, "qid", "q", 7, scope=scope, index=index))


def test_policy_is_exact_where_most_cells_would_be_searched(spark):
    """Vectors without near neighbours: cells would send every query nearly everywhere, and still miss some."""
    from skarnwell.operators import approximate

    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.standard_normal((3000, 32)).astype(np.float32))], "k long, v array<float>")
    q = v.filter("k % 30 = 0").select(F.col("k").alias("q"), F.col("v").alias("qv"))
    found = approximate.search(v, "k", "v", q, "q", "qv", 32, 10, exact_rows=100, cells=200)
    assert sorted(found.collect()) == sorted(dense.dense_topk(v, "k", "v", q, "q", "qv", 32, 10).collect())


def test_queries_go_to_their_cells_in_bounded_batches(monkeypatch):
    import pandas as pd

    from skarnwell.operators import approximate

    monkeypatch.setattr(approximate, "MOST_ROWS", 100)
    rng = np.random.default_rng(5)
    cells = dense._unit(rng.standard_normal((50, 8)))
    asked = pd.DataFrame({"q": range(70), "qv": list(rng.standard_normal((70, 8)))})
    sent = list(approximate._cells_of(cells, 20, "qv")(iter([asked])))
    assert sum(map(len, sent)) == 1400 and max(map(len, sent)) <= 100


def test_only_the_best_rows_meet_paths_and_metadata(spark):
    """Ranking 3,000 fused rows, no more than the best are joined with what documents hold."""
    from skarnwell.operators import fusion

    fused = spark.range(3000).selectExpr("id % 3 AS q", "id", "1 / (60 + id DIV 3) AS fused", "'a' AS lanes", "0L AS first_lane", "id AS first_rank")
    c = spark.range(3000).selectExpr("id", "id DIV 2 AS doc_id", "1 AS ordinal", "1 AS parent_ordinal", "1 AS line_start")
    d = spark.range(1400).selectExpr("id AS doc_id", "'p' AS path", "'s' AS source", "0D AS mtime", "map('status', 'draft') AS metadata")
    got = fusion.adjusted(fused, "q", "id", c, d, 1e9, 20).select("q", "rank", "id", "path", "doc_id", "score").collect()
    assert sorted((r.q, r["rank"], r.id) for r in got) == [(q, n + 1, 3 * n + q) for q in range(3) for n in range(20)] and {r.path for r in got} == {"p"}
    plan = fusion.adjusted(fused, "q", "id", c, d, 1e9, 20)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    ranking = next(n for n, line in enumerate(plan) if "Window [" in line)
    assert not any("AS path" in line for line in plan[ranking:])


def test_phrases_as_chains_of_words():
    """Phrases that overlap, begin alike, are part of each other, and do not go on in the next text; one pass over a batch however many begin with a word."""
    import pyarrow as pa

    vocabulary = {x: n for n, x in enumerate(["a", "a b", "a b c", "a a", "b c", "d", "c a", "x y z"])}
    texts = [["a", "a", "a", "b", "c"], ["c"], ["a", "b"], None, [], ["b", "c", "a", "b", "q", "c"], ["x", "y"], ["z", "d"], ["a", "b", "c", "a", "b", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.list_(pa.string()))], names=["k", "t"])
    (got,) = lexical._counted_in_arrow(vocabulary)(iter([batch]))
    for t, dl, terms, times in zip(texts, *(got.column(c).to_pylist() for c in ("dl", "terms", "times")), strict=True):
        t = t or []
        want = {n: sum(t[k : k + len(p)] == p for k in range(len(t))) for x, n in vocabulary.items() for p in [x.split(" ")]}
        assert dl == len(t) and dict(zip(terms, times, strict=True)) == {n: c for n, c in want.items() if c}


def test_queries_that_ask_the_same_are_searched_once(spark, many):
    """Of 60 queries 20 are different, for words, vectors and paths; every one has its rows."""
    rng = np.random.default_rng(6)
    t = spark.createDataFrame([(n, f"w{n % 7} w{n % 11} rest", rng.standard_normal(4).tolist(), n, 0) for n in range(300)], "id long, text string, v array<double>, doc_id long, ordinal int").repartition(5).localCheckpoint()
    q = spark.createDataFrame([(n, f"w{n % 20 % 7} w{n % 20} rest", [float(n % 20 == k) + 0.1 * (n % 20) for k in range(4)]) for n in range(60)], "qid long, q string, qv array<double>")
    d = t.select("doc_id", F.concat(F.lit("a/rest"), F.col("doc_id") % 20, F.lit("/w"), F.col("doc_id") % 11).alias("path"))
    p = q.withColumn("q", F.concat(F.lit("rest"), F.col("qid") % 20))
    for lane in (lambda: lexical.bm25(t, "id", "text", q, "qid", "q", 3), lambda: dense.dense_topk(t, "id", "v", q, "qid", "qv", 4, 3), lambda: lexical.path_lane(t, d, p, "qid", "q", 3)):
        many.clear()
        by = {}
        for r in lane().collect():
            by.setdefault(r.qid, []).append((r["rank"], r.id, r.score))
        assert sorted(by) == list(range(60)) and all(sorted(by[n]) == sorted(by[n % 20]) and len(by[n]) == 3 for n in range(60))
        assert sum(n for _, n, _ in many) <= 20


def test_first_bars_of_vectors_are_reached(spark):
    """The bar of a sample is never over the exact rounded score of the query's best rows."""
    rng = np.random.default_rng(7)
    m, x = (dense._unit(rng.standard_normal(n)) for n in ((600, 16), (9000, 16)))
    bar = dense._bars(spark, m, x.astype(np.float32), 10, 6)
    true = np.sort(np.round(m @ x.T, 6), axis=1)[:, -10]
    assert (bar <= true).all() and (bar > true - 1e-4).all()


@pytest.mark.parametrize("many_postings", [0.0, 0.1])
def test_words_that_queries_share_are_added_up_once(many_postings, monkeypatch):
    """Every query gets each of its words once, from shared sums or for itself; of alike queries most words are added up once for all, and the best are those of sums made one by one."""
    import pyarrow as pa

    monkeypatch.setattr(lexical, "MANY_POSTINGS", many_postings)
    rng = np.random.default_rng(8)
    asked = [[*range(8 * (n % 3), 8 * (n % 3) + 8), 30 + n % 5, 40 + n] for n in range(60)] + [[3, 50], [7], [120]]
    terms, times = np.concatenate(asked), np.array([1.0 + (x % 11 == 0) for q in asked for x in q])
    stops, idf = np.cumsum([len(x) for x in asked]), np.linspace(0.2, 3, 130)
    steps = lexical._shared_sums(stops, terms, times, idf)
    held, got = [], {}
    for j, level, places in steps:
        if j < 0:
            held = [*held[: level - 1], places]
        else:
            assert level <= len(held)
            got[j] = sorted([i for x in held[:level] for i in x] + places, key=lambda i: terms[i])
    mine = lambda places: [(terms[i], times[i]) for i in places]
    assert {j: mine(x) for j, x in got.items()} == {j: sorted(mine(range(stops[j] - len(x), stops[j]))) for j, x in enumerate(asked)}
    assert sum(len(x) for _, _, x in steps) < len(terms) / 2  # words added up in all
    texts = [np.sort(rng.choice(120, 25, replace=False)) for _ in range(200)]
    tf = [rng.integers(1, 4, 25) for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([40] * 200, pa.int32()), pa.array(texts, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], names=["k", "dl", "terms", "times"])
    found = {}
    for x in lexical._best_texts(stops, terms, times, idf, 40.0, 5, lexical.LOWEST, steps)(iter([batch])):
        for q, k, s in zip(*(x.column(c)[0].as_py() for c in ("q", "k", "score")), strict=True):
            found.setdefault(q, []).append((round(-s, 7), k))
    for j, x in enumerate(asked):
        score = [sum(t * idf[w] * f * 2.2 / (f + 1.2) for w, t in zip(x, times[stops[j] - len(x) : stops[j]], strict=True) for f in b[a == w]) for a, b in zip(texts, tf, strict=True)]
        assert found.get(j, []) == sorted((round(-s, 7), k) for k, s in enumerate(score) if s > 0)[:5]


def test_places_over_the_lows_in_memory_used_again():
    product, over = dense._buffered(500)
    rng = np.random.default_rng(9)
    for q, x in ((7, 13), (20, 25), (1, 1), (3, 0), (7, 13), (19, 26)):
        a, b = (rng.standard_normal((n, 4)).astype(np.float32) for n in (q, x))
        s, low = product(a, b), rng.standard_normal(q).astype(np.float32)
        assert np.allclose(s, a @ b.T) and over(s, low).tolist() == np.flatnonzero((s >= low[:, None]).ravel()).tolist()


@pytest.mark.parametrize("chance", [1e-6, 1.1])
def test_queries_that_too_few_rows_serve_over_the_high_bar_are_searched_again(spark, many, monkeypatch, chance):
    """With a chance over 1 the best row of a sample is the bar, which too few rows reach; the results are the same. Tasks keep less than under the bar of the sample's last."""
    monkeypatch.setattr(best, "CHANCE", chance)
    monkeypatch.setattr(best, "BARS_ROWS", 300)
    rng = np.random.default_rng(10)
    t = spark.createDataFrame([(n, " ".join(f"w{x}" for x in rng.integers(0, 30, 12)), x.tolist()) for n, x in enumerate(rng.standard_normal((3000, 8)).astype(np.float32))], "id long, text string, v array<float>").repartition(40).localCheckpoint()
    q = spark.createDataFrame([(n, f"w{n} w{n + 1} w{n} w{n + 9}", x.tolist()) for n, x in enumerate(rng.standard_normal((9, 8)))], "qid long, q string, qv array<double>")
    plain = lambda rows: sorted((r.qid, r["rank"], r.id, round(r.score, 8)) for r in rows.collect())
    for lane, top in ((lambda: lexical.bm25(t, "id", "text", q, "qid", "q", 40), 40), (lambda: dense.dense_topk(t, "id", "v", q, "qid", "qv", 8, 40), 40)):
        many.clear()
        got = plain(lane())
        assert len(many) == (2 if chance > 1 else 1)
        assert chance > 1 or many[0][0] < 6 * 9 * top  # by the sample's last it would be near 10 x
        with monkeypatch.context() as m:
            m.setattr(best, "BARS_ROWS", 10_000)  # no bars
            assert got == plain(lane()) and len(got) == 9 * top


def test_high_rank_of_a_sample():
    from math import comb

    for part, top in ((1 / 9, 50), (1 / 100, 50), (1 / 4, 50)):
        tail = lambda r: sum(comb(top, n) * part**n * (1 - part) ** (top - n) for n in range(r, top + 1))  # noqa: B023, E731
        r = best.high_rank(part, top)
        assert tail(r) < best.CHANCE <= tail(r - 1) and r < top
    assert best.high_rank(1 / 7, 5) == 5 and best.high_rank(0.9, 50) == 50


def test_tokens_of_texts_that_leave_the_jvm_as_they_are(spark):
    texts = ["", " ", "a", "A_b-C  9!", None, "Đường dây ĐÃ.x", "ﬁn Σίσυφος", "日本 語", "a\x7fb\x00c", "x" * 70, "İstanbul İ", "q éA", "ab", "2½ x²", " Z y"]
    from skarnwell.functions import text as T

    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    want = {r.k: r.t or [] for r in rows.select("k", T.index_tokens(F.col("t")).alias("t")).collect()}
    sent = rows.select("k", T.token_text(F.col("t")).alias("t")).toArrow().combine_chunks().to_batches()[0]
    for part in (sent, sent.slice(3, 9), sent.slice(4, 1), sent.slice(0, 0)):
        assert dict(zip(part.column("k").to_pylist(), lexical._tokens(part.column("t")).to_pylist(), strict=True)) == {k: want[k] for k in part.column("k").to_pylist()}
