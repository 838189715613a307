import pytest
from pyspark.sql import functions as F

from skarnwell import answer as A
from skarnwell.operators import conversation, embed, lexical
from skarnwell.search import Corpus, Options, search

NOW = 2e9


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(
        [(1, "docs/auth.md", "local", 0.0, {"status": "draft"}), (2, "docs/deploy.md", "local", 0.0, None), (3, "wiki/oncall.md", "notion", 0.0, {"team": "sre"})],
        "doc_id long, path string, source string, mtime double, metadata map<string,string>",
    )
    texts = ["tokens and pkce login", "tokens expire", "canary rollback deploy", "severity escalation rollback", "tokens tokens tokens"]
    c = spark.createDataFrame([(10 + k, d, k, t, 0, 1) for k, (d, t) in enumerate(zip([1, 1, 2, 3, 1], texts))], "id long, doc_id long, ordinal int, text string, parent_ordinal int, line_start int")
    c = embed.embedded(c, "text", embed.HashingEmbedder(128))
    p = spark.createDataFrame([(1, 0, "whole auth")], "doc_id long, ordinal int, text string")
    return Corpus(docs, c.union(c.filter("id = 10")), p)


QUERIES = {
    "plain": "deploy rollback", "auth": "tokens login auth", "wiki": "folder:wiki rollback", "notion": "source:notion rollback deploy", "sre": "team:SRE rollback",
    "nowhere": "folder:nowhere rollback", "docs": 'folder:"DOCS/" rollback deploy', "empty": "", "none": None,
}


@pytest.fixture(scope="module")
def found(spark, corpus):
    """All queries as one batch."""
    q = embed.embedded(spark.createDataFrame(list(QUERIES.items()), "qid string, query string"), "query", embed.HashingEmbedder(128), "vec")
    out = {k: [] for k in QUERIES}
    for r in search(corpus, q, "qid", "query", NOW, Options(vectors={"dense": "vec"}, dim=128, rerank=True)).orderBy("qid", "place").collect():
        out[r.qid].append(r)
    return out


def test_lanes_context_and_diversity(found):
    first = found["plain"][0]
    assert first.path == "docs/deploy.md" and first.lanes == "bm25+dense+path" and first.cosine > 0.5
    auth = found["auth"]
    assert [r.doc_id for r in auth[:2]] == [1, 1] and auth[0].parent_text == "whole auth"
    assert len({r.id for r in auth}) == len(auth) and found["empty"] == found["none"] == []


def test_scopes(found):
    assert {r.path for r in found["wiki"]} == {r.path for r in found["notion"]} == {r.path for r in found["sre"]} == {"wiki/oncall.md"}
    assert found["nowhere"] == [] and {r.path for r in found["docs"]} <= {"docs/deploy.md", "docs/auth.md"} and found["docs"]


def test_stored_index_gives_the_same(spark, corpus):
    texts = corpus.chunks.dropDuplicates(["id"]).select("id", "text")
    q = spark.createDataFrame([("q", "tokens rollback")], "qid string, q string")
    index = (lexical.postings(texts, "id", "text"), lexical.corpus_stats(texts, "text"))
    assert sorted(lexical.bm25(texts, "id", "text", q, "qid", "q", 5).collect()) == sorted(lexical.bm25(texts, "id", "text", q, "qid", "q", 5, index=index).collect())


def test_answers(spark, corpus):
    q = spark.createDataFrame([("q", "rollback"), ("none", "zebra")], "qid string, query string")
    h = search(corpus, q, "qid", "query", NOW)
    got = {r.qid: r.answer for r in A.answers(h, q, "qid", "query", A.EchoModel).collect()}
    assert got["q"].endswith("[1]") and got["none"] == conversation.REFUSAL


def test_model_json():
    assert A.retrieval_plan('x {"standalone": "s", "sub_queries": ["a", "b", "c"], "hypothetical": "h"} y', "q") == {"standalone": "s", "sub_queries": ["a", "b"], "hypothetical": "h"}
    assert A.retrieval_plan("nothing", "q")["standalone"] == "q"
    assert A.judged('{"grounded": 7, "complete": -1}') == {"grounded": 1.0, "complete": 0.0, "judged": True} and not A.judged("none")["judged"]
    assert A.memories_in('Sure: ["likes tea", "x", 3]') == ["likes tea"] and A.memories_in("none") == []


@pytest.mark.parametrize("question, want", [("who calls core.emit?", ("emit", True)), ("Where is parse_filters defined?", ("parse_filters", True)), ("who calls the shots", ("", False)), ("ai gọi emit?", ("emit", False)), ("hello", ("", False)), ("Where does the_cache get used?", ("the_cache", True)), ("callers of `Store.put`.", ("put", True)), ("biến max_rows được định nghĩa ở đâu", ("max_rows", True)), ("where is everything", ("", False))])
def test_symbol_questions(question, want):
    assert A.symbol_question(question) == want


def test_filter_grammar_in_a_batch_equals_it_row_by_row(spark):
    from skarnwell.operators import fusion
    from skarnwell.plans.retrieval import HARD

    queries = [*HARD, "tab\tsource:a\nsource:b  x", "é:a éa:b", 'a:"" b:"x', "FOLDER:X Type:Y type:z"]
    rows = spark.createDataFrame([(k, q) for k, q in enumerate([*queries, None])], "n int, q string")
    got = {r.n: r for r in fusion.with_filters(rows, "q").collect()}
    for k, q in enumerate(queries):
        text, f = fusion.parse_filters(q)
        assert (got[k].text, got[k].folder, got[k].source, got[k].meta) == (text, f.folder, f.source, f.meta), q
    assert got[len(queries)].text is None
    for q, (text, folder, source, meta) in HARD.items():
        t, f = fusion.parse_filters(q)
        assert (t, f.folder, f.source, ";".join(f"{k}={v}" for k, v in f.meta.items())) == (text, folder, source, meta)


def test_search_by_cells(spark):
    """Clusters of different density, one with a third of the vectors: recall, and cells that are divided give the same."""
    import numpy as np

    from skarnwell.operators import approximate as P

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 32))
    x = np.concatenate([centres[rng.integers(0, 60, 4000)] + 0.4 * rng.standard_normal((4000, 32)), centres[0] + 0.2 * rng.standard_normal((2000, 32))]).astype(np.float32)
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)] + [(None, x[0].tolist()), (9999, None), (9998, [0.0] * 32)], "k long, v array<float>")
    q = v.filter("k % 50 = 0").select(F.col("k").alias("q"), F.col("v").alias("qv"))
    exact = {(r.q, r.k) for r in P.search(v, "k", "v", q, "q", "qv", 32, 10).collect()}
    near = {(r.q, r.k) for r in P.search(v, "k", "v", q, "q", "qv", 32, 10, exact_rows=100, cells=100).collect()}
    split = {(r.q, r.k) for r in P.search(v, "k", "v", q, "q", "qv", 32, 10, exact_rows=100, cells=100, cell_rows=50).collect()}
    assert len(exact) == 1200 and len(exact & near) >= 0.95 * len(exact) and near == split
    assert P.backend(10) == "exact" and P.backend(10**7) == "cells" and P.backend(10**7, scoped=True) == "exact"


def test_stored_index_of_a_catalog(spark, tmp_path):
    from skarnwell import ingest
    from skarnwell.indexes import indexed_corpus
    from skarnwell.store import Catalog

    cat = Catalog(spark, str(tmp_path / "cat"))
    assert indexed_corpus(cat).index is None
    found = spark.createDataFrame([("a", "red fox rate_limit", 1.0), ("b", "rate of the limit", 1.0)], "path string, text string, mtime double")
    ingest.index(cat, found, "s", embed.HashingEmbedder(8))
    c = indexed_corpus(cat)
    q = spark.createDataFrame([("q", "rate_limit"), ("r", "limit")], "qid string, query string")
    hits = lambda corpus: sorted((r.qid, r.path, r.score) for r in search(corpus, q, "qid", "query", NOW).collect())
    with_index, without = hits(c), hits(Corpus(c.documents, c.chunks, c.parents))
    assert with_index == without and [(a, b) for a, b, _ in with_index] == [("q", "a"), ("r", "a"), ("r", "b")]
    assert cat.vacuum() == [] and indexed_corpus(cat).index is not None
