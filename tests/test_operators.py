import math

import pytest
from pyspark.sql import functions as F

from skarnwell.operators import analytics, chunking, components, conversation, dense, embed, evaluate, fusion, lexical


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_chunker_limits_and_overlap():
    text = "\n\n".join(f"paragraph {i} " + "x" * 200 for i in range(10))
    got = chunking.chunk_text(text, 300, 50)
    assert all(len(c) <= 300 for _, c, _ in got)
    words = " ".join(f"word{i:03d}" for i in range(400))
    assert all(c.startswith("word") for _, c, _ in chunking.chunk_text(words, 150, 40))
    with pytest.raises(ValueError):
        chunking.chunk_text("x", 10, 10)
    assert any(line == 3 for _, _, line in chunking.chunk_text("head\n\n" + "a" * 120 + "\n\n" + "b" * 120, 100, 10))
    assert chunking.chunk_text("") == []


def test_chunker_prefers_sentences():
    text = "Đây là một câu tiếng Việt đủ dài để kiểm tra ranh giới câu. " * 60
    got = [c for _, c, _ in chunking.chunk_text(text, 200, 40)]
    assert all(c.endswith(".") for c in got[:-1])


def test_chunked_and_parents(spark):
    docs = spark.createDataFrame([(1, "\n\n".join("word " * 100 for _ in range(12))), (2, ""), (3, None)], "doc_id long, text string")
    c = chunking.chunked(docs, "doc_id", "text", 600, 50, 1000)
    p = chunking.parents(c, "doc_id")
    assert p.count() >= 2 and {r.doc_id for r in c.collect()} == {1}
    assert p.agg(F.max(F.length("text"))).first()[0] > c.agg(F.max(F.length("text"))).first()[0]


def test_bm25_matches_a_plain_version(spark):
    texts = {1: "tax law tax", 2: "law court", 3: "tax", 4: ""}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    q = spark.createDataFrame([("a", "Tax law"), ("b", "zebra"), ("c", None)], "qid string, q string")
    got = {(r.qid, r.id): r.score for r in lexical.bm25(df, "id", "text", q, "qid", "q", 10).collect()}
    n, avg = 4, 6 / 4

    def score(doc, terms):
        words = texts[doc].split()
        s = 0
        for t in terms:
            d = sum(t in x.split() for x in texts.values())
            idf = max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6)
            f = words.count(t)
            s += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / avg))
        return round(s, 9)

    assert got == {("a", d): pytest.approx(score(d, ["tax", "law"]), abs=1e-9) for d in (1, 2, 3)}


def test_phrase_counts_touching_occurrences(spark):
    df = spark.createDataFrame([(1, "a b a b a"), (2, "b a"), (3, "ab")], "id long, text string")
    assert [r[0] for r in rows(lexical.phrase(df, "id", "text", ["a", "b"], 5), "rank")] == [1]


def test_dense_topk_with_ties_scope_and_bad_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, None)], "k long, v array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "q string, qv array<float>")
    assert rows(dense.dense_topk(v, "k", "v", q, "q", "qv", 2, 2), "rank") == [("q", 1, 1.0, 1), ("q", 2, 1.0, 2)]
    scope = spark.createDataFrame([("q", 3), ("q", 2)], "q string, k long")
    assert [r[1] for r in rows(dense.dense_topk(v, "k", "v", q, "q", "qv", 2, 5, scope=scope), "rank")] == [2, 3]
    assert dense.dense_topk(v.limit(0), "k", "v", q, "q", "qv", 2, 2).count() == 0


def test_filters(spark):
    text, f = fusion.parse_filters('folder:Financial mã số thuế status:draft see http://x.y/z source:"a b"')
    assert (text, f.folder, f.source, f.meta) == ("mã số thuế see http://x.y/z", "Financial", "a b", {"status": "draft"})
    q = spark.createDataFrame([('folder:Financial mã số thuế status:Draft see http://x.y/z source:"a b"',), ("plain",)], "q string")
    r = fusion.with_filters(q, "q").collect()
    assert (r[0].text, r[0].folder, r[0].source, r[0].meta) == ("mã số thuế see http://x.y/z", "Financial", "a b", {"status": "Draft"})
    assert (r[1].text, r[1].folder, r[1].meta) == ("plain", None, {})


def test_factors(spark):
    df = spark.createDataFrame([({"authority": "Canonical"},), ({"status": "draft"},), ({"authority": "official", "status": "wip"},), (None,)], "m map<string,string>")
    assert [round(r[0], 4) for r in df.select(fusion.metadata_factor(F.col("m"))).collect()] == [1.05, 0.9, 0.945, 1.0]
    now = 1e9
    t = spark.createDataFrame([(now,), (now - 45 * 86400,), (now - 365 * 86400,), (0.0,), (None,), (now + 99,)], "t double")
    a, b, c, d, e, f = (r[0] for r in t.select(fusion.recency_factor(F.col("t"), F.lit(now))).collect())
    assert a > 1.09 and 1.03 < b < 1.05 and c < 1.01 and d == e == 1.0 and f == a


def test_rrf_and_diversify(spark):
    lane = lambda xs: spark.createDataFrame([("q", x, n + 1) for n, x in enumerate(xs)], "q string, id long, rank long")
    got = rows(fusion.rrf([("a", lane([1, 2])), ("b", lane([2, 3]))], "q", "id"), F.desc("fused"))
    assert [(r[1], r[3]) for r in got] == [(2, "a+b"), (1, "a"), (3, "b")]
    assert got[0][2] == pytest.approx(1 / 62 + 1 / 61)
    hits = spark.createDataFrame([("q", d, n + 1) for n, d in enumerate([1, 1, 1, 2, 2])], "q string, doc long, rank long")
    assert [r.rank for r in fusion.diversify(hits, "q", "doc", 4).orderBy("place").collect()] == [1, 2, 4, 5]
    one = spark.createDataFrame([("q", 1, n + 1) for n in range(5)], "q string, doc long, rank long")
    assert [r.rank for r in fusion.diversify(one, "q", "doc", 3).orderBy("place").collect()] == [1, 2, 3]


def test_metrics_and_gate(spark):
    g = spark.createDataFrame([(1, "x", ["a.md"]), (2, None, ["b.md", "c.md"]), (3, "x", None)], "q long, category string, relevant array<string>")
    d = spark.createDataFrame([(1, "docs/a.md", 1), (2, "z.md", 1), (2, "b.md", 2)], "q long, path string, rank long")
    m = evaluate.metrics(g, d, "q")
    got = {r.q: (r.recall, r.mrr) for r in m.collect()}
    assert got == {1: (1.0, 1.0), 2: (0.5, 0.5), 3: (0.0, 0.0)}
    s = evaluate.by_category(m)
    assert {(r.category, r.level, r.queries) for r in s.collect()} == {("x", 0, 2), ("(none)", 0, 1), (None, 1, 3)}
    evaluate.gate(s, 0.4)
    with pytest.raises(evaluate.GateFailed):
        evaluate.gate(s, 0.4, {"x": 0.9})


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(rows(components.connected_components(e), "node"))
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}
    assert components.connected_components(e.limit(0)).count() == 0


def test_duplicates_and_symbols(spark):
    doc = spark.createDataFrame([(1, "a.md"), (2, "b.md"), (3, "core.py"), (4, "app.py"), (5, "notes.md")], "doc_id long, path string")
    c = spark.createDataFrame(
        [(d, i, f"text {i}", 1) for d in (1, 2) for i in range(4)] + [(3, 0, "x = 1\ndef emit(x):\n  pass", 10), (4, 0, "emit(1)\ny = emit(2)", None), (5, 0, "we emit things", 0)],
        "doc_id long, ordinal int, text string, line_start int",
    )
    assert rows(analytics.duplicate_clusters(c, doc), "doc_id") == [(1, 1, 4, 1.0), (1, 2, 4, 1.0)]
    got = [(r.kind, r.path, r.line) for r in analytics.symbol_sites(c, doc, "emit").collect()]
    assert got == [("definition", "core.py", 11), ("call", "app.py", 1), ("call", "app.py", 2), ("mention", "notes.md", 1)]


def test_conversation(spark):
    m = spark.createDataFrame(
        [(1, 1, "user", "Q1", 0, 1), (2, 1, "assistant", "no", -1, 2), (3, 1, "user", " q1 ", 0, 3), (4, 1, "assistant", "yes", 1, 4), (5, 2, "assistant", "x", 1, 5)],
        "id long, chat_id long, role string, text string, feedback int, t int",
    ).withColumn("created_at", F.timestamp_seconds("t"))
    assert [r.question for r in conversation.previous_question(m).orderBy("id").collect()] == [None, "Q1", "Q1", " q1 ", None]
    r = conversation.refusals(m, F.col("feedback") < 0).collect()
    assert [(x.question, x["count"], x.resolved) for x in r] == [("Q1", 1, True)]
    assert [x.text for x in conversation.recent_turns(m, 1).filter("chat_id = 1").orderBy("pos").collect()] == [" q1 ", "yes"]


def test_caches(spark):
    c = spark.createDataFrame([("a", "f", [1.0, 0.0], 1), ("b", "f", [0.99, 0.01], 2), ("c", "g", [1.0, 0.0], 3), ("d", "f", None, 4)], "cache_key string, fingerprint string, embedding array<float>, t int").withColumn("created_at", F.timestamp_seconds("t"))
    q = spark.createDataFrame([("q", "f", [0.0, 1.0]), ("r", "f", [1.0, 0.0])], "q string, fingerprint string, v array<float>")
    assert [(r.q, r.cache_key) for r in conversation.cache_nearest(c, q, "q", "v", 2).collect()] == [("r", "a")]
    new = c.filter("cache_key = 'a'").withColumn("created_at", F.timestamp_seconds(F.lit(9)))
    assert [r.cache_key for r in conversation.cache_put(c, new, "cache_key", 2).orderBy("cache_key").collect()] == ["a", "d"]


def test_embedder_and_cache(spark):
    e = embed.HashingEmbedder()  # in few dimensions two words can cancel
    df = spark.createDataFrame([(1, "tax law"), (2, "tax law"), (3, None), (4, "")], "id long, text string")
    out, new = embed.with_cache(df, "text", spark.createDataFrame([], "key string, embedding array<float>"), e)
    got = {r.id: r.embedding for r in out.collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[3] is None and sum(got[4]) == 0
    assert new.count() == 2 and embed.with_cache(df, "text", new, e)[1].count() == 0
    got = embed.embedded_topk(df.filter("id < 3"), "id", "text", df.filter("id < 3").withColumnRenamed("id", "q"), "q", "text", e, 1)
    assert [r.score for r in got.collect()] == [1.0, 1.0]


def test_topics(spark):
    v = spark.createDataFrame([(i, [1.0, 0.01 * i] if i < 3 else [0.01 * i, 1.0]) for i in range(5)], "k long, v array<float>")
    assert sorted((r.cluster, r.size, r.k) for r in analytics.topic_clusters(v, "k", "v").collect()) == [(0, 3, 0), (0, 3, 1), (0, 3, 2), (1, 2, 3), (1, 2, 4)]
