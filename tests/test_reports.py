import json

import numpy as np
from pyspark.sql import functions as F

from skarnwell import reports
from skarnwell.functions import text as T
from skarnwell.operators import analytics, conversation, embed, lexical, rerank
from skarnwell.sources import files, services
from skarnwell.streaming.progress import Progress


def test_providers():
    assert embed.prompts("onnx:intfloat/Multilingual-E5-small") == ("query: ", "passage: ") and embed.prompts("other") == ("", "")
    v = embed.mean_pool(np.array([[[3.0, 4.0], [9.0, 9.0]], [[1.0, 0.0], [0.0, 1.0]]]), np.array([[1, 0], [1, 1]]))
    assert np.allclose(v, [[0.6, 0.8], [0.5**0.5, 0.5**0.5]])
    assert rerank.label("onnx:owner/small-model") == "small-model" and rerank.label("lexical") == "lexical"
    assert rerank.JaccardReranker().score([("the red fox", "a red hen"), ("", "")]) == [1 / 3, 0.0]


def test_model_rerank(spark):
    rows = spark.createDataFrame([("q", 1, "red fox", "blue"), ("q", 2, "red fox", "red fox"), ("q", 3, "red fox", None), ("q", 4, "red fox", "blue")], "qid string, rank int, question string, text string")
    got = {r.rank: (r.reranked, r.relevance) for r in rerank.model_rerank(rows, "qid", F.col("question"), F.col("text"), rerank.JaccardReranker, batch=2).collect()}
    assert got == {2: (1, 1.0), 1: (2, 0.0), 3: (3, 0.0), 4: (4, 0.0)}
    assert rerank.model_rerank(rows.limit(0), "qid", F.col("question"), F.col("text"), rerank.JaccardReranker).count() == 0


def test_containing(spark):
    d = spark.createDataFrame([(1, "docs/deploy.md"), (2, "wiki/oncall"), (3, "ab"), (4, None)], "k long, path string")
    w = spark.createDataFrame([("deploy",), ("ploy",), ("xyz",), ("all",), ("ab",)], "w string")
    assert sorted(map(tuple, lexical.containing(d, "k", "path", w, "w").collect())) == [(1, "deploy"), (1, "ploy"), (2, "all")]


def test_symbols(spark):
    sites = spark.createDataFrame([("definition", "a.py", 3, "def emit():"), ("call", "b.py", 5, "emit(1)"), ("mention", "c.md", 1, "see emit"), ("mention", "c.md", 2, "emit")], "kind string, path string, line long, text string")
    texts = spark.createDataFrame([("a.py", "x\n\n\n\ndef   emit():\n"), ("b.py", "nothing")], "path string, body string")
    moved = {(r.path, r.line) for r in reports.reanchored(sites, texts).collect()}
    assert moved == {("a.py", 5), ("b.py", 5), ("c.md", 1), ("c.md", 2)}
    answer = reports.symbol_answer(sites, "emit").first().answer
    assert answer == "`emit` — 1 definition(s), 1 call site(s).\n\nDefined in:\n- a.py:3 — `def emit():` [1]\n\nCalled from:\n- b.py:5 — `emit(1)` [2]\n\nAlso mentioned in: c.md (2×)."
    assert reports.symbol_answer(sites.filter("kind = 'mention'"), "emit").count() == 0


def test_reports(spark):
    skipped = spark.createDataFrame([(f"p{k:02d}", "size" if k % 2 else "kind") for k in range(30)], "path string, reason string")
    got = {r.reason: (r["files"], len(r["sample"])) for r in reports.skip_sample(skipped).collect()}
    assert got == {"size": (15, 6), "kind": (15, 6)}
    hit = spark.createDataFrame([("p", 1, 0, 0.123456, 0.98765, "bm25", "t")], "path string, line int, ordinal int, score double, cosine double, lanes string, text string")
    assert json.loads(hit.select(reports.hits_json(hit)).first()[0]) == {"path": "p", "line": 1, "ordinal": 0, "score": 0.1235, "cosine": 0.988, "lanes": "bm25", "text": "t"}
    assert reports.stats_line({"new": 2, "changed": 1}) == "changed=1 new=2"
    points = reports.topic_points(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(4)], "k long, v array<double>"), "k", "v").collect()
    assert all(abs(p.y) < 1e-9 for p in points) and len({round(p.x, 6) for p in points}) == 4
    empty = spark.createDataFrame([], "grounded_ratio double, citation_valid boolean, judge_ratio double")
    assert reports.answer_quality(empty).first().answers == 0


def test_questions_and_prompts(spark):
    q = spark.createDataFrame([("draw the flowcharts",), ("a paragraph on drawbacks",), ("vẽ sơ đồ",), (None,)], "q string")
    assert [r[0] for r in q.select(T.wants_diagram(F.col("q"))).collect()] == [True, False, True, None]
    assert [r[0] for r in q.select(conversation.needs_plan(F.col("q"), F.lit(False), True)).collect()][:2] == [True, True]
    asked = spark.createDataFrame([(1, "how?")], "id int, question string")
    turns = spark.createDataFrame([(1, 1, "user", "x" * 500)], "id int, pos int, role string, text string")
    prompt = conversation.plan_prompts(asked, "id", "question", turns).first().prompt
    assert prompt.endswith("user: " + "x" * 300 + "\n\nQuestion: how?")
    hits = spark.createDataFrame([(1, 1, "p", "text", "draw it")], "id int, place int, path string, text string, question string")
    memory = spark.createDataFrame([(1, 1, "likes tea")], "id int, rank int, text string")
    fixes = spark.createDataFrame([(1, "q" * 300, "a" * 900)], "id int, question string, answer string")
    full = conversation.prompt(hits, "id", "question", before=conversation.notes("id", memory, fixes), diagrams=True, length="short").first().prompt
    assert full.split("\n\n") == ["Known about the reader:\n- likes tea", "Corrected answer to '" + "q" * 200 + "': " + "a" * 800, "Answer with a diagram in text form.", "Answer in two sentences.", "[1] p\ntext", "Question: draw it"]


def test_services(spark):
    rich = lambda *t: {"rich_text": [{"plain_text": x} for x in t]}
    top = {"results": [
        {"id": "a", "type": "heading_2", "heading_2": rich("Head")}, {"id": "b", "type": "toggle", "has_children": True, "toggle": rich("open")}, {"id": "c", "type": "to_do", "to_do": rich("do") | {"checked": True}},
        {"id": "d", "type": "code", "code": rich("x = 1") | {"language": "py"}}, {"id": "e", "type": "table_row", "table_row": {"cells": [[{"plain_text": "1"}], [{"plain_text": "2"}]]}},
        {"id": "f", "type": "child_page", "has_children": True, "child_page": {"title": "Sub"}}, {"id": "g", "type": "divider"}, {"id": "h", "type": "paragraph", "paragraph": rich(" ")},
    ]}
    inner = {"results": [{"id": "i", "type": "bulleted_list_item", "bulleted_list_item": rich("in", "side")}]}
    hidden = {"results": [{"id": "j", "type": "paragraph", "paragraph": rich("of the child page")}]}
    p = spark.createDataFrame([("p", "p", 1, json.dumps(top)), ("p", "b", 1, json.dumps(inner)), ("p", "f", 1, json.dumps(hidden)), ("bad", "bad", 1, "{broken")], "page string, parent string, response int, body string")
    pages = {r.page: r.text for r in services.notion_pages(services.notion_blocks(p, "page", "body"), "page").collect()}
    assert pages == {"p": "## Head\n\nopen\n[x] do\n```py\nx = 1\n```\n1 | 2\n\n# Sub\n\n- inside"}
    dump = spark.createDataFrame([("head==\nFirst\n<p>a &amp; b</p>==\n\n<div>x</div>==only title==",)], "d string")
    assert sorted(map(tuple, services.notes_dump(dump, "d", "==").collect())) == [("<div>x</div>", "")][:0] + [("First", "a & b")]
    listing = [("root", {"value": [{"id": "1", "name": "b.txt", "file": {}, "size": 3}, {"id": "2", "name": "sub", "folder": {}}, {"id": "9", "name": "x"}]}), ("2", {"value": [{"id": "3", "name": "a.txt", "file": {}}]})]
    items = services.drive_items(spark.createDataFrame([(f, json.dumps(j)) for f, j in listing], "folder string, body string"), "folder", "body")
    assert [r.path for r in services.walk(items, "root").collect()] == ["b.txt", "sub/a.txt"] and services.walk(items, "root", most_items=1).count() == 1
    pages = spark.createDataFrame([(json.dumps({"results": [{"id": "7", "title": "T", "space": {"key": "S"}, "body": {"storage": {"value": "<p>x</p>"}}}], "_links": {"next": "/n"}}),), ('{"next_cursor": "c", "has_more": false}',)], "body string")
    assert services.confluence_pages(pages, "body", "confluence://h/").first().path == "confluence://h/S/7"
    assert [r[0] for r in pages.select(services.next_link(F.col("body"))).collect()] == ["/n", None]
    mimes = spark.createDataFrame([("application/vnd.google-apps.spreadsheet",), ("text/markdown",), ("video/mp4",)], "m string")
    assert [r[0] for r in mimes.select(services.export_type(F.col("m"))).collect()] == ["text/csv", "text/markdown", None]


def test_files(spark):
    f = spark.createDataFrame([("/r/a.py", 5), ("/r/.git/x.py", 5), ("/r/.env", 5), ("/r/x.bin", 5), ("/r/big.md", 2_000_000), ("/r/Makefile", 5)], "path string, length long")
    assert [r[0] for r in f.select(files.skip_reason(F.col("path"), F.col("length"), "/r")).collect()] == [None, "folder", "hidden", "kind", "size", None]
    n = spark.createDataFrame([("v/n.md", "---\naliases: [One, two]\n---\nbody"), ("v/m.md", "plain")], "path string, text string")
    assert sorted(r.text[:24] for r in files.with_aliases(files.obsidian_notes(n)).collect()) == ["Also known as: One, two\n", "plain"]
    assert [r.root for r in files.vaults(spark.createDataFrame([("/x/v/.obsidian/app.json",), ("/x/y.md",)], "path string")).collect()] == ["/x/v"]
    a = spark.createDataFrame([("p", b"one"), ("q", b"two")], "path string, content binary")
    seen = files.new_archives(a, spark.createDataFrame([], "path string, archive_hash string")).select("path", "archive_hash")
    assert seen.count() == 2 and files.new_archives(a, seen).count() == 0


def test_text_helpers(spark):
    t = spark.createDataFrame([("&lt;a&gt; &amp;lt; caf&eacute; &#8212; &nbsp;x",), ("x &amp;amp; y",), (None,)], "t string")
    assert [r[0] for r in t.select(T.unescape(F.col("t"))).collect()] == ["<a> &lt; café —  x", "x &amp; y", None]
    j = spark.createDataFrame([('{"a": "1"}',), ("nope",), (None,)], "j string")
    assert [r[0] for r in j.select(T.json_map(F.col("j"))).collect()] == [{"a": "1"}, {}, {}]
    m = spark.createDataFrame([(k, 1, "user" if k % 70_000 == 0 else "assistant", f"t{k}") for k in range(0, 200_000, 10_000)], "id long, chat_id long, role string, text string")
    got = {r.id: r.question for r in conversation.previous_question(m).collect()}
    assert got[0] is None and got[60_000] == "t0" and got[140_000] == "t70000" and got[190_000] == "t140000"  # across segments of ids


def test_duplicates_with_common_lines(spark):
    """Lines that all documents have do not make pairs, and the rarest ones find all that there are."""
    import itertools
    import random

    rng = random.Random(2)
    docs = {k: {"licence", "header"} | {f"l{rng.randrange(60)}" for _ in range(rng.randint(1, 9))} for k in range(120)}
    rows = spark.createDataFrame([(k, x) for k, lines in docs.items() for x in lines], "doc_id long, text string")
    got = {(r.a, r.b): (r.shared, r.ratio) for r in analytics.shared_digests(rows, rows.select("doc_id").distinct()).collect()}
    first = {}
    for k, lines in docs.items():
        first.setdefault(frozenset(lines), k)
    want = {}
    for a, b in itertools.combinations(sorted(docs), 2):
        n, m = len(docs[a] & docs[b]), min(len(docs[a]), len(docs[b]))
        star = docs[a] == docs[b] and first[frozenset(docs[a])] == a
        reps = first[frozenset(docs[a])] == a and first[frozenset(docs[b])] == b
        if n >= 3 and n / m >= 0.5 and (star or reps and docs[a] != docs[b]):
            want[a, b] = n, round(n / m, 3)
    assert got == want and len(want) > 50


def test_progress(spark, tmp_path):
    import time

    listener = Progress()
    spark.streams.addListener(listener)
    try:
        q = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path)).start()
        until = time.time() + 60
        while time.time() < until and not any(p["batch"] >= 0 for p in list(listener.active.values())):
            time.sleep(0.5)
        assert any(p["batch"] >= 0 for p in list(listener.active.values()))
        q.stop()
    finally:
        spark.streams.removeListener(listener)
