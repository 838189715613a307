"""Registered queries on retrieval: lanes, fusion, reranking, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarnwell.durable import together
from skarnwell.functions import text as T
from skarnwell.operators import approximate, dense, embed, evaluate, fusion, lexical
from skarnwell.plans.base import CH, DIM, GOLDEN, INDEX, NOW, QUESTIONS, chunks, documents, golden, query, questions, sql_bm25, sql_dense, sql_path, sql_tokens, table

POOL = 50


@query(f"SELECT doc_id, strip_accents(replace(lower(text), 'đ', 'd')) AS folded FROM documents")
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(f"WITH {CH}, t AS (SELECT unnest({sql_tokens('text')}) AS term FROM ch) SELECT term, count(*) AS n FROM t GROUP BY term")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "text").select(F.explode(T.index_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {CH} SELECT id, len({sql_tokens('text')}) AS dl FROM ch")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "text").select("id", F.size(T.index_tokens(F.col("text"))).cast("long").alias("dl"))


@query(f"WITH {CH}, l AS (SELECT len({sql_tokens('text')}) AS dl FROM ch) SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM l")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.corpus_stats(chunks(spark, d, "text"), "text").select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {CH}, {INDEX}, {QUESTIONS}, {sql_bm25('lane', 'questions', 'cache_key', 'question', 10)} SELECT cache_key, id, score, rank FROM lane")
def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(chunks(spark, d, "text"), "id", "text", questions(spark, d), "cache_key", "question", 10)


@query(f"WITH {CH}, {INDEX}, {GOLDEN}, {sql_bm25('lane', 'golden', 'query_id', 'text', 10)} SELECT query_id, id, score, rank FROM lane")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(chunks(spark, d, "text"), "id", "text", golden(spark, d), "query_id", "text", 10)


def _scope(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, id): chunks in the folder that a golden query names."""
    g = golden(spark, d).select("query_id", F.lower("folder").alias("folder"))
    folders = g.select("folder").distinct()
    docs = documents(spark, d).select("doc_id", F.lower("path").alias("path")).join(folders, F.expr("contains(path, folder)")).select("doc_id", "folder")
    return docs.join(g, "folder").join(chunks(spark, d, "doc_id"), "doc_id").select("query_id", "id")


SCOPE = "JOIN ch ON ch.id = tf.id JOIN documents d ON d.doc_id = ch.doc_id JOIN golden g ON g.query_id = q.query_id AND contains(lower(d.path), lower(g.folder))"


@query(f"WITH {CH}, {INDEX}, {GOLDEN}, {sql_bm25('lane', 'golden', 'query_id', 'text', 10, SCOPE)} SELECT query_id, id, score, rank FROM lane")
def bm25_scoped(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(chunks(spark, d, "text"), "id", "text", golden(spark, d), "query_id", "text", 10, scope=_scope(spark, d))


@query(
    f"""WITH {CH}, t AS (SELECT id, {sql_tokens('text')} AS t FROM ch), h AS (SELECT id, len(t) AS dl, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS tf FROM t),
    s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (tf > 0) AS df FROM h),
    r AS (SELECT id, round(greatest(ln((n - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)), 9) AS score FROM h, s WHERE tf > 0)
    SELECT * FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 20"""
)
def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    return lexical.phrase(chunks(spark, d, "text"), "id", "text", ["of", "the"], 20)


@query(f"WITH {CH}, {QUESTIONS}, {sql_dense('lane', 'questions', 'cache_key', 'embedding', 10)} SELECT cache_key, id, score, rank FROM lane")
def dense_batch(spark: SparkSession, d: str) -> DataFrame:
    return dense.dense_topk(chunks(spark, d, "embedding"), "id", "embedding", questions(spark, d), "cache_key", "embedding", DIM, 10)


@query(f"WITH {CH}, {QUESTIONS}, {sql_dense('lane', 'questions', 'cache_key', 'embedding', 10)} SELECT cache_key, id, score, rank FROM lane")
def dense_policy(spark: SparkSession, d: str) -> DataFrame:
    """The dense lane as the policy chooses it: exact up to 200,000 vectors, by cells beyond."""
    return approximate.search(chunks(spark, d, "embedding"), "id", "embedding", questions(spark, d), "cache_key", "embedding", DIM, 10)


VEC = "vec AS (SELECT vec_id, embedding, label FROM embeddings), probes AS (SELECT vec_id AS probe, embedding AS pv, label AS pl FROM embeddings WHERE vec_id % 20 = 0)"


@query(f"WITH {VEC}, {sql_dense('lane', 'probes', 'probe', 'pv', 10, 'vec', 'vec_id')} SELECT probe, vec_id, score, rank FROM lane")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    probes = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("pv"))
    return dense.dense_topk(v, "vec_id", "embedding", probes, "probe", "pv", DIM, 10)


@query(
    f"""WITH {VEC}, s AS (SELECT p.probe, c.vec_id, round(list_cosine_similarity(p.pv::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM probes p JOIN vec c ON c.label = p.pl)
    SELECT * FROM (SELECT probe, vec_id, score, row_number() OVER (PARTITION BY probe ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
)
def dense_topk_scoped(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    probes = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("pv"), F.col("label").alias("pl"))
    return dense.dense_topk(v, "vec_id", "embedding", probes, "probe", "pv", DIM, 5, group=("label", "pl"))


@query(f"WITH {CH}, {QUESTIONS}, {sql_path('lane', 'questions', 'cache_key', 'question', 20)} SELECT cache_key, id, score, rank FROM lane")
def path_lane(spark: SparkSession, d: str) -> DataFrame:
    return lexical.path_lane(chunks(spark, d, "doc_id", "ordinal"), documents(spark, d), questions(spark, d), "cache_key", "question", 20)


LANES = f"{CH}, {INDEX}, {QUESTIONS}, {sql_bm25('l0', 'questions', 'cache_key', 'question', POOL)}, {sql_dense('l1', 'questions', 'cache_key', 'embedding', POOL)}, {sql_path('l2', 'questions', 'cache_key', 'question', POOL)}"


def sql_rrf(weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> str:
    w = [f"coalesce({x!r}::DOUBLE / (60 + r{n}), 0)" for n, x in enumerate(weights)]
    return f"""wide AS (SELECT cache_key, id, min(rank) FILTER (lane = 0) AS r0, min(rank) FILTER (lane = 1) AS r1, min(rank) FILTER (lane = 2) AS r2
  FROM (SELECT cache_key, id, rank, 0 AS lane FROM l0 UNION ALL SELECT cache_key, id, rank, 1 FROM l1 UNION ALL SELECT cache_key, id, rank, 2 FROM l2) GROUP BY cache_key, id),
fused AS (SELECT cache_key, id, round({' + '.join(w)}, 12) AS fused, concat_ws('+', CASE WHEN r0 IS NOT NULL THEN 'bm25' END, CASE WHEN r1 IS NOT NULL THEN 'dense' END, CASE WHEN r2 IS NOT NULL THEN 'path' END) AS lanes,
  CASE WHEN r0 IS NOT NULL THEN 0 WHEN r1 IS NOT NULL THEN 1 ELSE 2 END AS first_lane, coalesce(r0, r1, r2) AS first_rank FROM wide)"""


def _lanes(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    q = questions(spark, d)
    made = together(
        spark,
        lambda: lexical.bm25(chunks(spark, d, "text"), "id", "text", q, "cache_key", "question", POOL),
        lambda: dense.dense_topk(chunks(spark, d, "embedding"), "id", "embedding", q, "cache_key", "embedding", DIM, POOL),
        lambda: lexical.path_lane(chunks(spark, d, "doc_id", "ordinal"), documents(spark, d), q, "cache_key", "question", POOL),
    )
    return list(zip(("bm25", "dense", "path"), made, strict=True))


@query(f"WITH {LANES}, {sql_rrf()} SELECT cache_key, id, round(fused, 9) AS fused, lanes, first_rank FROM fused")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_lanes(spark, d), "cache_key", "id").select("cache_key", "id", F.round("fused", 9).alias("fused"), "lanes", "first_rank")


@query(f"WITH {LANES}, {sql_rrf((0.6, 0.9, 1.2))} SELECT cache_key, id, round(fused, 9) AS fused FROM fused")
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_lanes(spark, d), "cache_key", "id", {"bm25": 0.6, "dense": 0.9, "path": 1.2}).select("cache_key", "id", F.round("fused", 9).alias("fused"))


@query(f"WITH {LANES}, {sql_rrf()} SELECT lanes, count(*) AS n FROM fused GROUP BY lanes")
def lane_membership(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_lanes(spark, d), "cache_key", "id").groupBy("lanes").agg(F.count("*").alias("n"))


RECENCY = f"CASE WHEN coalesce(mtime, 0) <= 0 THEN 1.0e0 ELSE 1 + 0.1e0 * exp(-greatest(0.0e0, ({NOW!r}::DOUBLE - mtime) / 86400.0e0) / 45.0e0) END"


def _in(key: str, values: tuple) -> str:
    return f"lower(trim(coalesce(metadata['{key}'], ''))) IN ({', '.join(repr(v) for v in values)})"


METADATA = f"CASE WHEN {_in('authority', fusion.CANONICAL)} THEN 1.05e0 ELSE 1.0e0 END * CASE WHEN {_in('status', fusion.DRAFT)} THEN 0.9e0 ELSE 1.0e0 END"


@query(f"SELECT doc_id, round({RECENCY}, 9) AS factor FROM documents")
def recency_factor(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.round(fusion.recency_factor(F.col("mtime"), F.lit(NOW)), 9).alias("factor"))


@query(f"SELECT doc_id, round({METADATA}, 6) AS factor FROM documents")
def metadata_factor(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.round(fusion.metadata_factor(F.col("metadata")), 6).alias("factor"))


HYBRID = f"""{LANES}, {sql_rrf()}, adj AS (SELECT f.*, ch.doc_id, ch.ordinal, ch.parent_ordinal, ch.line_start, ch.text, d.path, round(fused * ({RECENCY}) * ({METADATA}), 9) AS score FROM fused f JOIN ch USING (id) JOIN documents d ON d.doc_id = ch.doc_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY score DESC, first_lane, first_rank) AS rank FROM adj) WHERE rank <= 20)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.rrf(_lanes(spark, d), "cache_key", "id")
    return fusion.adjusted(fused, "cache_key", "id", chunks(spark, d, "doc_id", "ordinal", "parent_ordinal", "line_start"), documents(spark, d), NOW, 20)


@query(f"WITH {HYBRID} SELECT cache_key, id, path, score, lanes, rank FROM hits")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("cache_key", "id", "path", "score", "lanes", "rank")


DIVERSE = f"""{HYBRID}, div AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY nth > 2, rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cache_key, doc_id ORDER BY rank) AS nth FROM hits))"""


@query(f"WITH {DIVERSE} SELECT cache_key, id, doc_id, rank, place FROM div WHERE place <= 5")
def diversify(spark: SparkSession, d: str) -> DataFrame:
    return fusion.diversify(_hits(spark, d), "cache_key", "doc_id", 5).select("cache_key", "id", "doc_id", "rank", "place")


@query(f"""WITH {DIVERSE}, par AS (SELECT DISTINCT ON (doc_id, ordinal) doc_id, ordinal AS parent_ordinal, text AS parent_text FROM parents)
    SELECT cache_key, place, id, path, score, lanes, line_start AS line, div.text, coalesce(parent_text, '') AS parent_text FROM div LEFT JOIN par USING (doc_id, parent_ordinal) WHERE place <= 5""")
def retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: all lanes, fusion, adjustments, diversification, payload with the parent section; texts join last, for the few rows that are left."""
    top = fusion.diversify(_hits(spark, d), "cache_key", "doc_id", 5)
    rows = top.join(chunks(spark, d, "text"), "id")
    out = fusion.with_context(rows, table(spark, d, "parents"))
    return out.select("cache_key", "place", "id", "path", "score", "lanes", F.col("line_start").alias("line"), "text", "parent_text")


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def sql_plain(x: str) -> str:
    edge = "[.,;:!?()\\[\\]{}`''\"#*_-]+"
    return f"list_filter(list_transform(regexp_split_to_array(lower({x}), '[ \\t\\n\\r\\f\\x0b]+'), lambda w: regexp_replace(regexp_replace(w, '^{edge}', ''), '{edge}$', '')), lambda w: w <> '' AND w NOT IN ({STOP}))"


@query(f"""WITH {HYBRID}, r AS (SELECT h.cache_key, h.id, h.rank, len(list_intersect({sql_plain('q.question')}, {sql_plain('h.text')})) AS overlap FROM hits h JOIN questions q USING (cache_key))
    SELECT cache_key, id, rank, overlap, row_number() OVER (PARTITION BY cache_key ORDER BY overlap DESC, rank) AS reranked FROM r""")
def lexical_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = _hits(spark, d).select("cache_key", "id", "rank").join(chunks(spark, d, "text"), "id").join(questions(spark, d).select("cache_key", "question"), "cache_key")
    return fusion.lexical_rerank(rows, "cache_key", F.col("question"), F.col("text")).select("cache_key", "id", "rank", "overlap", "reranked")


def _ranked_docs(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.bm25(chunks(spark, d, "text"), "id", "text", golden(spark, d), "query_id", "text", POOL)
    paths = chunks(spark, d, "doc_id").join(documents(spark, d).select("doc_id", "path"), "doc_id")
    return evaluate.rank_documents(hits.join(paths, "id"), "query_id")


DOCS = f"""{CH}, {INDEX}, {GOLDEN}, {sql_bm25('lane', 'golden', 'query_id', 'text', POOL)}, firsts AS (SELECT query_id, path, min(rank) AS first_at FROM lane JOIN ch USING (id) JOIN documents USING (doc_id) GROUP BY query_id, path),
docs AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY first_at, path) AS rank FROM firsts)"""


@query(f"WITH {DOCS} SELECT query_id, path, rank FROM docs")
def rank_docs(spark: SparkSession, d: str) -> DataFrame:
    return _ranked_docs(spark, d)


METRICS = f"""{DOCS}, j AS (SELECT g.query_id, g.category, g.relevant, d.rank, coalesce(len(list_filter(g.relevant, lambda r: r = d.path OR suffix(d.path, r) OR suffix(r, d.path))) > 0, false) AS hit FROM golden g LEFT JOIN docs d ON d.query_id = g.query_id AND d.rank <= 10),
per AS (SELECT query_id, any_value(category) AS category, round(count(*) FILTER (hit AND rank <= 5) / greatest(len(any_value(relevant)), 1)::DOUBLE, 6) AS recall,
  round(sum(CASE WHEN hit THEN 1 / log2(rank + 1.0e0) ELSE 0 END) / list_sum(list_transform(range(1, greatest(least(len(any_value(relevant)), 10), 1) + 1), lambda i: 1 / log2(i + 1.0e0))), 6) AS ndcg,
  round(coalesce(1.0e0 / min(rank) FILTER (hit), 0), 6) AS mrr FROM j GROUP BY query_id)"""


@query(f"WITH {METRICS} SELECT query_id, category, recall, ndcg, mrr FROM per")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(golden(spark, d), _ranked_docs(spark, d), "query_id")


@query(f"WITH {METRICS}, c AS (SELECT coalesce(category, '(none)') AS category, recall, ndcg, mrr FROM per) SELECT category, grouping(category)::BIGINT AS level, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM c GROUP BY ROLLUP (category)")
def eval_by_category(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.by_category(evaluate.metrics(golden(spark, d), _ranked_docs(spark, d), "query_id"))


#: Queries that are hard to read, as text, folder, source and metadata that they stand for.
HARD = {
    "type:a type:b foo": ("foo", None, None, "type=b"), "folder:a folder:ab text": ("text", "ab", None, ""), 'folder:"my notes" TEAM:"Site Ops" who': ("who", "my notes", None, "team=Site Ops"),
    "see https://x.example/a:b and source:web": ("see https://x.example/a:b and", None, "web", ""), "a-b:c x_b:d b:c": ("", None, None, "a-b=c;x_b=d;b=c"), "key: spaced  key:\"\" 12:30 k://x": ('key: spaced key:"" 12:30 k://x', None, None, ""),
    "http:type:a source:": ("http:type:a source:", None, None, ""), "": ("", None, None, ""),
}


def _sql_text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_TOKEN = r"(^|[^\p{L}\p{N}_-])([a-zA-Z][a-zA-Z0-9_-]*):(\"[^\"]*\"|[^\s]+)"


@query(f"""WITH t AS (SELECT query_id, query, regexp_extract_all(query, '{_TOKEN}') AS p FROM golden_public), v AS (SELECT query_id, query, list_transform(p, lambda x: trim(x)) AS p FROM t),
    w AS (SELECT query_id, query, list_filter(p, lambda x: lower(split_part(x, ':', 1)) NOT IN ({', '.join(map(repr, fusion.RESERVED))}) AND NOT starts_with(substr(x, instr(x, ':') + 1), '//')) AS p FROM v),
    m AS (SELECT query_id, query, p, list_filter(p, lambda x: lower(split_part(x, ':', 1)) NOT IN ('folder', 'source')) AS o, list_filter(p, lambda x: starts_with(lower(x), 'folder:')) AS f, list_filter(p, lambda x: starts_with(lower(x), 'source:')) AS s FROM w)
    SELECT query_id, trim(regexp_replace(list_reduce(p, lambda q, x: replace(q, x, ' '), query), '[\\s\\p{{Z}}]+', ' ', 'g')) AS text, trim(substr(f[-1], 8), '"') AS folder, trim(substr(s[-1], 8), '"') AS source,
      array_to_string(list_transform(o, lambda x: lower(split_part(x, ':', 1)) || '=' || trim(substr(x, instr(x, ':') + 1), '"')), ';') AS meta FROM m
    UNION ALL VALUES {', '.join(f"({-1 - n}, {_sql_text(v[0])}, {_sql_text(v[1])}, {_sql_text(v[2])}, {_sql_text(v[3])})" for n, v in enumerate(HARD.values()))}""")
def filter_grammar(spark: SparkSession, d: str) -> DataFrame:
    """All golden queries and some hard ones, parsed by the filter grammar as one batch."""
    hard = spark.createDataFrame([(-1 - n, q) for n, q in enumerate(HARD)], "query_id long, query string")
    parsed = fusion.with_filters(golden(spark, d).select("query_id", "query").unionByName(hard), "query")
    meta = F.array_join(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return parsed.select("query_id", "text", "folder", "source", meta.alias("meta"))


@query()
def hash_search(spark: SparkSession, d: str) -> DataFrame:
    """Golden questions against chunks by the hashing embedder."""
    return embed.embedded_topk(chunks(spark, d, "text"), "id", "text", golden(spark, d), "query_id", "text", embed.HashingEmbedder(4096), 10)


@query()
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    e = embed.HashingEmbedder(256)
    return embed.embedded(chunks(spark, d, "text"), "text", e).select("id", F.size("embedding").alias("dim"), F.round(F.expr(f"sqrt({dense.dot('embedding', 'embedding')})"), 3).alias("norm"))


@query("""WITH m AS (SELECT DISTINCT sha1('hash|64|' || text) AS key FROM chunks), c AS (SELECT DISTINCT sha1('hash|64|' || text) AS key FROM memories) SELECT key FROM m WHERE key NOT IN (SELECT key FROM c)""")
def embed_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Chunk texts of which a cache filled from the memories has no vector."""
    e = embed.HashingEmbedder(64)
    cache = table(spark, d, "memories").select(T.embed_key("hash", 64, F.col("text")).alias("key")).distinct()
    return embed.cache_misses(table(spark, d, "chunks"), "text", cache, e).select("key")


@query("""WITH v AS (SELECT label, list_transform(range(1, 65), lambda i: i) AS ix, embedding FROM embeddings), e AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM v)
    SELECT label, i, round(avg(x), 6) AS mean FROM e GROUP BY label, i""")
def doc_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = dense.centroids(table(spark, d, "embeddings"), "label", "embedding", DIM)
    return c.select("label", F.posexplode("centroid").alias("at", "x")).select("label", (F.col("at") + 1).cast("long").alias("i"), F.round("x", 6).alias("mean"))
