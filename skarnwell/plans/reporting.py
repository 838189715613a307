"""Registered queries on reports, prompts, reranking and what goes before an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarnwell import reports
from skarnwell.functions import text as T
from skarnwell.operators import analytics, conversation, dense, embed, evaluate, fusion, lexical, rerank
from skarnwell.plans.base import CH, DIM, INDEX, MSG, NOW, QUESTIONS, chunks, documents, golden, messages, query, questions, sql_bm25, sql_dense, table
from skarnwell.plans.chats import PREV
from skarnwell.plans.retrieval import HYBRID, STOP, _hits, sql_plain
from skarnwell.search import Corpus, Options, search


@query(f"WITH {CH}, n AS (SELECT doc_id, count(*) AS chunks FROM ch GROUP BY doc_id) SELECT path, source, indexed_at, coalesce(chunks, 0) AS chunks FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id ORDER BY path")
def document_list(spark: SparkSession, d: str) -> DataFrame:
    return reports.document_list(documents(spark, d), chunks(spark, d, "doc_id"))


@query("SELECT DISTINCT ON (id) id, text, created_at FROM memories ORDER BY id DESC")
def memory_list(spark: SparkSession, d: str) -> DataFrame:
    return reports.newest_first(table(spark, d, "memories"), "text", "created_at")


@query(f"""WITH {CH}, o AS (SELECT * FROM documents WHERE mtime > 0 ORDER BY mtime, doc_id LIMIT 5) SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM ch) AS chunks,
    (SELECT count(*) FROM documents WHERE path LIKE 'email/%') AS never_index, (SELECT string_agg(path, '|' ORDER BY mtime, doc_id) FROM o) AS oldest, true AS embedder_matches""")
def health(spark: SparkSession, d: str) -> DataFrame:
    return reports.health(documents(spark, d), chunks(spark, d), ["email/*"], "hash", "hash").withColumn("oldest", F.array_join("oldest", "|"))


@query(r"""WITH w AS (SELECT doc_id, text, text[:200] AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT *, greatest(CASE WHEN contains(w, '. ') THEN 200 END, 0) AS x FROM w),
    r AS (SELECT doc_id, text, w, (SELECT max(CASE WHEN strpos(reverse(w), p) > 0 THEN length(w) - strpos(reverse(w), p) - length(p) + 1 ELSE -1 END) FROM (VALUES (' .'), (' !'), (' ?'), (chr(10))) v(p)) AS stop,
      CASE WHEN strpos(reverse(w), ' ') > 0 THEN length(w) - strpos(reverse(w), ' ') ELSE -1 END AS space FROM e),
    c AS (SELECT *, CASE WHEN stop < 100 THEN space ELSE stop END AS cut FROM r)
    SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN cut <= 0 THEN w ELSE regexp_replace(w[:cut + 1], '[\s\p{Z}]+$', '') END AS clipped FROM c""")
def clip(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).filter("text is not null").select("doc_id", T.clip(F.col("text"), 200).alias("clipped"))


@query(rf"SELECT DISTINCT ON (id) id, regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}\p{{M}}_])({'|'.join(T.DIAGRAM_WORDS)})s?([^\p{{L}}\p{{N}}\p{{M}}_]|$)') AS wanted FROM chunks")
def diagram_intent(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "text").select("id", T.wants_diagram(F.col("text")).alias("wanted"))


_SEVERAL = " OR ".join(f"contains(lower(question), '{s}')" for s in conversation.SEVERAL)


@query(rf"""WITH q AS (SELECT query_id, regexp_replace(query, '^folder:[^ ]+ ', '') AS question, coalesce(len(history), 0) > 0 AS follow FROM golden_public)
    SELECT query_id, (follow AND len(list_filter(regexp_split_to_array(question, '[\s\p{{Z}}]+'), lambda w: w <> '')) <= 12) OR {_SEVERAL} AS planned FROM q""")
def needs_plan(spark: SparkSession, d: str) -> DataFrame:
    has = F.coalesce(F.size("history"), F.lit(0)) > 0
    return golden(spark, d).select("query_id", conversation.needs_plan(F.col("text"), has).alias("planned"))


@query(f"""WITH {MSG}, l AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) AS n FROM msg) SELECT chat_id, string_agg(concat_ws(': ', coalesce(role, ''), coalesce(text, '')), chr(10) ORDER BY id) AS "window" FROM l WHERE n <= 12 GROUP BY chat_id""")
def memory_windows(spark: SparkSession, d: str) -> DataFrame:
    return conversation.memory_windows(messages(spark, d))


@query(f"""WITH {CH}, m AS (SELECT count(DISTINCT id) AS n, coalesce(max(id), 0) AS last FROM memories) SELECT concat_ws('|', 'v1', 'hash', 'echo', 'echo:1', (SELECT count(*) FROM documents), (SELECT count(*) FROM ch), (SELECT strftime(max(indexed_at), '%Y-%m-%d') FROM documents), n || ':' || last) AS fingerprint FROM m""")
def answer_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Memories stand for corrections; revisions to the day."""
    docs = documents(spark, d).withColumn("indexed_at", F.to_date("indexed_at"))
    return conversation.fingerprint(docs, chunks(spark, d, "doc_id"), table(spark, d, "memories").dropDuplicates(["id"]), "v1", "hash", "echo", "echo:1")


@query("""WITH c AS (SELECT id, CASE WHEN id % 4 = 0 THEN 0 ELSE 24 * (id % 4) END AS hours, CASE WHEN id % 5 = 0 THEN 'never' WHEN id % 5 = 1 THEN NULL ELSE strftime(updated_at, '%Y-%m-%d %H:%M:%S') END AS last, (SELECT max(updated_at) FROM chats) AS now FROM chats)
    SELECT id, CASE WHEN hours <= 0 THEN false WHEN last IS NULL OR last = 'never' THEN true ELSE epoch(date_trunc('second', now)) - epoch(strptime(last, '%Y-%m-%d %H:%M:%S')) >= hours * 3600 END AS due FROM c""")
def index_due(spark: SparkSession, d: str) -> DataFrame:
    """Chats stand for jobs: their last change for the last run."""
    c = table(spark, d, "chats")
    last = F.when(F.col("id") % 5 == 0, "never").when(F.col("id") % 5 == 1, None).otherwise(F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))
    hours = F.when(F.col("id") % 4 == 0, 0.0).otherwise(24.0 * (F.col("id") % 4))
    return c.crossJoin(F.broadcast(c.agg(F.max("updated_at").alias("now")))).select("id", conversation.index_due(hours, last, F.col("now")).alias("due"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE coalesce(len(map_keys(metadata)), 0) END AS keys, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE metadata['status'] END AS status FROM documents")
def metadata_json(spark: SparkSession, d: str) -> DataFrame:
    """Metadata written as JSON and read again; every fifth is broken and reads as empty."""
    j = documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 5 == 0, "{broken").otherwise(F.to_json("metadata")).alias("j"))
    m = T.json_map(F.col("j"))
    return j.select("doc_id", F.size(m).cast("long").alias("keys"), F.try_element_at(m, F.lit("status")).alias("status"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE path END AS standalone FROM documents")
def model_json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON object in the prose of an answer; every third answer has none."""
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("I cannot say more on "), "path")).otherwise(F.concat(F.lit("Sure:\n"), F.to_json(F.struct(F.col("path").alias("standalone"), F.array("source").alias("sub_queries"))), F.lit("\nDone.")))
    return documents(spark, d).select("doc_id", T.llm_json(said, "standalone string, sub_queries array<string>")["standalone"].alias("standalone"))


@query(f"""WITH a AS (SELECT DISTINCT ON (cache_key) cache_key, answer, answer[:80] || ' ' || question AS passage FROM answer_cache), s AS (SELECT cache_key, passage, trim(unnest(string_split_regex(regexp_replace(answer, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)))) AS sentence FROM a),
    w AS (SELECT cache_key, {sql_plain('sentence')} AS words, {sql_plain('passage')} AS known FROM s WHERE sentence <> ''), k AS (SELECT cache_key, len(list_intersect(words, known)) / greatest(len(list_distinct(words)), 1)::DOUBLE >= 0.5 AS ok FROM w)
    SELECT cache_key, count(*) AS sentences, count(*) FILTER (ok) AS grounded, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS ratio FROM k GROUP BY cache_key""")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the cached answers against the question and the beginning of the answer as passage: some are grounded, some are not."""
    a = table(spark, d, "answer_cache").dropDuplicates(["cache_key"]).withColumn("passage", F.concat(F.substring("answer", 1, 80), F.lit(" "), "question"))
    return evaluate.grounding(a, "cache_key", "answer", "passage")


@query(f"""WITH {MSG}, a AS (SELECT id, CASE WHEN feedback <> 0 THEN (feedback + 1) / 2.0 END AS judge, len(regexp_extract_all(text, '\\[(\\d{{1,6}})\\]', 1)) > 0 AND list_bool_and(list_transform(regexp_extract_all(text, '\\[(\\d{{1,6}})\\]', 1), lambda x: x::INT BETWEEN 1 AND coalesce(len(citations), 0))) AS valid, text FROM msg WHERE role = 'assistant')
    SELECT count(*) AS answers, round(coalesce(avg(least(length(text) / 1000.0, 1.0)), 0), 6) AS grounded_ratio, round(coalesce(avg(valid::INT), 0), 6) AS citation_valid, round(coalesce(avg(judge), 0), 6) AS judge_ratio, round(count(judge) / greatest(count(*), 1), 6) AS judge_coverage FROM a""")
def answer_quality(spark: SparkSession, d: str) -> DataFrame:
    """Feedback stands for a judge's verdict, length for grounding."""
    a = messages(spark, d).filter("role = 'assistant'")
    per = a.select(F.least(F.length("text") / 1000.0, F.lit(1.0)).alias("grounded_ratio"), T.citations_valid(F.col("text"), F.greatest(F.coalesce(F.size("citations"), F.lit(0)), F.lit(0))).alias("citation_valid"), F.when(F.col("feedback") != 0, (F.col("feedback") + 1) / 2.0).alias("judge_ratio"))
    return reports.answer_quality(per)


_QW, _TW = sql_plain("q.question"), sql_plain("h.text")


@query(f"""WITH {HYBRID}, w AS (SELECT h.cache_key, h.id, h.rank, list_distinct({_QW}) AS a, list_distinct({_TW}) AS b FROM hits h JOIN questions q USING (cache_key)),
    r AS (SELECT cache_key, id, rank, round(len(list_intersect(a, b)) / greatest(len(a) + len(b) - len(list_intersect(a, b)), 1)::DOUBLE, 6) AS relevance FROM w)
    SELECT cache_key, id, relevance, row_number() OVER (PARTITION BY cache_key ORDER BY relevance DESC, rank) AS reranked FROM r""")
def model_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = _hits(spark, d).select("cache_key", "id", "rank").join(chunks(spark, d, "text"), "id").join(questions(spark, d).select("cache_key", "question"), "cache_key")
    return rerank.model_rerank(rows, "cache_key", F.col("question"), F.col("text"), rerank.JaccardReranker).select("cache_key", "id", "relevance", "reranked")


#: Vectors that stand for those of a hypothetical answer and of two further phrasings.
EXTRA = {"hyde": "list_reverse(embedding)", "sub1": "embedding[33:] || embedding[:32]", "sub2": "embedding[17:] || embedding[:16]"}
_EXTRA_LANES = ", ".join(f"q_{n} AS (SELECT cache_key, {x} AS v FROM questions WHERE len(embedding) = {DIM}), {sql_dense(n, f'q_{n}', 'cache_key', 'v', 50)}" for n, x in EXTRA.items())


@query(f"""WITH {CH}, {INDEX}, {QUESTIONS}, {sql_bm25('bm25', 'questions', 'cache_key', 'question', 50)}, {sql_dense('dense', 'questions', 'cache_key', 'embedding', 50)}, {_EXTRA_LANES},
    u AS (SELECT cache_key, id, rank, 0 AS lane, 1.0 AS w FROM bm25 UNION ALL SELECT cache_key, id, rank, 1, 1.0 FROM dense UNION ALL SELECT cache_key, id, rank, 2, 0.5 FROM hyde UNION ALL SELECT cache_key, id, rank, 3, 1.0 FROM sub1 UNION ALL SELECT cache_key, id, rank, 4, 1.0 FROM sub2)
    SELECT cache_key, id, round(sum(w / (60 + rank) ORDER BY lane), 9) AS fused, string_agg(['bm25', 'dense', 'hyde', 'sub1', 'sub2'][lane + 1], '+' ORDER BY lane) AS lanes FROM u GROUP BY cache_key, id""")
def hyde_and_sub_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Five lanes at once: words, the question's vector, a hypothetical answer's and two sub-queries'; those of the latter are made up from the first."""
    q = questions(spark, d)
    v = F.col("embedding")
    turned = lambda n: F.concat(F.slice(v, n + 1, DIM - n), F.slice(v, 1, n))
    q = q.withColumns({"hyde": F.reverse(v), "sub1": turned(32), "sub2": turned(16)})
    lanes = [("bm25", lexical.bm25(chunks(spark, d, "text"), "id", "text", q, "cache_key", "question", 50))]
    lanes += [(n, dense.dense_topk(chunks(spark, d, "embedding"), "id", "embedding", q, "cache_key", c, DIM, 50)) for n, c in (("dense", "embedding"), ("hyde", "hyde"), ("sub1", "sub1"), ("sub2", "sub2"))]
    return fusion.rrf(lanes, "cache_key", "id", {"hyde": 0.5}).select("cache_key", "id", F.round("fused", 9).alias("fused"), "lanes")


@query(f"""WITH {HYBRID}, t AS (SELECT h.cache_key, string_agg('[' || h.rank || '] ' || h.path || chr(10) || h.text, chr(10) || chr(10) ORDER BY h.rank) AS passages FROM hits h WHERE h.rank <= 5 GROUP BY h.cache_key)
    SELECT t.cache_key, concat_ws(chr(10) || chr(10), 'Known about the reader:' || chr(10) || '- works on ' || q.fingerprint, CASE WHEN regexp_matches(lower(q.question), '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])({'|'.join(T.DIAGRAM_WORDS)})s?([^\\p{{L}}\\p{{N}}\\p{{M}}_]|$)') THEN 'Answer with a diagram in text form.' END, 'Answer in two sentences.', passages, 'Question: ' || q.question) AS prompt
    FROM t JOIN questions q USING (cache_key)""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with a note, passages and hints; the cache's fingerprint stands for a memory."""
    q = questions(spark, d)
    hits = _hits(spark, d).filter("rank <= 5").select("cache_key", F.col("rank").alias("place"), "path", "id").join(chunks(spark, d, "text"), "id").join(q.select("cache_key", "question"), "cache_key")
    memory = q.select("cache_key", F.lit(1).alias("rank"), F.concat(F.lit("works on "), "fingerprint").alias("text")).filter("text is not null")
    return conversation.prompt(hits, "cache_key", "question", before=conversation.notes("cache_key", memory), diagrams=True, length="short")


@query()
def refusal_probe(spark: SparkSession, d: str) -> DataFrame:
    """The ten questions most often answered badly, and the chunk that a search by the hashing embedder finds for each now."""
    refused = conversation.refusals(messages(spark, d), F.col("feedback") < 0)
    asked = refused.select("question").distinct()
    best = embed.embedded_topk(chunks(spark, d, "text"), "id", "text", asked.withColumn("text", F.col("question")), "question", "text", embed.HashingEmbedder(), 1)
    where = best.join(chunks(spark, d, "doc_id"), "id").join(documents(spark, d).select("doc_id", "path"), "doc_id").select("question", F.col("rank").alias("place"), "path", F.col("score").alias("cosine"))
    return reports.refusal_probe(refused, where)


@query()
def topic_map(spark: SparkSession, d: str) -> DataFrame:
    c = dense.centroids(chunks(spark, d, "doc_id", "embedding"), "doc_id", "embedding", DIM)
    return reports.topic_map(documents(spark, d).select("doc_id", "path", "text"), c, "doc_id", "centroid", "text")


@query()
def symbol_answer(spark: SparkSession, d: str) -> DataFrame:
    """Where `emit` is defined and called, with lines found again in the documents."""
    sites = analytics.symbol_sites(chunks(spark, d, "doc_id", "text", "line_start"), documents(spark, d), "emit")
    return reports.symbol_answer(reports.reanchored(sites, documents(spark, d).select("path", F.col("text").alias("body"))), "emit")


@query()
def search_all(spark: SparkSession, d: str) -> DataFrame:
    """The golden queries with their folders, as one batch through the whole search: words and paths within the scope of each."""
    c = Corpus(documents(spark, d), table(spark, d, "chunks"), table(spark, d, "parents"))
    return search(c, table(spark, d, "golden_public").select("query_id", F.regexp_replace("query", "^folder:repos/[^ ]+", "folder:repos").alias("query")), "query_id", "query", NOW, Options(rerank=True)).select("query_id", "place", "id", "path", "score", "lanes")
