"""Registered queries on chats, caches and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarnwell.operators import conversation
from skarnwell.plans.base import DIM, MSG, QUESTIONS, messages, query, questions, sql_dense, table

PREV = f"{MSG}, prev AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM msg)"


@query(f"WITH {PREV} SELECT id, chat_id, question FROM prev WHERE role = 'assistant'")
def prev_user_question(spark: SparkSession, d: str) -> DataFrame:
    return conversation.previous_question(messages(spark, d)).filter("role = 'assistant'").select("id", "chat_id", "question")


@query(f"WITH {MSG}, l AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) AS n FROM msg) SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY id) AS pos, role, text FROM l WHERE n <= 6")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversation.recent_turns(messages(spark, d))


@query(f"WITH {MSG}, n AS (SELECT chat_id, count(*) AS messages FROM msg GROUP BY chat_id) SELECT id, title, updated_at, coalesce(messages, 0) AS messages FROM chats LEFT JOIN n ON n.chat_id = chats.id ORDER BY updated_at DESC, id DESC LIMIT 50")
def chat_list(spark: SparkSession, d: str) -> DataFrame:
    return conversation.chat_list(table(spark, d, "chats"), messages(spark, d).select("chat_id"))


@query(f"WITH {PREV} SELECT id, chat_id, question, text, feedback FROM prev WHERE role = 'assistant' AND feedback <> 0")
def feedback_rows(spark: SparkSession, d: str) -> DataFrame:
    return conversation.feedback_rows(messages(spark, d))


@query(f"""WITH {PREV}, g AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY id DESC) AS n FROM prev WHERE role = 'assistant' AND feedback > 0 AND question IS NOT NULL AND len(citations) > 0)
    SELECT question AS query, array_to_string(list_sort(list_distinct(list_transform(citations, lambda c: c.path))), ',') AS relevant FROM g WHERE n = 1""")
def feedback_golden(spark: SparkSession, d: str) -> DataFrame:
    return conversation.feedback_golden(messages(spark, d)).select("query", F.array_join("relevant", ",").alias("relevant"))


@query(f"""WITH {PREV}, a AS (SELECT *, feedback < 0 AS refused FROM prev WHERE role = 'assistant' AND question IS NOT NULL),
    g AS (SELECT arg_max(question, CASE WHEN refused THEN id END) AS question, count(*) FILTER (refused) AS count, max(created_at) FILTER (refused) AS last_seen, NOT arg_max(coalesce(refused, false), id) AS resolved FROM a GROUP BY lower(trim(question)))
    SELECT question, count, last_seen, resolved FROM g WHERE count > 0 ORDER BY count DESC, last_seen DESC NULLS LAST, question LIMIT 25""")
def refusals(spark: SparkSession, d: str) -> DataFrame:
    """Answers rated down stand for refusals: the test messages hold none."""
    return conversation.refusals(messages(spark, d), F.col("feedback") < 0)


CACHE = f"c AS (SELECT DISTINCT ON (cache_key) * FROM answer_cache), ok AS (SELECT * FROM c WHERE len(embedding) = {DIM} AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0)"


@query(f"""WITH {CACHE}, s AS (SELECT q.cache_key AS asked, c.cache_key, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM ok q JOIN ok c ON q.fingerprint = c.fingerprint),
    r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, cache_key) AS n FROM s WHERE score >= 0.88) SELECT asked, cache_key, score FROM r WHERE n = 1""")
def cache_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Every cached question looked up in the cache: itself, at cosine 1, unless an equal one has a smaller key."""
    q = questions(spark, d).select(F.col("cache_key").alias("asked"), "fingerprint", "embedding")
    return conversation.cache_nearest(table(spark, d, "answer_cache"), q, "asked", "embedding", DIM)


@query("WITH c AS (SELECT DISTINCT ON (cache_key) cache_key, created_at FROM answer_cache) SELECT cache_key, created_at FROM c ORDER BY created_at DESC NULLS LAST, cache_key LIMIT 100")
def cache_trim(spark: SparkSession, d: str) -> DataFrame:
    """The cache cut to its newest hundred."""
    return conversation.keep_newest(table(spark, d, "answer_cache").select("cache_key", "created_at"), "cache_key", 100)


@query("WITH c AS (SELECT DISTINCT ON (cache_key) cache_key, question, fingerprint FROM answer_cache) SELECT a.cache_key AS asked, b.cache_key FROM c a JOIN c b ON sha256(concat_ws('|', a.fingerprint, lower(trim(a.question)))) = sha256(concat_ws('|', b.fingerprint, lower(trim(b.question))))")
def cache_exact(spark: SparkSession, d: str) -> DataFrame:
    from skarnwell.functions import text as T

    c = table(spark, d, "answer_cache").dropDuplicates(["cache_key"]).select("cache_key", T.answer_key(F.col("fingerprint"), F.col("question")).alias("k"))
    return c.select(F.col("cache_key").alias("asked"), "k").join(c, "k").select("asked", "cache_key")


MEMORY = f"m AS (SELECT id, embedding FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY id) AS n FROM memories) WHERE n = 1)"


@query(f"WITH {MEMORY}, {QUESTIONS}, {sql_dense('lane', 'questions', 'cache_key', 'embedding', 3, 'm')} SELECT cache_key, id, score, rank FROM lane WHERE score >= 0.35")
def memories_topk(spark: SparkSession, d: str) -> DataFrame:
    return conversation.relevant_memories(table(spark, d, "memories"), questions(spark, d), "cache_key", "embedding", DIM)


@query(f"""WITH mm AS (SELECT DISTINCT ON (id) id, embedding FROM memories), {QUESTIONS}, s AS (SELECT q.cache_key, c.id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM questions q, mm c WHERE len(c.embedding) = {DIM} AND list_sum(list_transform(c.embedding, lambda x: abs(x))) > 0 AND len(q.embedding) = {DIM} AND list_sum(list_transform(q.embedding, lambda x: abs(x))) > 0)
    SELECT cache_key, id, score FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY score DESC, id DESC) AS n FROM s WHERE score >= 0.3) WHERE n = 1""")
def corrections_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Memories stand for corrections, of which there is no table; a lower bar, so that there are rows."""
    return conversation.nearest_correction(table(spark, d, "memories").dropDuplicates(["id"]), questions(spark, d), "cache_key", "embedding", DIM, least=0.3)
