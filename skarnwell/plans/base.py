"""What the registered queries share: the registry, and the tables as they are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIM = 64
NOW = 1_790_000_000.0


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL it must equal."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks without repeated rows; only the columns asked for are read and shuffled."""
    rows = table(spark, d, "chunks")
    return (rows.select("id", *(c for c in columns if c != "id")) if columns else rows).dropDuplicates(["id"])


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages without repeated rows, under plain role names."""
    role = F.lower(F.trim("role"))
    plain = F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "ai", "bot"), "assistant").otherwise(role)
    return table(spark, d, "messages").dropDuplicates(["id"]).filter("chat_id is not null").withColumn("role", plain)


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Cached questions as a batch of queries. Those without a usable vector stay: only vector lanes leave them out."""
    return table(spark, d, "answer_cache").dropDuplicates(["cache_key"]).select("cache_key", "question", "embedding", "fingerprint")


def golden(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "golden_public").select("query_id", F.regexp_replace("query", "^folder:[^ ]+ ", "").alias("text"), F.regexp_extract("query", "^folder:([^/ ]+)", 1).alias("folder"), "relevant", "category", "history", "query")


FOLD = "strip_accents(replace(lower({}), 'đ', 'd'))"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({FOLD.format(x)}, '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


CH = "ch AS (SELECT DISTINCT ON (id) * FROM chunks)"
MSG = """msg AS (SELECT DISTINCT ON (id) id, chat_id, CASE WHEN lower(trim(role)) IN ('user','human') THEN 'user' WHEN lower(trim(role)) IN ('assistant','ai','bot') THEN 'assistant' ELSE lower(trim(role)) END AS role,
  text, citations, feedback, created_at FROM messages WHERE chat_id IS NOT NULL)"""
QUESTIONS = "questions AS (SELECT DISTINCT ON (cache_key) cache_key, question, embedding, fingerprint FROM answer_cache)"
GOLDEN = "golden AS (SELECT query_id, regexp_replace(query, '^folder:[^ ]+ ', '') AS text, regexp_extract(query, '^folder:([^/ ]+)', 1) AS folder, relevant, category, history, query FROM golden_public)"
INDEX = f"""tok AS (SELECT id, unnest({sql_tokens('text')}) AS term FROM ch), tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term),
dl AS (SELECT id, count(*) AS dl FROM tok GROUP BY id), st AS (SELECT (SELECT count(*) FROM ch) AS n, (SELECT count(*) FROM tok) / (SELECT count(*) FROM ch)::DOUBLE AS avgdl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def sql_bm25(name: str, source: str, key: str, text: str, top: int, scope: str = "") -> str:
    """CTEs of a BM25 lane `name` for the queries of `source`."""
    token = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"
    terms = f"list_transform(regexp_extract_all({FOLD.format(text)}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda t: array_to_string({token.format('t')}, ' '))"
    return f"""{name}_qt AS (SELECT {key}, term, count(*) AS times FROM (SELECT {key}, unnest({terms}) AS term FROM {source}) WHERE term <> '' GROUP BY {key}, term),
{name}_ph AS (SELECT DISTINCT term, string_split(term, ' ') AS p FROM {name}_qt WHERE contains(term, ' ')), {name}_ls AS (SELECT id, {sql_tokens('text')} AS t FROM ch),
{name}_pt AS (SELECT id, term, len(list_filter(range(1, len(t) - len(p) + 2), lambda i: t[i:i + len(p) - 1] = p)) AS tf FROM (SELECT id, t, ' ' || array_to_string(t, ' ') || ' ' AS line FROM {name}_ls) JOIN {name}_ph ON contains(line, ' ' || term || ' ')),
{name}_tf AS (SELECT id, term, tf FROM tf WHERE term IN (SELECT term FROM {name}_qt) UNION ALL FROM {name}_pt), {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_s AS (SELECT q.{key}, tf.id, round(sum(greatest(ln((n - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)) * times), 9) AS score
  FROM {name}_qt q JOIN {name}_tf tf USING (term) JOIN {name}_df USING (term) JOIN dl ON dl.id = tf.id CROSS JOIN st {scope} GROUP BY q.{key}, tf.id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, id) AS rank FROM {name}_s) WHERE rank <= {top})"""


def sql_dense(name: str, source: str, key: str, vector: str, top: int, candidates: str = "ch", cand_key: str = "id") -> str:
    usable = f"len({{0}}) = {DIM} AND list_sum(list_transform({{0}}, lambda x: abs(x))) > 0"
    return f"""{name}_s AS (SELECT q.{key}, c.{cand_key}, round(list_cosine_similarity(q.{vector}::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM {source} q, {candidates} c WHERE {usable.format('c.embedding')} AND {usable.format('q.' + vector)}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, {cand_key}) AS rank FROM {name}_s) WHERE rank <= {top})"""


def sql_path(name: str, source: str, key: str, text: str, top: int) -> str:
    return f"""{name}_w AS (SELECT {key}, unnest(list_slice(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: length(x) >= 3), 1, 5)) AS word FROM {source}),
{name}_d AS (SELECT w.{key}, d.doc_id, count(*) AS score FROM {name}_w w JOIN documents d ON contains(lower(d.path), w.word) GROUP BY ALL),
{name} AS (SELECT {key}, id, score, rank FROM (SELECT s.{key}, ch.id, s.score, row_number() OVER (PARTITION BY s.{key} ORDER BY s.score DESC, ch.ordinal, ch.id) AS rank FROM {name}_d s JOIN ch USING (doc_id)) WHERE rank <= {top})"""
