"""Retrieval metrics, answer grounding and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarnwell.functions import text as T


def rank_documents(hits: DataFrame, query_id: str, path: str = "path") -> DataFrame:
    """(query_id, path, rank): documents in the order of their first hit."""
    first = hits.groupBy(query_id, path).agg(F.min("rank").alias("at"))
    w = Window.partitionBy(query_id).orderBy("at", path)
    return first.select(query_id, path, F.row_number().over(w).cast("long").alias("rank"))


def matches(path: Column, relevant: Column) -> Column:
    return (path == relevant) | F.endswith(path, relevant) | F.endswith(relevant, path)


def metrics(golden: DataFrame, docs: DataFrame, query_id: str, k: int = 10, recall_k: int = 5) -> DataFrame:
    """(query_id, category, recall, ndcg, mrr) of every golden query: recall@5, nDCG@10 with binary gain, MRR@10.

    golden: query_id, category, relevant; docs: query_id, path, rank. A query without relevant paths scores 0. Only the k best
    documents of a query meet its few relevant paths, so the suffix match is no large join.
    """
    best = docs.filter(F.col("rank") <= k)
    g = golden.select(query_id, "category", F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"))
    hit = F.exists("relevant", lambda r: matches(F.col("path"), r))
    rows = g.join(best, query_id, "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    gain = F.when(F.col("hit"), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size("relevant"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    agg = rows.groupBy(query_id).agg(
        F.first("category").alias("category"), F.first("relevant").alias("relevant"),
        F.sum(F.when(F.col("hit") & (F.col("rank") <= recall_k), 1).otherwise(0)).alias("found"),
        F.sum(gain).alias("dcg"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
    )
    n = F.greatest(F.size("relevant"), F.lit(1))
    return agg.select(query_id, "category", F.round(F.col("found") / n, 6).alias("recall"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def by_category(per_query: DataFrame) -> DataFrame:
    """Means per category and, with a null category and level 1, over all queries."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("recall", "ndcg", "mrr")]
    return per_query.withColumn("category", F.coalesce("category", F.lit("(none)"))).rollup("category").agg(F.grouping("category").cast("long").alias("level"), F.count("*").alias("queries"), *means)


class GateFailed(AssertionError):
    """A metric lies under its floor."""


def gate(summary: DataFrame, floor: float, per_category: dict[str, float] | None = None) -> None:
    """Raises GateFailed where mean recall lies under the floor, over all queries or in a category."""
    rows = summary.select("category", "level", "recall").collect()  # one row a category
    for r in rows:
        least = floor if r.level == 1 else (per_category or {}).get(r.category)
        if least is not None and r.recall < least:
            raise GateFailed(f"recall {r.recall} of {r.category or 'all queries'} is under {least}")


def grounding(answers: DataFrame, answer_id: str, answer: str, passage: str, least: float = 0.5) -> DataFrame:
    """(answer_id, sentences, grounded, ratio): sentences of an answer of whose words at least that share stand in the passage."""
    s = answers.select(answer_id, F.explode(T.sentences(F.col(answer))).alias("sentence"), T.plain_tokens(F.col(passage)).alias("known"))
    words = T.plain_tokens(F.col("sentence"))
    share = F.size(F.array_intersect(words, F.col("known"))) / F.greatest(F.size(F.array_distinct(words)), F.lit(1))
    out = s.select(answer_id, (share >= least).cast("long").alias("ok")).groupBy(answer_id).agg(F.count("*").alias("sentences"), F.sum("ok").alias("grounded"))
    return out.withColumn("ratio", F.round(F.col("grounded") / F.col("sentences"), 6))


def latency(times: DataFrame, group: str, value: str) -> DataFrame:
    """(group, p50, p95), exact."""
    return times.groupBy(group).agg(F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))
