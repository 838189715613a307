"""Search over a corpus: what the lanes, fusion and reranking make together, for a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarnwell.operators import dense, fusion, lexical

POOL, LEAST_CANDIDATES, TOP = 50, 20, 5


@dataclass
class Corpus:
    """Documents, chunks and parents; `index` may hold stored postings and statistics of the chunks' texts."""

    documents: DataFrame
    chunks: DataFrame
    parents: DataFrame | None = None
    index: tuple[DataFrame, DataFrame] | None = None


@dataclass
class Options:
    """Choices of a search. Vector lanes: name -> column of the queries that holds its vector; they run in this order after the words."""

    top: int = TOP
    pool: int = POOL
    per_document: int = 2
    weights: dict[str, float] = field(default_factory=dict)
    vectors: dict[str, str] = field(default_factory=dict)
    dim: int = 0
    rerank: bool = False


def scope_of(queries: DataFrame, corpus: Corpus, query_id: str) -> DataFrame:
    """(query_id, doc_id) for the documents in the scope of every query that has filters; queries without filters have no rows. Documents are matched with the distinct filters of the batch."""
    restricted = queries.filter(F.col("folder").isNotNull() | F.col("source").isNotNull() | (F.size("meta") > 0)).select(query_id, "folder", F.col("source").alias("wanted_source"), "meta")
    restricted = restricted.withColumn("_filter", F.to_json(F.struct(F.lower("folder").alias("f"), "wanted_source", F.sort_array(F.map_entries("meta")).alias("m"))))
    distinct = restricted.dropDuplicates(["_filter"]).drop(query_id)
    meta = F.forall(F.map_entries("meta"), lambda e: F.lower(F.coalesce(F.try_element_at("metadata", e["key"]), F.lit(""))) == F.lower(e["value"]))
    docs = corpus.documents.select("doc_id", "path", "source", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))
    inside = docs.join(distinct, fusion.in_scope(F.col("folder"), F.col("wanted_source"), F.col("path"), F.col("source")) & meta).select("_filter", "doc_id")
    return inside.join(restricted.select(query_id, "_filter"), "_filter").select(query_id, "doc_id")


def search(corpus: Corpus, queries: DataFrame, query_id: str, query: str, now: float, options: Options | None = None) -> DataFrame:
    """The best hits of every query: query_id, place, id, doc_id, path, source, ordinal, line, score, cosine, lanes, metadata, text, parent_text.

    Filters are parsed from the query texts and restrict every lane before it is cut. `cosine` is that of the first vector lane, 0 for
    hits that did not come through it. Repeated chunk rows count once.
    """
    o = options or Options()
    chunks = corpus.chunks.dropDuplicates(["id"])
    c = Corpus(corpus.documents, chunks, corpus.parents, corpus.index)
    q = fusion.with_filters(queries, query)
    free = q.filter(F.col("folder").isNull() & F.col("source").isNull() & (F.size("meta") == 0))
    bound = q.join(free.select(query_id), query_id, "left_anti")
    documents = scope_of(q, c, query_id)
    scope = documents.join(chunks.select("id", "doc_id"), "doc_id").select(query_id, "id")

    def both(lane) -> DataFrame:
        return lane(free, None).unionByName(lane(bound, scope))

    texts = chunks.select("id", "text")
    lanes = [("bm25", both(lambda part, s: lexical.bm25(texts, "id", "text", part, query_id, "text", o.pool, scope=s, index=c.index)))]
    for name, column in o.vectors.items():
        lanes.append((name, both(lambda part, s, column=column: dense.dense_topk(chunks, "id", "embedding", part, query_id, column, o.dim, o.pool, scope=s))))
    plain = chunks.select("id", "doc_id", "ordinal")
    paths = lexical.path_lane(plain, c.documents, free, query_id, "text", o.pool).unionByName(lexical.path_lane(plain, c.documents, bound, query_id, "text", o.pool, scope=documents))
    lanes.append(("path", paths))
    fused = fusion.rrf(lanes, query_id, "id", o.weights)
    hits = fusion.adjusted(fused, query_id, "id", chunks, c.documents, now, max(o.top, LEAST_CANDIDATES))
    hits = hits.join(texts, "id")
    if o.rerank:
        hits = fusion.lexical_rerank(hits.join(q.select(query_id, F.col("text").alias("_question")), query_id), query_id, F.col("_question"), F.col("text")).withColumn("rank", F.col("reranked"))
    hits = fusion.diversify(hits, query_id, "doc_id", o.top, o.per_document)
    if c.parents is not None:
        hits = fusion.with_context(hits, c.parents)
    else:
        hits = hits.withColumn("parent_text", F.lit(""))
    cosine: Column = F.lit(0.0)
    if o.vectors:
        first = next(df for name, df in lanes if name in o.vectors).select(query_id, "id", F.col("score").alias("_cosine"))
        hits = hits.join(first, [query_id, "id"], "left")
        cosine = F.coalesce("_cosine", F.lit(0.0))
    return hits.select(query_id, "place", "id", "doc_id", "path", "source", "ordinal", F.col("line_start").alias("line"), "score", cosine.alias("cosine"), "lanes", "metadata", "text", "parent_text")

