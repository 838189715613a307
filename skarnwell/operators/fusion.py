"""Hybrid retrieval: lanes, reciprocal rank fusion, adjustments, reranking and diversification."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarnwell.functions import text as T

RRF_K = 60
RECENCY_BOOST, RECENCY_DAYS = 0.10, 45.0
CANONICAL_BOOST, DRAFT_PENALTY = 1.05, 0.90
#: Metadata that raises or lowers a document, and the words that a filter key must not be.
CANONICAL = ("canonical", "authoritative", "official", "high", "true", "yes", "1")
DRAFT = ("draft", "deprecated", "archived", "superseded", "obsolete", "wip")
RESERVED = ("http", "https", "file", "ollama", "github", "web")
FILTER = re.compile(r"(?<![\w-])([a-z][a-z0-9_-]*):(\"[^\"]*\"|\S+)", re.IGNORECASE)


@dataclass
class Filters:
    """What a query restricts itself to: part of a path, a source, metadata values."""

    folder: str | None = None
    source: str | None = None
    meta: dict[str, str] = field(default_factory=dict)


def parse_filters(query: str) -> tuple[str, Filters]:
    """(text, filters) of one query: `folder:x`, `source:x` and `key:value`, values perhaps in quotes; the last of a key counts."""
    f = Filters()

    def take(m: re.Match) -> str:
        key, value = m[1].lower(), m[2].strip('"')
        if key in RESERVED or not value or value.startswith("//"):
            return m[0]
        if key == "folder":
            f.folder = value
        elif key == "source":
            f.source = value
        else:
            f.meta[key] = value
        return " "

    text = FILTER.sub(take, query)
    return " ".join(text.split()), f


#: A filter as one token of a query, for the JVM; what is no filter comes character by character.
_FILTER = r"(?<![\w-])[a-z][a-z0-9_-]*:(?:\"[^\"]*\"|\S+)"


def with_filters(queries: DataFrame, query: str) -> DataFrame:
    """queries with `text`, `folder`, `source` and `meta` parsed from the query column, in the JVM; the same as parse_filters row by row.

    A query is read from left to right: a filter is struck where it stands, so one that is part of another stays whole, and of a repeated key the last
    value counts. A null query has null results.
    """
    tokens = F.regexp_extract_all(F.col(query), F.lit(rf"(?siU){_FILTER}|."), F.lit(0))
    key = lambda p: F.lower(F.substring_index(p, ":", 1))
    value = lambda p: F.regexp_replace(F.substring(p, F.instr(p, ":") + 1, F.length(p)), '^"+|"+$', "")
    is_filter = lambda p: (F.length(p) > 1) & (F.instr(p, ":") > 1) & ~key(p).isin(list(RESERVED)) & (value(p) != "") & ~value(p).startswith("//")
    kept = F.filter(tokens, is_filter)
    last = lambda name: F.try_element_at(F.filter(kept, lambda p: key(p) == name), F.lit(-1))
    others = F.filter(kept, lambda p: ~key(p).isin("folder", "source"))
    final = F.filter(others, lambda p, i: ~F.exists(F.slice(others, i + 2, F.greatest(F.size(others), F.lit(1))), lambda q: key(q) == key(p)))
    text = F.array_join(F.transform(tokens, lambda p: F.when(is_filter(p), " ").otherwise(p)), "")
    return queries.withColumns({
        "text": F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), "folder": value(last("folder")), "source": value(last("source")),
        "meta": F.map_from_entries(F.transform(final, lambda p: F.struct(key(p), value(p)))),
    })


def in_scope(folder: Column, source: Column, path: Column, doc_source: Column) -> Column:
    """A document lies in the scope of a query: its path holds the folder (case does not matter) and its source is the one named."""
    return (folder.isNull() | F.contains(F.lower(path), F.lower(folder))) & (source.isNull() | (doc_source == source))


def recency_factor(mtime: Column, now: Column) -> Column:
    """1 + 0.10 exp(-age in days / 45); 1 without a time."""
    age = F.greatest(F.lit(0.0), (now - mtime) / 86400.0)
    return F.when(F.coalesce(mtime, F.lit(0.0)) <= 0, 1.0).otherwise(1 + RECENCY_BOOST * F.exp(-age / RECENCY_DAYS))


def metadata_factor(metadata: Column) -> Column:
    """1.05 for an authority that is canonical, times 0.90 for a status that is a draft's."""
    def value(key: str) -> Column:
        return F.lower(F.trim(F.coalesce(F.try_element_at(metadata, F.lit(key)), F.lit(""))))

    up = F.when(value("authority").isin(*CANONICAL), CANONICAL_BOOST).otherwise(1.0)
    return up * F.when(value("status").isin(*DRAFT), DRAFT_PENALTY).otherwise(1.0)


def rrf(lanes: list[tuple[str, DataFrame]], query_id: str, key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, key, fused, lanes, first_lane, first_rank): sum of weight / (60 + rank) over the lanes, added in lane order.

    A lane is (query_id, key, rank from 1). One union and one shuffle, whatever the number of lanes.
    """
    parts = [df.select(query_id, key, F.lit(n).alias("lane_no"), F.col("rank").cast("long").alias("rank")) for n, (_, df) in enumerate(lanes)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    ranks = [F.min(F.when(F.col("lane_no") == n, F.col("rank"))).alias(f"r{n}") for n in range(len(lanes))]
    wide = rows.groupBy(query_id, key).agg(*ranks)
    fused, names, first_lane, first_rank = F.lit(0.0), [], F.lit(None), F.lit(None)
    for n, (name, _) in enumerate(lanes):
        w = float((weights or {}).get(name, 1.0))
        fused = fused + F.coalesce(F.lit(w) / (RRF_K + F.col(f"r{n}")), F.lit(0.0))
        names.append(F.when(F.col(f"r{n}").isNotNull(), F.lit(name)))
    for n in reversed(range(len(lanes))):
        first_lane = F.when(F.col(f"r{n}").isNotNull(), F.lit(n)).otherwise(first_lane)
        first_rank = F.when(F.col(f"r{n}").isNotNull(), F.col(f"r{n}")).otherwise(first_rank)
    return wide.select(query_id, key, F.round(fused, 12).alias("fused"), F.array_join(F.array_compact(F.array(*names)), "+").alias("lanes"), first_lane.cast("long").alias("first_lane"), first_rank.cast("long").alias("first_rank"))


def adjusted(fused: DataFrame, query_id: str, key: str, chunks: DataFrame, documents: DataFrame, now: float, top: int) -> DataFrame:
    """The fused rows with their document, `score` = fused x recency x metadata, and `rank`; ties as they stood in the first lane that found them.

    Before the cut a row carries only its factors; what else is known of chunks and documents joins the rows that are left.
    """
    places = chunks.select(F.col("id").alias(key), "doc_id", "ordinal", "parent_ordinal", "line_start")
    factors = documents.select("doc_id", recency_factor(F.col("mtime"), F.lit(now)).alias("_recency"), metadata_factor(F.col("metadata")).alias("_metadata"))
    rows = fused.join(places.select(key, "doc_id").join(factors, "doc_id").drop("doc_id"), key)
    rows = rows.withColumn("score", F.round(F.col("fused") * F.col("_recency") * F.col("_metadata"), 9)).drop("_recency", "_metadata")
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc("first_lane"), F.asc("first_rank"))
    best = rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)
    return best.join(places, key).join(documents.select("doc_id", "path", "source", "mtime", "metadata"), "doc_id")


def diversify(ranked: DataFrame, query_id: str, group: str, top: int, per_group: int = 2) -> DataFrame:
    """At most per_group rows of a group first, the rest after them, in order of rank; the first `top` of that, newly ranked as `place`."""
    inside = Window.partitionBy(query_id, group).orderBy("rank")
    rows = ranked.withColumn("_over", F.row_number().over(inside) > per_group)
    w = Window.partitionBy(query_id).orderBy("_over", "rank")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= top).drop("_over")


def lexical_rerank(ranked: DataFrame, query_id: str, query: Column, text: Column) -> DataFrame:
    """Reranked by how many distinct words of the query a text holds, ties in the order given (`rank`); without words in the query unchanged."""
    overlap = F.size(F.array_intersect(T.plain_tokens(query), T.plain_tokens(text)))
    rows = ranked.withColumn("overlap", overlap.cast("long"))
    w = Window.partitionBy(query_id).orderBy(F.desc("overlap"), F.asc("rank"))
    return rows.withColumn("reranked", F.row_number().over(w).cast("long"))


def with_context(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """hits with `parent_text`, empty where there is no parent; both sides are keyed by document and ordinal."""
    p = parents.dropDuplicates(["doc_id", "ordinal"]).select("doc_id", F.col("ordinal").alias("parent_ordinal"), F.col("text").alias("parent_text"))
    return hits.join(p, ["doc_id", "parent_ordinal"], "left").withColumn("parent_text", F.coalesce("parent_text", F.lit("")))
