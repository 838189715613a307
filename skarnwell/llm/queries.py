"""The registered queries of this package: name -> (spark, directory of tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarnwell.llm import canonical, contamination, conversations, near_duplicates, neighbours, packing, splitting, toxicity
from skarnwell.operators.components import connected_components


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


CHUNK_LIMIT, CHUNK_OVERLAP, PARENT_LIMIT, PARENT_OVERLAP = 1000, 150, 6000, 600


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of all oversized chunks and parents."""
    c = splitting.split_oversized(_read(spark, d, "chunks"), ["doc_id", "ordinal"], "text", CHUNK_LIMIT, CHUNK_OVERLAP, "line_start")
    p = splitting.split_oversized(_read(spark, d, "parents"), ["doc_id", "ordinal"], "text", PARENT_LIMIT, PARENT_OVERLAP)
    p = p.withColumn("line", F.lit(None).cast("long"))  # a parent's line is not stored
    return c.withColumn("tab", F.lit("chunks")).unionByName(p.withColumn("tab", F.lit("parents")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and parents that had to be split."""
    return p3_pieces(spark, d).filter("piece = 2").select("tab", "doc_id", F.col("ordinal").cast("long").alias("ordinal")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Golden questions that look the same as a line of a chunk."""
    golden = _read(spark, d, "golden_public").select("query_id", canonical.question_of(F.col("query")).alias("question"))
    chunks = _read(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "text")
    return canonical.same_lines(chunks, "chunk_id", "text", golden, "query_id", "question")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Canonical form of every chunk and golden query."""
    c = _read(spark, d, "chunks").select(F.lit("chunks").alias("tab"), F.col("id").cast("long").alias("id"), "text")
    g = _read(spark, d, "golden_public").select(F.lit("golden_public").alias("tab"), F.col("query_id").cast("long").alias("id"), F.col("query").alias("text"))
    return canonical.with_canonical(c.unionByName(g).distinct(), "text", "text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages of whole chats, in order."""
    return conversations.rebuild(spark, f"{d}/messages.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of different documents that say nearly the same."""
    members, pairs = near_duplicates.similar_classes(_read(spark, d, "chunks"), "id", "doc_id", "text", threshold=0.8, min_words=60)
    return near_duplicates.similar_pairs(members, pairs)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of chunks of different documents that say nearly the same: a row per chunk with its group's smallest id and its path."""
    members, pairs = near_duplicates.similar_classes(_read(spark, d, "chunks"), "id", "doc_id", "text", threshold=0.8, min_words=60)
    linked = connected_components(pairs, "class_a", "class_b").select(F.col("node").alias("class"), "component")
    alone = members.groupBy("class").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a != b").join(linked, "class", "left_anti")
    rows = members.join(linked.unionByName(alone.select("class", F.col("class").alias("component"))), "class")
    first = rows.groupBy("component").agg(F.min("id").alias("group"))
    paths = _read(spark, d, "documents").select("doc_id", "path")
    return rows.join(first, "component").select("group", "id", F.col("doc").alias("doc_id")).join(paths, "doc_id", "left").select("group", "id", "doc_id", "path")


VECTORS = {"chunks": "id", "memories": "id", "answer_cache": "cache_key"}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of a table, each among the other's 10 most similar, at cosine 0.9 or more."""
    found = None
    for table, key in VECTORS.items():
        # a pair that similar is ranked by pairs that similar, so less similar ones are never needed
        similar = neighbours.most_similar(_read(spark, d, table), key, "embedding", dim=64, k=10, min_cosine=0.9)
        part = neighbours.mutual(similar, 0.9).select(F.lit(table).alias("tab"), "key_a", "key_b")
        found = part if found is None else found.unionByName(part)
    return found


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar vectors of the same table for every row whose id is divisible by 20 (of keys that are text: a hash of it), searched among all rows."""
    found = None
    for table, key in VECTORS.items():
        number = F.conv(F.substring(F.md5("cache_key"), 1, 8), 16, 10).cast("long") if key == "cache_key" else F.col(key)
        similar = neighbours.most_similar(_read(spark, d, table), key, "embedding", dim=64, k=10, asked=number % 20 == 0)
        part = similar.select(F.lit(table).alias("tab"), "key", "other", F.round("cosine", 6).alias("cosine"))
        found = part if found is None else found.unionByName(part)
    return found


CONTAINER_TOKENS = 2048


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of its parts."""
    sizes = packing.token_sizes(_read(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "tokens", CONTAINER_TOKENS).withColumnRenamed("size", "tokens")


def p6_savings(spark: SparkSession, d: str) -> DataFrame:
    """Containers of every block of documents: the least possible, those of best fit, those of the genetic search."""
    sizes = packing.token_sizes(_read(spark, d, "documents"), "doc_id", "text")
    return packing.savings(sizes, "doc_id", "tokens", CONTAINER_TOKENS)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items of which a document contains a passage."""
    found = contamination.leaks(_read(spark, d, "documents"), "doc_id", "text", _read(spark, d, "eval_items"), "item_id", "text", min_words=13)
    return found.select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual language."""
    found = toxicity.scored(_read(spark, d, "documents"), "doc_id", "text")
    return found.filter(F.col("score") >= toxicity.THRESHOLD).select("doc_id").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents with such language per source."""
    docs = _read(spark, d, "documents")
    return toxicity.rates(docs, "doc_id", "source", toxicity.scored(docs, "doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_found, p2_groups, p3_found, p3_pieces, p4_found, p4_forms, p5_found, p5_neighbours, p6_containers, p6_savings, p7_found, p8_found, p8_rates)}
