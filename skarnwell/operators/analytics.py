"""Corpus analytics: duplicates, related documents, topics, symbols, rollups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarnwell.durable import checkpointed
from skarnwell.functions import text as T
from skarnwell.operators.components import connected_components
from skarnwell.operators.dense import centroids, dense_topk


def sources(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, documents, chunks, last_indexed); documents without chunks count. Chunks are counted per document before the join."""
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    rows = documents.select("doc_id", "source", "indexed_at").join(per_doc, "doc_id", "left")
    return rows.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"), F.max("indexed_at").alias("last_indexed"))


def roots_rollup(documents: DataFrame, chunks: DataFrame, roots: list[str]) -> DataFrame:
    """(root, documents, chunks) of the documents at or under each path prefix; roots without documents have zeros.

    A document meets its roots by equi-join of the prefixes of its path that end before a slash, so the number of roots does not matter.
    """
    spark = documents.sparkSession
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    r = spark.createDataFrame([(x,) for x in dict.fromkeys(roots)], "root string")
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    under = documents.select("doc_id", F.explode(prefixes).alias("root")).join(r, "root", "left_semi")
    rows = under.join(per_doc, "doc_id", "left").groupBy("root").agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"))
    return r.join(rows, "root", "left").na.fill(0)


PART_CHUNKS = 2000


def document_text(chunks: DataFrame, part_chunks: int = PART_CHUNKS) -> DataFrame:
    """(doc_id, part, text): chunks joined by blank lines in order. A part holds the ordinals of one range of part_chunks, so that a document that keeps growing gets more rows, not longer ones."""
    rows = chunks.dropDuplicates(["id"]).groupBy("doc_id", F.floor(F.col("ordinal") / part_chunks).cast("long").alias("part"))
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("ordinal", "id", "text"))).alias("pieces"))
    return rows.select("doc_id", "part", F.array_join(F.transform("pieces", lambda p: p["text"]), "\n\n").alias("text"))


def shared_digests(chunks: DataFrame, documents: DataFrame, min_ratio: float = 0.5, min_shared: int = 3) -> DataFrame:
    """(a, b, shared, ratio), a < b: documents that share at least min_shared distinct chunk texts, and min_ratio of those of the one with fewer.

    Documents with equal sets of digests form one class first, so that a page copied a million times costs one row; a class is linked as a star to its
    first document. Of two documents that share at least t of the n digests of the one with fewer, some shared digest is among the n - t + 1 rarest
    of that one (prefix filter); so only these are joined with the digests of larger documents, and a line that all documents have
    meets only documents that consist of such lines. Candidates are counted exactly by joins; no set is collected.
    """
    d = chunks.join(documents.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.xxhash64(F.sha1(F.col("text").cast("binary"))).alias("digest")).distinct()
    per_doc = d.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("digest").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit("x"), "digest")).alias("x")).filter(F.col("n") >= min_shared)
    cls = per_doc.groupBy("n", "h", "x").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    members = per_doc.join(cls, ["n", "h", "x"]).select("doc_id", "rep", "n")
    reps = d.join(cls.select(F.col("rep").alias("doc_id"), "n"), "doc_id")
    shared = reps.groupBy("digest").agg(F.count("*").alias("freq")).filter("freq > 1")
    reps = checkpointed(reps.join(shared, "digest"))
    least = F.greatest(F.lit(min_shared), F.ceil(F.col("n") * min_ratio - 1e-9))
    own = Window.partitionBy("doc_id").orderBy("freq", "digest")
    rare = reps.withColumn("nth", F.row_number().over(own)).withColumn("of", F.count("*").over(Window.partitionBy("doc_id"))).filter(F.col("nth") <= F.col("of") - least + 1)
    few = rare.select(F.col("doc_id").alias("s"), "digest", F.col("n").alias("ns"))
    many = reps.select(F.col("doc_id").alias("l"), "digest", F.col("n").alias("nl"))
    candidates = few.join(many, "digest").filter("ns < nl or (ns = nl and s < l)").select("s", "l", "ns").distinct()
    own = reps.select(F.col("doc_id").alias("s"), "digest")
    both = candidates.join(own, "s").join(reps.select(F.col("doc_id").alias("l"), "digest"), ["l", "digest"])
    pairs = both.groupBy("s", "l").agg(F.count("*").alias("shared"), F.first("ns").alias("n")).select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"), "shared", "n")
    star = members.filter("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.col("n").alias("shared"), "n")
    rows = pairs.unionByName(star).withColumn("ratio", F.round(F.col("shared") / F.col("n"), 3))
    return rows.filter((F.col("shared") >= min_shared) & (F.col("shared") / F.col("n") >= min_ratio)).select("a", "b", "shared", "ratio")


def duplicate_clusters(chunks: DataFrame, documents: DataFrame, min_ratio: float = 0.5, min_shared: int = 3) -> DataFrame:
    """(cluster, doc_id, shared, ratio): documents that share much, grouped; shared and ratio are the cluster's largest."""
    pairs = checkpointed(shared_digests(chunks, documents, min_ratio, min_shared))  # read by the components and again for the largest shares
    comp = connected_components(pairs)
    best = pairs.join(comp.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.max("shared").alias("shared"), F.max("ratio").alias("ratio"))
    return comp.join(best, "component").select(F.col("component").alias("cluster"), F.col("node").alias("doc_id"), "shared", "ratio")


def related_documents(chunks: DataFrame, dim: int, doc_ids: DataFrame, top: int = 5) -> DataFrame:
    """(doc_id, other, score, rank): the documents whose mean vector is most similar to that of each document named."""
    c = centroids(chunks, "doc_id", "embedding", dim)
    q = c.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    near = dense_topk(c.withColumnRenamed("doc_id", "other"), "other", "centroid", q, "doc_id", "centroid", dim, top + 1).filter("doc_id != other")
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.asc("other"))
    return near.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)


def topic_clusters(vectors: DataFrame, key: str, vector: str, threshold: float = 0.75, most: int = 2000, clusters: int = 40) -> DataFrame:
    """(cluster, size, key): greedy leader clustering of the first `most` keys, in their order; the 40 largest clusters.

    The order-dependent fold runs in one task, over an input whose size is fixed by `most`: that limit is part of the feature.
    """
    kind = dict(vectors.dtypes)[key]
    first = vectors.orderBy(key).limit(most)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(n == 0, 1, n)
        means, sizes, member = np.zeros((0, v.shape[1])), [], []
        for x in v:
            c = -1
            if len(means):
                m = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
                s = m @ x
                c = int(s.argmax()) if s.max() >= threshold else -1
            if c < 0:
                means, c = np.vstack([means, x]), len(sizes)
                sizes.append(0)
            else:
                means[c] += (x - means[c]) / (sizes[c] + 1)
            sizes[c] += 1
            member.append(c)
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i])[:clusters]
        place = {c: i for i, c in enumerate(order)}
        return pd.DataFrame([(place[c], sizes[c], k) for c, k in zip(member, pdf["k"], strict=True) if c in place], columns=["cluster", "size", "k"])

    out = first.select(F.lit(0).alias("one"), F.col(key).alias("k"), F.col(vector).alias("v")).groupBy("one").applyInPandas(fold, f"cluster long, size long, k {kind}")
    return out.withColumnRenamed("k", key)


def distinctive_terms(labelled: DataFrame, label: str, text: str, top: int = 5, least: int = 2) -> DataFrame:
    """(label, terms): per label the terms whose share of its texts most exceeds their share of all texts; at least `least` texts, three letters."""
    words = labelled.select(label, F.explode(F.array_distinct(T.index_tokens(F.col(text)))).alias("term")).filter("length(term) >= 3")
    total = labelled.agg(F.count("*").alias("total"))
    sizes = labelled.groupBy(label).agg(F.count("*").alias("size"))
    here = words.groupBy(label, "term").agg(F.count("*").alias("n"))
    everywhere = here.groupBy("term").agg(F.sum("n").alias("all_n"))
    rows = here.filter(F.col("n") >= least).join(everywhere, "term").join(sizes, label).crossJoin(F.broadcast(total))
    rows = rows.withColumn("score", F.round(F.col("n") / F.col("size") - F.col("all_n") / F.col("total"), 9))
    w = Window.partitionBy(label).orderBy(F.desc("score"), F.desc("term"))
    best = rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= top)
    listed = best.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("nth", "term"))).alias("t"))
    return sizes.select(label).join(listed, label, "left").select(label, F.coalesce(F.array_join(F.transform("t", lambda x: x["term"]), ", "), F.lit("(mixed)")).alias("terms"))


#: File endings whose lines may define or call symbols.
CODE_EXTENSIONS = ("py", "js", "jsx", "ts", "tsx", "mjs", "cjs", "go", "rs", "java", "kt", "kts", "swift", "cs", "rb", "php", "sh", "bash", "zsh", "fish", "pl", "lua", "scala", "ex", "exs", "c", "h", "cc", "cpp", "hpp", "m", "mm", "sql", "tf")


#: A line that defines {0}: words that may stand before, a word that defines, the name.
DEFINES = r"^\s*(?:(?:export|public|private|protected|static|async|abstract|final|pub|default)\s+)*(?:def|class|function|fn|func|struct|enum|trait|interface|type|const|let|var|val|impl)\s+{0}\b"


def symbol_sites(chunks: DataFrame, documents: DataFrame, name: str, limit: int = 25, mentions: int = 8) -> DataFrame:
    """(kind, path, line, text): where a symbol is defined, called or mentioned; one site per path and line, definitions and calls in code files only."""
    import re

    n = re.escape(name)
    lines = chunks.filter(F.contains("text", F.lit(name))).join(documents.select("doc_id", "path"), "doc_id").select("path", "line_start", F.posexplode(F.split("text", "\n")).alias("at", "line_text"))
    lines = lines.filter(F.col("line_text").rlike(rf"\b{n}\b"))
    code = T.extension(F.col("path")).isin(*CODE_EXTENSIONS)
    define = F.col("line_text").rlike(DEFINES.format(n))
    kind = F.when(code & define, "definition").when(code & F.col("line_text").rlike(rf"\b{n}\s*\("), "call").otherwise("mention")
    rows = lines.select(kind.alias("kind"), "path", (F.when(F.col("line_start") > 0, F.col("line_start")).otherwise(1) + F.col("at")).cast("long").alias("line"), T.snippet(F.col("line_text")).alias("text"))
    rows = rows.groupBy("path", "line").agg(F.min("kind").alias("kind"), F.min("text").alias("text"))
    rank = F.when(F.col("kind") == "definition", 0).when(F.col("kind") == "call", 1).otherwise(2)
    w = Window.partitionBy("kind").orderBy("path", "line")
    kept = rows.withColumn("nth", F.row_number().over(w)).filter((F.col("nth") <= limit) & ((F.col("kind") != "mention") | (F.col("nth") <= mentions)))
    return kept.orderBy(rank, "path", "line").select("kind", "path", "line", "text")


def hash_sample(rows: DataFrame, group: str, key: list[str], n: int) -> DataFrame:
    """A sample that depends on the data only: one row per group, and of those the n first, in the order of a hash of the key."""
    h = F.sha2(F.concat_ws(":", *key).cast("binary"), 256)
    w = Window.partitionBy(group).orderBy("_h", *key)
    one = rows.withColumn("_h", h).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return one.orderBy("_h").limit(n).drop("_h", "_n")


def duplicate_pairs_of_lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Documents' distinct trimmed lines as chunks, for shared_digests on texts that have no chunks."""
    return documents.select(F.col(key).alias("doc_id"), F.explode(F.split(text, "\n")).alias("text")).select("doc_id", F.trim("text").alias("text")).filter("text != ''")
