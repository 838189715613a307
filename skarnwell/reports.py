"""Reports on a catalog's tables: health, refusals looked up again, listings, answers' quality, topics, symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarnwell.operators import analytics
from skarnwell.store import never_index


def document_list(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, source, indexed_at, chunks) in order of the path; documents without chunks count 0."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    rows = documents.select("doc_id", "path", "source", "indexed_at").join(n, "doc_id", "left")
    return rows.select("path", "source", "indexed_at", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks")).orderBy("path")


def newest_first(rows: DataFrame, *columns: str) -> DataFrame:
    """Memories or corrections by falling id, each id once."""
    return rows.dropDuplicates(["id"]).select("id", *columns).orderBy(F.desc("id"))


def health(documents: DataFrame, chunks: DataFrame, patterns: list[str], indexed_with: str = "", current: str = "", oldest: int = 5) -> DataFrame:
    """One row: documents, chunks, never_index (documents that match a pattern), oldest (paths), embedder_matches. All from counts and one top-k."""
    n = documents.agg(F.count("*").alias("documents"))
    c = chunks.agg(F.count("*").alias("chunks"))
    bad = never_index(documents, patterns).agg(F.count("*").alias("never_index")) if patterns else documents.limit(1).agg(F.lit(0).cast("long").alias("never_index"))
    old = documents.filter("mtime > 0").orderBy("mtime", "doc_id").limit(oldest).agg(F.transform(F.sort_array(F.collect_list(F.struct("mtime", "doc_id", "path"))), lambda x: x["path"]).alias("oldest"))
    return n.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(bad)).crossJoin(F.broadcast(old)).withColumn("embedder_matches", F.lit(bool(indexed_with) and indexed_with == current))


def refusal_probe(refused: DataFrame, hits: DataFrame, most: int = 10) -> DataFrame:
    """refused (question, count, last_seen, resolved) with best_hit and best_cosine of the first `most`: what a search (question, place, path, cosine) finds now."""
    first = refused.orderBy(F.desc("count"), F.desc("last_seen"), "question").limit(most)
    best = hits.filter("place = 1").select("question", F.col("path").alias("best_hit"), F.round("cosine", 3).alias("best_cosine"))
    return first.join(best, "question", "left")


def skip_sample(skipped: DataFrame, most: int = 12) -> DataFrame:
    """(reason, files, sample): how many files were skipped for each reason, and the first `most` paths of all."""
    first = skipped.orderBy("path").limit(most).groupBy("reason").agg(F.sort_array(F.collect_list("path")).alias("sample"))
    return skipped.groupBy("reason").agg(F.count("*").alias("files")).join(F.broadcast(first), "reason", "left").withColumn("sample", F.coalesce("sample", F.array().cast("array<string>")))


def answer_quality(per_answer: DataFrame) -> DataFrame:
    """One row from (grounded_ratio, citation_valid, judge_ratio): means over the answers that have them, and judge_coverage, the share that was judged."""
    n = F.greatest(F.count("*"), F.lit(1))
    return per_answer.agg(
        F.count("*").alias("answers"), F.round(F.coalesce(F.avg("grounded_ratio"), F.lit(0.0)), 6).alias("grounded_ratio"), F.round(F.coalesce(F.avg(F.col("citation_valid").cast("double")), F.lit(0.0)), 6).alias("citation_valid"),
        F.round(F.coalesce(F.avg("judge_ratio"), F.lit(0.0)), 6).alias("judge_ratio"), F.round(F.count("judge_ratio") / n, 6).alias("judge_coverage"),
    )


def topic_map(documents: DataFrame, vectors: DataFrame, key: str, vector: str, text: str, samples: int = 5) -> DataFrame:
    """(cluster, label, documents, paths): the largest topics with their distinctive terms and a few paths. documents: key, path, text."""
    c = analytics.topic_clusters(vectors, key, vector)
    rows = c.join(documents.select(key, "path", text), key)
    labels = analytics.distinctive_terms(rows.select(F.col("cluster").alias("label"), text), "label", text)
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy("path"))
    paths = rows.withColumn("_n", nth).filter(F.col("_n") <= samples).groupBy("cluster").agg(F.first("size").alias("documents"), F.sort_array(F.collect_list("path")).alias("paths"))
    return paths.join(labels.select(F.col("label").alias("cluster"), F.col("terms").alias("label")), "cluster").select("cluster", "label", "documents", "paths")


def topic_points(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x, y): the vectors on their first two principal components, for a picture of the topics."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    xy = PCA(k=2, inputCol="v", outputCol="p").fit(v).transform(v).withColumn("p", vector_to_array("p"))
    return xy.select(key, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def reanchored(sites: DataFrame, texts: DataFrame, window: int = 40) -> DataFrame:
    """sites (kind, path, line, text) with lines moved to where the text stands in the file (path, body), if it does within `window` lines: the nearest such line, the earlier of two."""
    plain = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    rows = sites.join(texts.select("path", F.split("body", "\n").alias("_lines")), "path", "left")
    first, last = F.greatest(F.col("line") - window, F.lit(1)), F.least(F.col("line") + window - 1, F.size("_lines"))
    near = F.filter(F.sequence(first, F.greatest(first, last)), lambda n: F.startswith(plain(F.get("_lines", (n - 1).cast("int"))), F.rtrim(F.replace(F.col("text"), F.lit("…"), F.lit("")))))
    best = F.array_min(F.transform(near, lambda n: F.struct(F.abs(n - F.col("line")).alias("d"), n.alias("n"))))
    return rows.withColumn("line", F.coalesce(best["n"], F.col("line")).cast("long")).drop("_lines")


def symbol_answer(sites: DataFrame, name: str) -> DataFrame:
    """One row, the answer to a question about a symbol: counts, numbered definitions and call sites, where else it is mentioned. No row if it is neither defined nor called."""
    nth = F.row_number().over(Window.orderBy(F.when(F.col("kind") == "definition", 0).otherwise(1), "path", "line"))
    shown = sites.filter("kind != 'mention'").withColumn("n", nth)
    line = F.format_string("- %s:%d — `%s` [%d]", "path", "line", "text", "n")
    listed = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", line.alias("t"))))), lambda x: x["t"]), "\n")
    parts = shown.agg(F.sum((F.col("kind") == "definition").cast("long")).alias("d"), F.sum((F.col("kind") == "call").cast("long")).alias("c"), listed("definition").alias("ds"), listed("call").alias("cs"))
    per_path = sites.filter("kind = 'mention'").groupBy("path").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "path").limit(5)
    also = per_path.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("m"), "path"))), lambda x: F.format_string("%s (%d×)", x["path"], -x["m"])), ", ").alias("also"))
    block = lambda title, rows: F.when(rows != "", F.concat(F.lit(f"\n\n{title}:\n"), rows)).otherwise("")
    text = F.concat(F.format_string(f"`{name}` — %d definition(s), %d call site(s).", "d", "c"), block("Defined in", F.col("ds")), block("Called from", F.col("cs")), F.when(F.col("also") != "", F.concat(F.lit("\n\nAlso mentioned in: "), "also", F.lit("."))).otherwise(""))
    return parts.filter("d + c > 0").crossJoin(F.broadcast(also)).select(F.lit(name).alias("symbol"), text.alias("answer"))


def hits_json(hits: DataFrame) -> Column:
    """A hit as one JSON object, for machine-readable output."""
    return F.to_json(F.struct("path", "line", "ordinal", F.round("score", 4).alias("score"), F.round("cosine", 3).alias("cosine"), "lanes", "text"))


def stats_line(counts: dict[str, int]) -> str:
    """What an indexing run did, as one line."""
    return " ".join(f"{k}={counts[k]}" for k in sorted(counts))
