"""Incremental indexing of found texts into a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarnwell.durable import checkpointed
from skarnwell.functions import text as T
from skarnwell.operators import chunking
from skarnwell.operators.embed import Embedder, embedded
from skarnwell.sources.files import skip_reason
from skarnwell.store import Catalog, bucket, classify, delete_documents, with_metadata


def doc_id(source: Column, path: Column) -> Column:
    """The same path in two sources is two documents."""
    return F.xxhash64(source, F.lit("\u0000"), path)


def index(catalog: Catalog, found: DataFrame, source: str, embedder: Embedder, prune: bool = True, max_chars: int = chunking.MAX_CHARS, overlap: int = chunking.OVERLAP) -> dict[str, int]:
    """Brings the documents of a source up to what was found (path, text, mtime); returns how many were new, changed and so on.

    Only new and changed texts are chunked and embedded, each distinct chunk text once. Files that are gone are removed with their
    chunks and parents when `prune` is set. Without text a file is left out (see skipped()). Running it again changes nothing. Of the catalog, only
    the buckets of documents that are new, changed, touched or gone are read and written again.
    """
    catalog.ensure_embedder(embedder.name, embedder.dim)
    config = chunking.chunk_config(max_chars, overlap)
    found = found.withColumn("metadata", F.create_map().cast("map<string,string>")) if "metadata" not in found.columns else found
    rows = with_metadata(found, "metadata", "text").withColumn("body", T.without_front_matter(F.col("text")))
    rows = checkpointed(rows.select("path", "mtime", "metadata", "body", F.sha2(F.col("body").cast("binary"), 256).alias("content_hash")).filter("body is not null and path is not null").dropDuplicates(["path"]))
    own = catalog.table("documents").filter(F.col("source") == source)
    states = checkpointed(classify(own, rows, config))
    counts = {r.state: r["count"] for r in states.groupBy("state").count().collect()}  # five rows at most
    fresh = rows.join(states.filter("state in ('new', 'changed')").select("path"), "path", "left_semi")
    gone = own.join(states.filter(F.col("state").isin(["changed", "missing"] if prune else ["changed"])).select("path"), "path", "left_semi")
    if not any(counts.get(s) for s in ("new", "changed", "touched")) and not (prune and counts.get("missing")):
        return counts
    moved = states.filter("state = 'touched'").join(rows.select("path", F.col("mtime").alias("new_mtime")), "path").select("path", "new_mtime")
    doc = checkpointed(fresh.select(doc_id(F.lit(source), F.col("path")).alias("doc_id"), F.lit(source).alias("source"), "path", "content_hash", "mtime", "metadata", F.lit(config).alias("chunk_config"), F.current_timestamp().alias("indexed_at"), "body"))
    changed = doc.select("doc_id").unionByName(gone.select("doc_id")).unionByName(own.join(moved, "path", "left_semi").select("doc_id"))
    touched = [r.b for r in changed.select(bucket(F.col("doc_id")).alias("b")).distinct().collect()]  # a fixed number at most
    old = {n: catalog.table(n, touched) for n in ("documents", "chunks", "parents")}
    kept = delete_documents(old, gone)
    mine = F.col("source") == source
    kept["documents"] = kept["documents"].join(moved, "path", "left").withColumn("mtime", F.coalesce(F.when(mine & (F.col("new_mtime") > 0), F.col("new_mtime")), "mtime")).drop("new_mtime")
    chunks = checkpointed(chunking.chunked(doc, "doc_id", "body", max_chars, overlap))
    vectors = embedded(chunks.select("text").distinct(), "text", embedder)
    new_chunks = chunks.join(vectors, "text").withColumn("id", F.xxhash64("doc_id", "ordinal"))
    catalog.commit({
        "documents": kept["documents"].unionByName(doc.drop("body"), allowMissingColumns=True),
        "chunks": kept["chunks"].unionByName(new_chunks, allowMissingColumns=True),
        "parents": kept["parents"].unionByName(chunking.parents(chunks, "doc_id"), allowMissingColumns=True),
    }, meta={f"report:{source}": counts}, touched=touched)
    return counts


def index_one(catalog: Catalog, path: str, text: str, mtime: float, source: str, embedder: Embedder) -> dict[str, int]:
    """Indexes one document, as index() does without pruning: only the buckets it lies in are written."""
    row = catalog.spark.createDataFrame([(path, text, mtime)], "path string, text string, mtime double")
    return index(catalog, row, source, embedder, prune=False)


def skipped(found: DataFrame, root: str = "") -> DataFrame:
    """(path, reason) of files (path, length, text) that are not indexed: not admitted, or without text."""
    why = F.coalesce(skip_reason(F.col("path"), F.col("length"), root), F.when(F.col("text").isNull(), "no text"))
    return found.select("path", why.alias("reason")).filter("reason is not null")
