"""Search indexes that are kept beside a catalog's snapshot and made again when it changes."""

from __future__ import annotations

from skarnwell.operators import lexical
from skarnwell.search import Corpus
from skarnwell.store import Catalog


def indexed_corpus(catalog: Catalog) -> Corpus:
    """The catalog's documents with postings and statistics of its chunks, stored under the snapshot's revision and made on first use.

    Postings are sorted by term, so that a batch of queries reads the row groups of its terms only. An index of an older snapshot is removed by vacuum().
    """
    revision = catalog.manifest["revision"]
    documents, chunks, parents = (catalog.table(n) for n in ("documents", "chunks", "parents"))
    if not revision:
        return Corpus(documents, chunks, parents)
    name = f"index-{revision}"
    at = f"{catalog.address}/{name}"
    if not catalog.folder.exists(f"{name}/stats/_SUCCESS"):
        texts = chunks.dropDuplicates(["id"]).select("id", "text")
        lexical.postings(texts, "id", "text").repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/postings")
        lexical.corpus_stats(texts, "text").coalesce(1).write.mode("overwrite").parquet(f"{at}/stats")  # last: its mark says that the index is whole
    read = catalog.spark.read.parquet
    return Corpus(documents, chunks, parents, index=(read(f"{at}/postings"), read(f"{at}/stats")))
