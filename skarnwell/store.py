"""A catalog of immutable snapshots: tables as Parquet, and a pointer to the one that counts."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarnwell import schema
from skarnwell.files import Folder
from skarnwell.functions import text as T

TABLES = {"documents": schema.DOCUMENTS, "chunks": schema.CHUNKS, "parents": schema.PARENTS, "chats": schema.CHATS, "messages": schema.MESSAGES, "memories": schema.MEMORIES, "corrections": schema.CORRECTIONS, "answer_cache": schema.ANSWER_CACHE, "embed_cache": schema.EMBED_CACHE}
FORMAT = "2.0"  # bundles of another major version are refused
BUCKETS = 64  # parts of a table by a hash of doc_id; an update writes those that it changes
PARTED = ("documents", "chunks", "parents")


class EmbedderMismatch(RuntimeError):
    """The catalog holds vectors of another embedder."""


def bucket(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS))


class Catalog:
    """Tables under a folder of any file system. A commit writes new versions of what it changes and swaps one pointer file; readers of the old snapshot go on undisturbed.

    The pointer names, for every table, the folders that it consists of: one, or one for each bucket of documents.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.address, self.folder = spark, str(folder).rstrip("/"), Folder(spark, folder)
        self.folder.make()

    @property
    def manifest(self) -> dict:
        try:
            return json.loads(self.folder.read("CURRENT"))
        except FileNotFoundError:
            return {"format": FORMAT, "revision": "", "tables": {}, "meta": {}}

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or only the given buckets of it."""
        at = self.manifest["tables"].get(name, {})
        parts = [v for k, v in at.items() if buckets is None or k == "all" or int(k) in buckets]
        empty = self.spark.createDataFrame([], TABLES[name])
        if not parts:
            return empty
        found = self.spark.read.parquet(*[f"{self.address}/{x}" for x in parts])
        missing = [f for f in empty.schema if f.name not in found.columns]
        found = found.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else found
        return found.filter(bucket(F.col("doc_id")).isin(buckets)) if buckets is not None and "all" in at else found

    def commit(self, tables: dict[str, DataFrame] | None = None, meta: dict | None = None, touched: list[int] | None = None) -> str:
        """Writes tables, then swaps the pointer; an interrupted commit leaves the old snapshot in place.

        With touched, the tables of documents hold the new rows of these buckets only, and the other buckets stay as they are.
        """
        m = self.manifest
        revision = uuid.uuid4().hex
        for name, df in (tables or {}).items():
            new = f"{name}-{revision}"
            if name not in PARTED:
                df.write.parquet(f"{self.address}/{new}")
                m["tables"][name] = {"all": new}
                continue
            old = m["tables"].get(name, {})
            if "all" in old and touched is not None:
                raise ValueError(f"{name} is not in buckets")
            df.withColumn("bucket", bucket(F.col("doc_id"))).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.address}/{new}")
            kept = {} if touched is None else {k: v for k, v in old.items() if int(k) not in touched}
            written = [x for x in Folder(self.spark, f"{self.address}/{new}").names(folders=True) if x.startswith("bucket=")]
            m["tables"][name] = kept | {x.partition("=")[2]: f"{new}/{x}" for x in written}
        m["meta"].update(meta or {})
        m |= {"format": FORMAT, "revision": revision, "time": time.time()}
        self.folder.write("CURRENT", json.dumps(m))
        return revision

    def ensure_embedder(self, name: str, dim: int) -> None:
        """Sets the embedder with the first vectors; refuses another one after that."""
        have = self.manifest["meta"].get("embedder")
        if have is None:
            self.commit(meta={"embedder": [name, dim]})
        elif have != [name, dim]:
            raise EmbedderMismatch(f"the catalog was built with {have[0]} ({have[1]}), not {name} ({dim})")

    def backup(self, keep: int = 5, protect: str | None = None) -> str:
        """Keeps the current pointer as a backup; of the backups the newest `keep` and a protected one remain. Tables are shared, not copied."""
        name = f"BACKUP-{time.time_ns()}"
        self.folder.write(name, self.folder.read("CURRENT"))
        for old in sorted(self._backups(), reverse=True)[keep:]:
            if old != protect:
                self.folder.remove(old)
        return name

    def _backups(self) -> list[str]:
        return [n for n in self.folder.names(folders=False) if n.startswith("BACKUP-")]

    def restore(self, name: str) -> None:
        """Goes back to a backup, after a backup of what there is."""
        self.backup(protect=name)
        self.folder.write("CURRENT", self.folder.read(name))

    def vacuum(self) -> list[str]:
        """Removes parts of tables that neither the pointer nor a backup names, and returns the folders that are gone."""
        used = {part for n in ["CURRENT", *self._backups()] for at in json.loads(self.folder.read(n))["tables"].values() for part in at.values()}
        tops = {x.partition("/")[0] for x in used}
        tops.add(f"index-{self.manifest['revision']}")  # see indexes.py
        gone = [n for n in self.folder.names(folders=True) if n not in tops]
        for n in gone:
            self.folder.remove(n)
        for top in sorted({x.partition("/")[0] for x in used} - used):
            parts = Folder(self.spark, f"{self.address}/{top}")
            for x in parts.names(folders=True):
                if f"{top}/{x}" not in used:
                    parts.remove(x)
                    gone.append(f"{top}/{x}")
        return sorted(gone)

    def export_bundle(self, target: str) -> None:
        """Copies the current snapshot and its manifest; the target must not exist."""
        m, to = self.manifest, Folder(self.spark, target)
        if to.exists("CURRENT"):
            raise FileExistsError(target)
        to.make()
        for at in m["tables"].values():
            for part in at.values():
                to.copy_from(self.folder, part)
        to.write("CURRENT", json.dumps(m))

    def import_bundle(self, source: str) -> None:
        """Takes over a bundle, after a backup; refuses one of another major version or embedder."""
        bundle = Folder(self.spark, source)
        m, mine = json.loads(bundle.read("CURRENT")), self.manifest
        if str(m["format"]).partition(".")[0] != FORMAT.partition(".")[0]:
            raise ValueError(f"bundle of format {m['format']}; this is {FORMAT}")
        if mine["meta"].get("embedder") and m["meta"].get("embedder") != mine["meta"]["embedder"]:
            raise EmbedderMismatch(f"bundle of {m['meta'].get('embedder')}; this catalog is of {mine['meta']['embedder']}")
        if mine["revision"]:
            self.backup()
        for at in m["tables"].values():
            for part in at.values():
                self.folder.copy_from(bundle, part)
        self.folder.write("CURRENT", json.dumps(m))


def classify(documents: DataFrame, found: DataFrame, config: str) -> DataFrame:
    """(path, state): new, changed, touched, unchanged or missing, by one full join of stored and found files.

    found: path, mtime, content_hash. The time decides first (within a microsecond, same chunking); else the hash does, and only the time changes.
    """
    d = documents.select("path", F.col("mtime").alias("old_mtime"), F.col("content_hash").alias("old_hash"), F.col("chunk_config").alias("old_config"), F.lit(True).alias("stored"))
    f = found.select("path", "mtime", "content_hash", F.lit(True).alias("there"))
    same_config = F.coalesce(F.col("old_config") == config, F.lit(False))
    same_time = F.coalesce(F.abs(F.col("mtime") - F.col("old_mtime")) < 1e-6, F.lit(False))
    state = (
        F.when(F.col("stored").isNull(), "new").when(F.col("there").isNull(), "missing").when(same_config & same_time, "unchanged")
        .when(same_config & F.coalesce(F.col("old_hash") == F.col("content_hash"), F.lit(False)), "touched").otherwise("changed")
    )
    return d.join(f, "path", "full").select("path", state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_documents(catalog_tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The documents, chunks and parents without those of the documents named in gone (doc_id)."""
    ids = gone.select("doc_id").distinct()
    return {n: df.join(ids, "doc_id", "left_anti") for n, df in catalog_tables.items()}


def never_index(documents: DataFrame, patterns: list[str]) -> DataFrame:
    """Documents whose path, or its last part, matches a shell pattern."""
    return documents.filter(T.matches_any(F.col("path"), patterns))


def under_any(path: Column, roots: list[str]) -> Column:
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r.rstrip("/") + "/")
    return out


def missing_local(documents: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """Local documents under the roots that the listing no longer has; relative roots are ignored."""
    absolute = [r for r in roots if r.startswith("/")]
    d = documents.filter((F.col("source") == "local") & under_any(F.col("path"), absolute))
    return d.join(listing.select("path"), "path", "left_anti")


def with_metadata(documents: DataFrame, given: str, text: str) -> DataFrame:
    """documents with `metadata`: the given one, overridden by the front matter of Markdown and plain text."""
    marked = T.extension(F.col("path")).isin("md", "markdown", "txt", "")
    parsed = F.when(marked, T.front_matter(F.col(text))).otherwise(F.create_map().cast("map<string,string>"))
    kept = F.map_filter(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(parsed, k))
    return documents.withColumn("metadata", F.map_concat(kept, parsed))
