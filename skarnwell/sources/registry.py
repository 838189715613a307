"""Saved sync jobs and the loaders they name."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skarnwell.sources import files

PROVIDERS: dict[str, Callable[..., DataFrame]] = {}


def provider(name: str):
    """Registers a loader (spark, **params) -> DataFrame of path and text."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        PROVIDERS[name] = f
        return f

    return add


def job_id(name: str, params: dict) -> str:
    return hashlib.sha1(f"{name}|{json.dumps(params, sort_keys=True)}".encode()).hexdigest()[:12]


def run_job(spark: SparkSession, name: str, params: dict) -> DataFrame:
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](spark, **params)


@provider("local")
def local(spark: SparkSession, path: str) -> DataFrame:
    found = files.listing(spark, path, content=True).filter(files.admitted(F.col("path"), F.col("length"), path))
    return files.extracted(found)


@provider("s3")
def s3(spark: SparkSession, bucket: str, prefix: str = "") -> DataFrame:
    return local(spark, f"s3a://{bucket}/{prefix}")


@provider("archive")
def archive(spark: SparkSession, path: str, prefix: str, folder: str = "") -> DataFrame:
    return files.archive_members(files.listing(spark, path, content=True), prefix, folder)


@provider("mbox")
def mbox(spark: SparkSession, path: str) -> DataFrame:
    return files.mbox_documents(files.listing(spark, path, content=True)).select("path", "text")


class PagedSource(DataSource):
    """Base of connectors to services that list pages of items: give `pages` and `fetch`. One partition per page, so that pages are fetched in parallel."""

    @classmethod
    def name(cls) -> str:
        return "skarnwell_paged"

    def schema(self) -> str:
        return "path string, text string, title string, mtime double"

    def pages(self) -> list:
        raise NotImplementedError

    def fetch(self, page) -> list[tuple]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self)


class _Page(InputPartition):
    def __init__(self, page):
        super().__init__(page)


class _PagedReader(DataSourceReader):
    def __init__(self, source: PagedSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return [_Page(p) for p in self.source.pages()]

    def read(self, partition: InputPartition):
        yield from self.source.fetch(partition.value)
