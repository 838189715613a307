"""Embedders as vectorized functions, with a cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarnwell.functions import text as T


class Embedder(Protocol):
    """A provider of vectors; called in the tasks on batches of texts."""

    name: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of plain tokens, of unit length; needs no model."""

    name = "hash"

    def __init__(self, dim: int = 4096):
        self.dim = dim

    def place(self, token: str) -> tuple[int, int]:
        d = hashlib.blake2b(token.encode(), digest_size=8).digest()
        return int.from_bytes(d[:4], "little") % self.dim, 1 if d[4] % 2 == 0 else -1

    @staticmethod
    def tokens(text: str) -> list[str]:
        words = (w.strip(".,;:!?()[]{}`'\"#*_-") for w in text.lower().split())
        return [w for w in words if w and w not in _STOP]

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, t in zip(out, texts, strict=True):
            for w in self.tokens(t):
                i, s = self.place(w)
                row[i] += s
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


#: What models of a family expect before questions and passages; others get nothing.
PROMPTS = {"embeddinggemma": ("task: search result | query: ", "title: none | text: "), "multilingual-e5": ("query: ", "passage: "), "multilingual-gte": ("", ""), "bge-m3": ("", "")}


def prompts(model: str) -> tuple[str, str]:
    """(question, passage) prefixes of a model's family."""
    return next((p for name, p in PROMPTS.items() if name in model.lower()), ("", ""))


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors from token states (texts, tokens, dim): the mean over the tokens that are no padding."""
    m = mask[:, :, None].astype(np.float32)
    v = (hidden * m).sum(1) / np.maximum(m.sum(1), 1)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


class OnnxEmbedder:
    """A model from an ONNX file and a tokenizer file that every executor can read; opened in the task. For questions ask for `of_questions`."""

    def __init__(self, name: str, model: str, tokenizer: str, dim: int, max_tokens: int = 512, of_questions: bool = False):
        self.name, self.model, self.tokenizer, self.dim, self.max_tokens = name, model, tokenizer, dim, max_tokens
        self.prefix = prompts(name)[0 if of_questions else 1]
        self._open = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._open is None:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.tokenizer)
            tokenizer.enable_truncation(self.max_tokens)
            tokenizer.enable_padding()
            self._open = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"]), tokenizer
        session, tokenizer = self._open
        encoded = tokenizer.encode_batch([self.prefix + t for t in texts])
        every = {"input_ids": [e.ids for e in encoded], "attention_mask": [e.attention_mask for e in encoded], "token_type_ids": [e.type_ids for e in encoded]}
        hidden = session.run(None, {i.name: np.array(every[i.name], np.int64) for i in session.get_inputs()})[0]
        return mean_pool(hidden, np.array(every["attention_mask"])) if hidden.ndim == 3 else hidden


class HttpEmbedder:
    """A model behind an HTTP service that takes {"model", "input"} and returns {"embeddings"}; asked from the tasks."""

    def __init__(self, url: str, model: str, dim: int, of_questions: bool = False, timeout: float = 60.0):
        self.url, self.name, self.dim, self.timeout = url, model, dim, timeout
        self.prefix = prompts(model)[0 if of_questions else 1]

    def embed(self, texts: list[str]) -> np.ndarray:
        import json
        from urllib.request import Request, urlopen

        body = json.dumps({"model": self.name, "input": [self.prefix + t for t in texts]}).encode()
        with urlopen(Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
            v = np.array(json.load(r)["embeddings"], np.float32)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(n == 0, 1, n)


_STOP = frozenset(T.STOPWORDS)


def embedded(rows: DataFrame, text: str, embedder: Embedder, out: str = "embedding", batch: int = 16) -> DataFrame:
    """rows with the vectors of a text column; null texts have null vectors."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            got: list = [None] * len(s)
            known = [i for i, t in enumerate(s) if t is not None]
            for a in range(0, len(known), batch):
                part = known[a : a + batch]
                for i, v in zip(part, embedder.embed([s.iloc[i] for i in part]), strict=True):
                    got[i] = v
            yield pd.Series(got)

    return rows.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def cache_misses(rows: DataFrame, text: str, cache: DataFrame, embedder: Embedder) -> DataFrame:
    """(key, text): the distinct texts that the cache has no vector for."""
    keyed = rows.select(F.col(text).alias("text")).filter("text is not null").distinct().withColumn("key", T.embed_key(embedder.name, embedder.dim, F.col("text")))
    return keyed.join(cache.select("key"), "key", "left_anti").select("key", "text")


def with_cache(rows: DataFrame, text: str, cache: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """(rows with embedding, vectors new to the cache): only texts not in the cache are embedded, each once."""
    new = embedded(cache_misses(rows, text, cache, embedder), "text", embedder).select("key", "embedding")
    every = cache.select("key", "embedding").unionByName(new)
    keyed = rows.withColumn("_key", T.embed_key(embedder.name, embedder.dim, F.col(text)))
    out = keyed.join(every.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
    return out, new


def embedded_topk(texts: DataFrame, key: str, text: str, queries: DataFrame, query_id: str, query: str, embedder: Embedder, top: int) -> DataFrame:
    """(query_id, key, score, rank): the texts most similar to each query by an embedder that runs in the tasks; positive cosines only.

    Wide vectors of texts are made where they are compared and never stored or shuffled; queries go to the tasks in bounded blocks.
    """
    from skarnwell.operators.lexical import keep_best, ranked

    q = queries.select(F.col(query_id).alias("q"), F.col(query).alias("t")).filter("q is not null and t is not null")
    t = texts.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = f"q {dict(q.dtypes)['q']}, k {dict(t.dtypes)['k']}, score double"
    out = texts.sparkSession.createDataFrame([], schema)
    blocks = max(1, -(-q.count() * embedder.dim * 8 // (64 << 20)))
    for b in range(blocks):
        rows = q.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()
        if rows:
            ids = np.empty(len(rows), object)
            ids[:] = [r.q for r in rows]
            out = out.unionByName(t.mapInPandas(_embedded_best(ids, embedder.embed([r.t for r in rows]).astype(np.float64), embedder, top, keep_best), schema))
    return ranked(out.select(F.col("q").alias(query_id), F.col("k").alias(key), "score"), query_id, key, "score", top)


def _embedded_best(ids: np.ndarray, m: np.ndarray, embedder: Embedder, top: int, keep_best):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, scores = None, None
        for pdf in batches:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a : a + 512]
                s = np.round(embedder.embed(list(part["t"])).astype(np.float64) @ m.T, 6).T
                keys, scores = keep_best(keys, scores, np.broadcast_to(part["k"].to_numpy(), s.shape), np.maximum(s, 0), top, 1e-12)
        if keys is not None:
            q, j = np.nonzero(scores > 0)
            if len(q):
                yield pd.DataFrame({"q": ids[q], "k": keys[q, j], "score": scores[q, j]})

    return run
