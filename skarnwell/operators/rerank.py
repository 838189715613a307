"""Reranking of hits by a model that reads question and text together."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarnwell.functions import text as T

BATCH_PAIRS, MAX_TOKENS = 8, 512
SPACES = re.compile(r"[ \t\n\r\f\v]+")


class Reranker(Protocol):
    """A provider of scores for pairs of question and text; made in the tasks by a factory and called on small batches."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class JaccardReranker:
    """Deterministic stand-in that needs no model: the share of plain words that both sides have."""

    @staticmethod
    def words(text: str) -> set[str]:
        return {w for w in (x.strip(".,;:!?()[]{}`'\"#*_-") for x in SPACES.split(text.lower())) if w and w not in T.STOPWORDS}

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        sides = [(self.words(a), self.words(b)) for a, b in pairs]
        return [len(a & b) / max(1, len(a | b)) for a, b in sides]


class OnnxReranker:
    """A cross-encoder from an ONNX file and a tokenizer file that every executor can read."""

    def __init__(self, model: str, tokenizer: str, max_tokens: int = MAX_TOKENS):
        import onnxruntime
        from tokenizers import Tokenizer

        self.session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.tokenizer.enable_truncation(max_tokens)
        self.tokenizer.enable_padding()

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        encoded = self.tokenizer.encode_batch(pairs)
        every = {"input_ids": [e.ids for e in encoded], "attention_mask": [e.attention_mask for e in encoded], "token_type_ids": [e.type_ids for e in encoded]}
        inputs = {i.name: np.array(every[i.name], np.int64) for i in self.session.get_inputs()}
        return self.session.run(None, inputs)[0].reshape(len(pairs), -1)[:, 0].tolist()


def model_rerank(ranked: DataFrame, query_id: str, question: Column, text: Column, model: Callable[[], Reranker], batch: int = BATCH_PAIRS) -> DataFrame:
    """ranked with `relevance` by the model and `reranked`: highest first, ties in the order given (`rank`). Null texts count as empty ones.

    Only the few rows of each question that are left before reranking are scored, in Arrow batches, `batch` pairs at a time.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = model()
        for q, t in batches:
            pairs = list(zip(q.fillna(""), t.fillna(""), strict=True))
            yield pd.Series([s for a in range(0, len(pairs), batch) for s in m.score(pairs[a : a + batch])], dtype=float)

    rows = ranked.withColumn("relevance", F.round(F.pandas_udf(run, "double")(question, text), 6))
    w = Window.partitionBy(query_id).orderBy(F.desc("relevance"), F.asc("rank"))
    return rows.withColumn("reranked", F.row_number().over(w).cast("long"))


def label(spec: str) -> str:
    """Short name of a reranker given as `provider:owner/model` or a path."""
    return spec.rpartition(":")[2].rstrip("/").rpartition("/")[2]
