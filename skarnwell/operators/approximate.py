"""Approximate vector search by cells, for collections too large to compare with every vector."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarnwell.operators.dense import _matrix, _rows, _unit, dense_topk, usable
from skarnwell.operators.lexical import keep_best, ranked

EXACT_ROWS = 200_000  # up to this many vectors the exact search is as fast
MOST_PROBED = 0.25  # share of the cells beyond which the exact search, which sends no vector from task to task, does less
MOST_ROWS = 65_536  # rows that a task makes of queries and their cells at once
SAMPLE_ROWS, MOST_CELLS, CELL_ROWS = 65_536, 4096, 50_000  # vectors that cells are fitted on, cells, and vectors of a cell that one task compares


def backend(rows: int, scoped: bool = False) -> str:
    """Which search to use: a restricted one is always exact."""
    return "exact" if scoped or rows <= EXACT_ROWS else "cells"


def fit_cells(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Spherical k-means on unit vectors; an empty cell takes the vector that lies farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own, near = _nearest_cell(x, c)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = np.bincount(own, minlength=cells) == 0
        total[empty] = x[np.argsort(near)[: empty.sum()]]
        c = _unit(total)
    return c


def _nearest_cell(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, near = np.empty(len(x), np.int64), np.empty(len(x))
    for a in range(0, len(x), 4096):
        s = x[a : a + 4096] @ c.T
        own[a : a + 4096] = s.argmax(1)
        near[a : a + 4096] = s.max(1)
    return own, near


def probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float, asked: int = 512, seed: int = 0) -> int:
    """How many cells must be searched so that this share of the k nearest of some sampled vectors, among the sample, lies in them."""
    q = np.random.default_rng(seed).choice(len(x), min(asked, len(x)), replace=False)
    most = min(k, len(x) - 1)
    near = np.empty((len(q), most), np.int64)
    for a in range(0, len(q), 64):
        s = x[q[a : a + 64]] @ x.T
        s[np.arange(len(s)), q[a : a + 64]] = -2
        near[a : a + 64] = np.argpartition(s, -most, axis=1)[:, -most:]
    place = np.empty((len(q), len(c)), np.int64)
    np.put_along_axis(place, np.argsort(-(x[q] @ c.T), axis=1), np.arange(len(c))[None, :], 1)
    own, _ = _nearest_cell(x, c)
    return int(np.quantile(np.take_along_axis(place, own[near], 1), recall, method="higher")) + 1


def search(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, dim: int, top: int, recall: float = 0.98, cells: int | None = None, exact_rows: int = EXACT_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, key, score, rank): the `top` most similar vectors per query: exact up to exact_rows vectors, else from the cells nearest to the query.

    Cells are fitted on a bounded sample, every vector lies in one. The number of cells searched is what the sample needs for `recall`. Vectors
    and queries meet by cell, so that every query is sent once for each cell searched: where that is a large share of all cells, as for vectors without
    near neighbours, the search is exact after all. A cell with more than cell_rows vectors is divided at random over several tasks, so that a dense region is no hot key.
    Unusable vectors and null keys take no part, as in dense_topk.
    """
    n = vectors.count()
    if n <= exact_rows:
        return dense_topk(vectors, key, vector, queries, query_id, query_vector, dim, top)
    v = usable(vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v")), "v", dim).filter("k is not null")
    q = usable(queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<float>").alias("qv")), "qv", dim).filter("q is not null")
    share = min(1.0, 0.9 * SAMPLE_ROWS / n)
    rows = v.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(SAMPLE_ROWS).toArrow()
    if not rows.num_rows:
        return dense_topk(vectors, key, vector, queries, query_id, query_vector, dim, top)
    x = _unit(_matrix(rows["v"].combine_chunks(), dim))
    c = fit_cells(x, max(1, min(cells or int(2 * math.sqrt(n)), MOST_CELLS, len(x) // 8)))
    probes = probes_for(x, c, max(1, math.ceil(top * len(x) / n)), recall)
    if probes > MOST_PROBED * len(c):
        return dense_topk(vectors, key, vector, queries, query_id, query_vector, dim, top)
    kinds = dict(q.dtypes)["q"], dict(v.dtypes)["k"]
    placed = v.mapInPandas(_cells_of(c, 1, "v"), f"cell int, k {kinds[1]}, v array<float>")
    parts = {r.cell: -(-r["count"] // cell_rows) for r in placed.groupBy("cell").count().collect()}  # one row a cell
    some = F.get(F.array(*[F.lit(parts.get(j, 1)) for j in range(len(c))]), F.col("cell"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("k"), some).cast("int"))
    asked = q.mapInPandas(_cells_of(c, probes, "qv"), f"cell int, q {kinds[0]}, qv array<float>").withColumn("part", F.explode(F.sequence(F.lit(0), some - 1)))
    found = asked.groupBy("cell", "part").cogroup(placed.groupBy("cell", "part")).applyInPandas(_compare(top), f"q {kinds[0]}, k {kinds[1]}, score double")
    return ranked(found.select(F.col("q").alias(query_id), F.col("k").alias(key), "score"), query_id, key, "score", top)


def _cells_of(c: np.ndarray, probes: int, column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, min(2048, MOST_ROWS // probes))
        for pdf in batches:
            for a in range(0, len(pdf), step):
                part = pdf.iloc[a : a + step]
                s = _unit(np.stack(part[column].to_numpy()).astype(np.float64)) @ c.T
                best = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes < len(c) else np.broadcast_to(np.arange(len(c)), s.shape)
                out = part.iloc[np.repeat(np.arange(len(part)), best.shape[1])].copy()
                out.insert(0, "cell", best.ravel().astype(np.int32))
                yield out

    return run


def _compare(top: int):
    def run(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": asked["q"].iloc[:0], "k": there["k"].iloc[:0], "score": np.zeros(0)})]
        if len(asked) and len(there):
            x = _unit(np.stack(there["v"].to_numpy()).astype(np.float64))
            for a in range(0, len(asked), 1024):
                part = asked.iloc[a : a + 1024]
                m = _unit(np.stack(part["qv"].to_numpy()).astype(np.float64))
                keys = scores = None
                for b in range(0, len(x), 4096):
                    s = np.round(x[b : b + 4096] @ m.T, 6).T
                    keys, scores = keep_best(keys, scores, np.broadcast_to(there["k"].to_numpy()[b : b + 4096], s.shape), s, top, np.finfo(np.float64).min)
                out += list(_rows(list(part["q"]), keys, scores, None))
        return pd.concat(out) if len(out) > 1 else out[0]

    return run
