"""The best few rows of every query: what each task keeps, in bounded pieces, and how the pieces of all tasks are merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from skarnwell.durable import checkpointed

PIECE = 512  # queries of a piece
BARS_ROWS = 65_536  # rows of a sample whose best give every query a first bar
CHANCE = 1e-6  # of a high bar that too few rows reach, so that its query is searched again


def kept_schema(kind: str) -> str:
    return f"b int, q array<int>, k array<{kind}>, score array<double>"


def _order(q: np.ndarray, k: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, ranks from 0) of the best `top` rows per query, by score, then key."""
    tie = np.unique(k, return_inverse=True)[1] if k.dtype == object else k
    o = np.lexsort((tie, -score, q))
    sq = q[o]
    first = np.flatnonzero(np.concatenate([[True], sq[1:] != sq[:-1]]))
    rank = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
    keep = rank < top
    return o[keep], rank[keep]


class Best:
    """The best `top` rows of numbered queries, ties by key. `bar` is what a row must reach to count: never more than the score of the query's best `top`-th row of all."""

    def __init__(self, queries: int, top: int, bar: np.ndarray | float = -np.inf):
        self.top, self.bar = top, np.full(queries, bar, np.float64) if np.isscalar(bar) else np.array(bar, np.float64)
        pieces = -(-queries // PIECE)
        self.rows: list[list[tuple]] = [[] for _ in range(pieces)]
        self.held = [0] * pieces

    def add(self, b: int, q: np.ndarray | int, k: np.ndarray, score: np.ndarray) -> None:
        if len(k):
            self.rows[b].append((np.full(len(k), q, np.int32) if np.isscalar(q) else q, k, score))
            self.held[b] += len(k)
            if self.held[b] > 4 * self.top * PIECE:
                self._cut(b)

    def _cut(self, b: int) -> None:
        q, k, score = (np.concatenate(x) for x in zip(*self.rows[b], strict=True))
        o, rank = _order(q, k, score, self.top)
        q, k, score = q[o].astype(np.int32), k[o], score[o]
        last = rank == self.top - 1
        self.bar[q[last]] = np.maximum(self.bar[q[last]], score[last])
        self.rows[b], self.held[b] = [(q, k, score)], len(q)

    def batches(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """What is kept, as rows of kept_schema: one for each piece that has any."""
        for b in range(len(self.rows)):
            if self.rows[b]:
                self._cut(b)
                ((q, k, score),), self.rows[b] = self.rows[b], []
                columns = [pa.array(np.array([b], np.int32)), *(_listed(pa.array(x, t)) for x, t in ((q, pa.int32()), (k, kind), (score, pa.float64())))]
                yield pa.RecordBatch.from_arrays(columns, names=["b", "q", "k", "score"])


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _together(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("q", "k", "score"))


def merged(kept: DataFrame, ids: list, kinds: tuple[str, str], top: int) -> DataFrame:
    """(q, k, score, rank): the best `top` rows per query of what all tasks kept; ids are the queries by number, or lists of those that ask the same."""
    alike = [x if isinstance(x, list) else [x] for x in ids]
    names = [x for same in alike for x in same]
    times = np.array([len(x) for x in alike], np.int64)
    begin = np.cumsum(times) - times
    asked = to_arrow_type(_parse_datatype_string(kinds[0]))

    def run(rows: pa.Table) -> pa.Table:
        q, k, score = _together(rows)
        o, rank = _order(q, k, score, top)
        n = times[q[o]]  # rows of a query are given once for each that asks the same
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        name = np.repeat(begin[q[o]], n) + nth
        first = name.min() if len(name) else 0
        name = pa.array(names[first : name.max() + 1] if len(name) else [], asked).take(pa.array(name - first))
        o, rank = np.repeat(o, n), np.repeat(rank, n)
        return pa.table({"q": name, "k": pa.array(k[o], rows.schema.field("k").type.value_type), "score": score[o], "rank": (rank + 1).astype(np.int64)})

    return kept.groupBy("b").applyInArrow(run, f"q {kinds[0]}, k {kinds[1]}, score double, rank bigint")


def bars(kept: DataFrame, queries: int, top: int, least: float, nth: int) -> np.ndarray:
    """Two lines: the score of every query's `top`-th row in what was kept of a sample, `least` where there are fewer; and that of its `nth`, the former where there are fewer."""

    def run(rows: pa.Table) -> pa.Table:
        q, k, score = _together(rows)
        o, rank = _order(q, k, score, top)
        some = (rank == top - 1) | (rank == nth - 1)
        return pa.table({"q": q[o[some]].astype(np.int32), "bar": score[o[some]], "last": rank[some] == top - 1})

    found = kept.groupBy("b").applyInArrow(run, "q int, bar double, last boolean").toArrow()
    q, bar, last = (found[c].to_numpy() for c in ("q", "bar", "last"))
    out = np.full((2, queries), least, np.float64)
    out[0, q[last]] = np.maximum(least, bar[last])
    out[1, q[~last]] = bar[~last]
    return np.array([out[0], out.max(0)])


def high_rank(part: float, top: int) -> int:
    """The least r such that of a query's best `top` rows hardly ever r are in a sample that has this part of all rows: then the r-th row of the sample is a bar that `top` rows reach. `top` where there is none less."""
    tail = 0.0
    for r in range(top, 0, -1):
        tail += comb(top, r) * part**r * (1 - part) ** (top - r)
        if tail >= CHANCE:
            return min(top, r + 1)
    return 1


def kept_over(keep: Callable[[np.ndarray], DataFrame], bar: np.ndarray, top: int) -> tuple[DataFrame, np.ndarray]:
    """(what tasks keep under the high of two bars, the queries that have to be searched again with the low one, since fewer than `top` rows reach the high one)."""
    kept, queries = checkpointed(keep(bar[1])), bar.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(queries, np.int32)
        for x in batches:
            n += np.bincount(x.column("q").flatten().to_numpy(), minlength=queries).astype(np.int32)
        yield pa.RecordBatch.from_arrays([_listed(pa.array(n))], names=["n"])

    n = np.zeros(queries, np.int64)
    for x in kept.select("q").mapInArrow(run, "n array<int>").toArrow()["n"].chunks:
        n += x.flatten().to_numpy().reshape(-1, queries).sum(0)
    return kept, np.flatnonzero((n < top) & (bar[1] > bar[0]))


def sampled(rows: DataFrame, key: str, n: int) -> DataFrame | None:
    """About BARS_ROWS of many rows, in as many tasks as run at once; None where the rows are not many more than that."""
    if n < 4 * BARS_ROWS:
        return None
    part = rows.filter(F.pmod(F.xxhash64(key), F.lit(n // BARS_ROWS)) == 0)
    return part.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))


def sampled_part(n: int) -> float:
    """The part that `sampled` takes of n rows."""
    return 1 / (n // BARS_ROWS)
