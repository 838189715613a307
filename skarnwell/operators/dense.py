"""Exact vector similarity for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarnwell.durable import checkpointed
from skarnwell.operators.best import PIECE, Best, bars, high_rank, kept_over, kept_schema, merged, sampled, sampled_part
from skarnwell.operators.lexical import in_scope, scoped_texts

BLOCK_BYTES = 64 << 20  # query vectors sent to the tasks at once
BLOCK_QUERIES, CELLS = 32_768, 1 << 22  # queries of a block, and components of vectors that a task holds at once
MANY_QUERIES = 1024  # from here on vectors are prepared once, and a sample gives first bars
SAMPLE_DIM = 256  # components of vectors of which a sample goes to all tasks
SAMPLE_STEP = 8192  # vectors of a sample whose best are taken first
LOWEST, OUT = -2.0, -9.0  # below any cosine; what is out of a query's scope


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)"


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns; a zero vector counts as of length one."""
    norm = lambda x: f"(case when {dot(x, x)} = 0 then 1D else sqrt({dot(x, x)}) end)"
    return F.expr(f"{dot(a, b)} / ({norm(a)} * {norm(b)})")


def usable(vectors: DataFrame, vector: str, dim: int) -> DataFrame:
    return vectors.filter((F.size(vector) == dim) & ~F.forall(F.col(vector), lambda x: x.eqNullSafe(0)) & ~F.exists(vector, lambda x: x.isNull()))


def dense_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, dim: int, top: int, scope: DataFrame | None = None, min_cosine: float | None = None, digits: int = 6, group: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, key, score, rank): the exact `top` most similar vectors per query, ties by key.

    The stated queries go to the tasks in blocks of bounded size; each task multiplies its batches with a block and keeps its own best.
    Of many vectors a sample is searched first: what the best of a query there reach is a bar for all, so that the tasks keep little else than
    the best of all. Scores are rounded before they are ranked. Candidates may be restricted, always before the
    cut: by scope (query_id, key), or by group, the columns of vectors and queries that must be equal (and not null).
    """
    spark = vectors.sparkSession
    label = lambda side: (F.col(group[side]) if group else F.lit("")).cast("string").alias("g")
    q = usable(queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"), label(1)), "v", dim).filter("q is not null and g is not null")
    total = q.count()
    blocks = max(1, -(-total // max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * dim)))))
    v = usable(vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"), label(0)), "v", dim).filter("k is not null")
    if total > MANY_QUERIES:
        q, v = checkpointed(q), checkpointed(v)
    n = v.count() if total > MANY_QUERIES else 0
    kinds = dict(q.dtypes)["q"], dict(v.dtypes)["k"]
    out = spark.createDataFrame([], f"q {kinds[0]}, k {kinds[1]}, score double, rank bigint")
    block = F.pmod(F.xxhash64("v"), F.lit(blocks))  # equal vectors in one block, unless it is too many
    if blocks > 1 and (q.groupBy(block).count().agg(F.max("count")).first()[0] or 0) > 4 * -(-total // blocks):
        block = F.pmod(F.xxhash64("q"), F.lit(blocks))
    for b in range(blocks):
        rows = q.filter(block == b).toArrow()
        if not rows.num_rows:
            continue
        ids = rows["q"].to_pylist()
        m = _unit(_matrix(rows["v"].combine_chunks(), dim))
        labels = np.array(rows["g"].to_pylist(), object) if group else None
        if scope is None and labels is None:  # queries of the same vector are searched once
            same: dict[bytes, list[int]] = {}
            for j, x in enumerate(m):
                same.setdefault(x.tobytes(), []).append(j)
            ids, m = [[ids[j] for j in x] for x in same.values()], m[[x[0] for x in same.values()]]
        part = v if scope is None else v.join(scoped_texts(spark, scope, query_id, key, ids, kinds[0]), "k")
        least = LOWEST if min_cosine is None else min_cosine
        keep = lambda rows, bar: rows.mapInArrow(_best(m, top, bar, digits, labels), kept_schema(kinds[1]))  # noqa: B023, E731
        some = sampled(part, "k", n)
        if some is None:
            out = out.unionByName(merged(keep(part, least), ids, kinds, top))
            continue
        if scope is not None or labels is not None or dim > SAMPLE_DIM:
            out = out.unionByName(merged(keep(part, bars(keep(some, least), len(ids), top, least, top)[0]), ids, kinds, top))
            continue
        bar = np.maximum(least, _bars(spark, m, _unit(_matrix(some.select("v").toArrow()["v"].combine_chunks(), dim)).astype(np.float32), top, digits, high_rank(sampled_part(n), top)))
        kept, few = kept_over(lambda high: keep(part, high), bar, top)  # noqa: B023
        if len(few):
            again = part.mapInArrow(_best(m[few], top, bar[0, few], digits, None), kept_schema(kinds[1]))
            out = out.unionByName(merged(again, [ids[j] for j in few], kinds, top))
            for j in few:
                ids[j] = []
        out = out.unionByName(merged(kept, ids, kinds, top))
    return out.select(F.col("q").alias(query_id), F.col("k").alias(key), "score", "rank")


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _bars(spark: SparkSession, m: np.ndarray, sample: np.ndarray, top: int, digits: int, nth: int | None = None) -> np.ndarray:
    """For every query a score that `top` vectors of the sample reach, LOWEST where there are fewer: every task has the whole sample, in single precision, and some of the queries.
    With `nth` two lines: these, and scores that so many reach."""
    single, sample = m.astype(np.float32), sample[np.isfinite(sample).all(1)]
    error = (m.shape[1] + 8) * 2.0**-24 + 10.0**-digits
    out = np.full((2, len(m)), LOWEST)
    if len(sample) < top:
        return out if nth else out[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, over = _buffered(PIECE * max(top, SAMPLE_STEP, SAMPLE_STEP // 4))
        for a in (b * PIECE for batch in batches for b in batch.column("id").to_pylist()):
            q = single[a : a + PIECE]
            s = product(q, sample[: max(top, SAMPLE_STEP)])
            first = np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top :]
            low = first.min(1)
            at, values = [np.repeat(np.arange(len(q)), top)], [first.ravel()]
            for c in range(max(top, SAMPLE_STEP), len(sample), SAMPLE_STEP // 4):
                s = product(q, sample[c : c + SAMPLE_STEP // 4])
                found = over(s, np.nextafter(low, np.float32(9)))
                at.append(found // s.shape[1])
                values.append(s.ravel()[found])
            at, values = np.concatenate(at), np.concatenate(values)
            o = np.lexsort((-values, at))
            first = np.searchsorted(at[o], np.arange(len(q)))
            reached = [pa.array(values[o[first + n - 1]].astype(np.float64) - error) for n in (top, nth or top)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(q))), *reached], names=["q", "bar", "high"])

    pieces = -(-len(m) // PIECE)
    found = spark.range(0, pieces, 1, min(pieces, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "q long, bar double, high double").toArrow()
    out[:, found["q"].to_numpy()] = found["bar"].to_numpy(), found["high"].to_numpy()
    return out if nth else out[0]


def _buffered(most: int):
    """(product of two lists of vectors, places of its flattened rows that are not under each row's low): both in memory that is used again for every call, up to `most` pairs."""
    pairs, reached = np.empty(most, np.float32), np.zeros(most + 8, bool)

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.matmul(a, b.T, out=pairs[: len(a) * len(b)].reshape(len(a), len(b)))

    def over(s: np.ndarray, low: np.ndarray) -> np.ndarray:
        np.greater_equal(s, low[:, None], out=reached[: s.size].reshape(s.shape))
        reached[s.size : s.size + 8] = False
        eight = reached[: -(-s.size // 8) * 8].reshape(-1, 8)
        some = np.flatnonzero(eight.view(np.uint64))  # few are, so eight at once
        at, place = np.nonzero(eight[some])
        return some[at] * 8 + place

    return product, over


def _best(m: np.ndarray, top: int, bar: np.ndarray | float, digits: int, labels: np.ndarray | None):
    """Similarities are taken in single precision to see which may count, and only of those exactly."""
    dim = m.shape[1]
    error = (dim + 8) * 2.0**-24 + 10.0**-digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind, single = Best(len(m), top, bar), None, m.astype(np.float32)
        if labels is not None:
            number = {g: n for n, g in enumerate(dict.fromkeys(labels))}
            mine = np.array([number[g] for g in labels])
        step = max(1, min(2048, CELLS // dim))
        product, over = _buffered(PIECE * step)
        for batch in (x.slice(a, step) for x in batches for a in range(0, x.num_rows, step)):
            kind = batch.column("k").type
            keys = batch.column("k").to_numpy(zero_copy_only=False)
            x = _unit(_matrix(batch.column("v"), dim))
            finite = np.isfinite(x).all(1)
            if not finite.all():
                batch, keys, x = batch.filter(pa.array(finite)), keys[finite], x[finite]
            x32 = x.astype(np.float32)
            scope = in_scope(batch.column("scope").to_pylist(), len(m)) if "scope" in batch.schema.names else None
            theirs = np.array([number.get(g, -1) for g in batch.column("g").to_pylist()]) if labels is not None else None
            for b, a in enumerate(range(0, len(m), PIECE)):
                s = product(single[a : a + PIECE], x32)
                if scope is not None:
                    s[~scope[:, a : a + PIECE].T] = OUT
                if labels is not None:
                    s[mine[a : a + PIECE, None] != theirs] = OUT
                low = best.bar[a : a + PIECE]
                if s.shape[1] > top and low.min() <= LOWEST:  # no bars yet
                    low[:] = np.maximum(low, np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top] - error)
                low = np.maximum(low, LOWEST) - error
                found = over(s, np.nextafter(low.astype(np.float32), np.float32(-9)))
                q, j = np.divmod(found, s.shape[1])
                q += a
                exact = np.round(np.einsum("ij,ij->i", m[q], x[j]), digits)
                keep = exact >= best.bar[q]
                best.add(b, q[keep].astype(np.int32), keys[j[keep]], exact[keep])
        if kind is not None:
            yield from best.batches(kind)

    return run


def _rows(ids: list, keys: np.ndarray, scores: np.ndarray, least: float | None) -> Iterator[pd.DataFrame]:
    keep = np.isfinite(scores) if least is None else scores >= least
    q, j = np.nonzero(keep)
    if len(q):
        names = np.empty(len(ids), object)
        names[:] = ids
        yield pd.DataFrame({"q": names[q], "k": keys[q, j], "score": scores[q, j]})


def centroids(vectors: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """(group, centroid): mean vector per group, as JVM aggregates of the components with partial aggregation before the shuffle."""
    v = usable(vectors, vector, dim)
    means = v.groupBy(group).agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"c{i}") for i in range(dim)])
    return means.select(group, F.array(*[f"c{i}" for i in range(dim)]).alias("centroid"))
