"""The k most similar vectors of every vector, by a forest of random-projection trees.

The trees are fitted on a bounded sample and every vector is indexed. A vector lies in one leaf of each
tree; its search goes down all trees at once and visits the leaves that are cheapest to reach, chosen
over all trees by one priority queue. In a leaf, one-byte codes of the vectors select candidates, which
are then ranked by the exact cosine of the stored vectors. A leaf that holds far more vectors than it was meant
to, because the sample could not tell more leaves apart, is divided by a forest of its own in the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarnwell.durable import checkpointed

SAMPLE_ROWS = 65_536  # the forest is fitted on at most this many vectors
LEAF_ROWS = 2048  # vectors meant to lie in one leaf
CODE_ERROR = 0.01  # ten standard deviations of what one-byte codes change a cosine by
PROBES = 12  # leaves that a vector visits at least
MISSED = 0.01  # share of the neighbours within the sample that may lie in leaves not visited
SPLIT = 4  # times its meant size from which a leaf is divided in its task
WIDE = 64  # of more candidates than this that codes can't tell apart, the stored vectors decide in the leaf


@dataclass
class Tree:
    """A complete binary tree: at node i (root 1) go right where x @ planes[i] > cuts[i]."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int


def fit_tree(x: np.ndarray, depth: int, seed: int) -> Tree:
    """Splits each node across the line between two means of two random points, at the median."""
    rng = np.random.default_rng(seed)
    planes = np.zeros((1 << depth, x.shape[1]), np.float32)
    cuts = np.zeros(1 << depth, np.float32)
    nodes = {1: np.arange(len(x))}
    for _ in range(depth):
        below = {}
        for i, rows in nodes.items():
            p = rng.standard_normal(x.shape[1]).astype(np.float32)
            if len(rows) > 1:
                two = x[rng.choice(rows, 2, replace=False)]
                some = x[rng.choice(rows, min(len(rows), 256), replace=False)]
                for _ in range(3):
                    left = some @ (two[0] - two[1]) > 0
                    if left.all() or not left.any():
                        break
                    two = np.stack([some[left].mean(0), some[~left].mean(0)])
                p = p if not np.any(two[0] != two[1]) else two[0] - two[1]
            p = p / np.linalg.norm(p)
            y = x[rows] @ p
            planes[i], cuts[i] = p, np.median(y) if len(rows) else 0
            right = y > cuts[i]
            below[2 * i], below[2 * i + 1] = rows[~right], rows[right]
        nodes = below
    return Tree(planes, cuts, depth)


def search_leaves(forest: list[Tree], x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaves, own), both (rows, probes): the leaves cheapest to reach over all trees, own leaves first.

    The cost of a leaf is the sum of the squared distances to the planes crossed against the vector's side.
    """
    leaves, costs = [], []
    for t, tree in enumerate(forest):
        node, cost = np.ones((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
        for _ in range(tree.depth):
            y = np.einsum("rpd,rd->rp", tree.planes[node], x) - tree.cuts[node]
            node = np.concatenate([2 * node, 2 * node + 1], axis=1)
            cost = np.concatenate([cost + np.maximum(y, 0) ** 2, cost + np.minimum(y, 0) ** 2], axis=1)
            # a cut hit exactly sends a vector left, as in fit_tree
            cost[:, len(cost[0]) // 2 :] += np.where(y == 0, np.float32(1e-12), np.float32(0))
            if node.shape[1] > probes:
                k = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
                node, cost = np.take_along_axis(node, k, 1), np.take_along_axis(cost, k, 1)
        leaves.append(node + (t << 40))
        costs.append(cost)
    leaf, cost = np.concatenate(leaves, axis=1), np.concatenate(costs, axis=1)
    own = cost == 0
    k = np.argsort(cost, axis=1, kind="stable")[:, : max(probes, len(forest))]
    return np.take_along_axis(leaf, k, 1), np.take_along_axis(own, k, 1)


def probes_needed(forest: list[Tree], x: np.ndarray, k: int, least: float | None, per_node: int = 8) -> np.ndarray:
    """How many leaves vectors must visit to meet their k nearest in x, by their node on level 8 (or the last) of the first tree.

    Some vectors of every node are compared with all of x. A node gets what its own vectors need and at least what
    all need together, so that a dense region gets more visits than the rest.
    """
    depth = forest[0].depth
    level = min(depth, 8)
    home = np.stack([_leaf(tree, x) for tree in forest])
    node = home[0] >> (depth - level)
    leaves = len(forest) << depth
    rng = np.random.default_rng(0)
    shuffled = rng.permutation(len(x))
    order = shuffled[np.argsort(node[shuffled], kind="stable")]
    start = np.searchsorted(node[order], np.arange(1 << level, 2 << level))
    end = np.append(start[1:], len(order))
    asked = np.concatenate([order[a : min(b, a + per_node)] for a, b in zip(start, end, strict=True)])
    ranks, of = [], []
    step = max(1, min(64, (1 << 19) // (leaves * x.shape[1])))
    for i in range(0, len(asked), step):
        q = asked[i : i + step]
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -2
        n = min(k, len(x) - 1)
        best = np.argpartition(s, -n, axis=1)[:, -n:]
        leaf, _ = search_leaves(forest, x[q], leaves)
        place = np.empty((len(q), leaves), np.int64)
        np.put_along_axis(place, ((leaf >> 40) << depth) + (leaf & ((1 << 40) - 1)) - (1 << depth), np.arange(leaves)[None, :], 1)
        first = np.min([np.take_along_axis(place, (t << depth) + home[t][best] - (1 << depth), 1) for t in range(len(forest))], axis=0)
        near = np.take_along_axis(s, best, 1) >= (-1.5 if least is None else least)
        ranks.append(first[near] + 1)
        of.append(np.repeat(node[q], near.sum(1)) - (1 << level))
    ranks, of = np.concatenate(ranks), np.concatenate(of)
    most = np.quantile(ranks, 1 - MISSED, method="higher") if len(ranks) else 0
    need = np.full(1 << level, max(PROBES, most), np.int64)
    for g in np.unique(of):
        need[g] = max(need[g], np.quantile(ranks[of == g], 1 - MISSED, method="higher"))
    return np.minimum(leaves, PROBES << np.ceil(np.log2(need / PROBES)).astype(np.int64))


def _leaf(tree: Tree, x: np.ndarray) -> np.ndarray:
    node = np.ones(len(x), np.int64)
    for _ in range(tree.depth):
        node = 2 * node + (np.einsum("rd,rd->r", tree.planes[node], x) > tree.cuts[node])
    return node


def _own_leaves(forest: list[Tree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    leaf = np.stack([_leaf(tree, x) + (t << 40) for t, tree in enumerate(forest)], axis=1)
    return leaf, np.ones(leaf.shape, bool)


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def codes(x: np.ndarray) -> np.ndarray:
    return np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if not len(pdf):
            continue
        v = np.stack(pdf["vector"].to_numpy()).astype(np.float32)
        good = np.isfinite(v).all(1) & (v != 0).any(1)
        v = v[good]
        if len(v):
            # plus zero, so that both zeros are one
            raw = [r.tobytes() for r in unit(v.astype(np.float64)) + np.float32(0)]
            yield pd.DataFrame({"key": pdf["key"].to_numpy()[good], "asks": pdf["asks"].to_numpy()[good], "class": [xxhash.xxh3_128_digest(r) for r in raw], "vector": list(v)})


def _block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The vectors of a batch, as unit vectors in one binary value: what is sent to the driver stays as small as it can be."""
    for pdf in batches:
        if len(pdf):
            yield pd.DataFrame({"block": [unit(np.stack(pdf["vector"].to_numpy()).astype(np.float64)).tobytes()]})


def bars(x: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """What the cosine of each vector's k-th nearest of all is at least: that of its k-th nearest in the sample, itself not counted."""
    if len(sample) <= k:
        return np.full(len(x), -1.5, np.float32)
    return np.concatenate([np.partition(x[a : a + 256] @ sample.T, -k - 1, axis=1)[:, -k - 1] for a in range(0, len(x), 256)] or [np.zeros(0, np.float32)])


def _route(batches: Iterator[pd.DataFrame], forest: list[Tree], probes: np.ndarray, sample: np.ndarray, k: int, only: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """The visits of every vector with its code; with only, the visits to those leaves with the stored vector as code.

    probes: the number of visits by the vector's node in the first tree, as of probes_needed. bar: see bars(), by the sample given (none: no bar).
    """
    down = forest[0].depth - int(len(probes)).bit_length() + 1
    for pdf in batches:
        for b in range(0, len(pdf), 2048):
            batch = pdf.iloc[b : b + 2048]
            v = np.stack(batch["vector"].to_numpy()).astype(np.float32)
            x = unit(v.astype(np.float64))
            names = batch["class"].to_numpy()
            asks = batch["asks"].to_numpy(bool)
            bar = np.full(len(x), -1.5, np.float32)
            bar[asks] = bars(x[asks], sample, k)
            code = np.array([c.tobytes() for c in (codes(x) if only is None else v)], dtype=object)
            wanted = np.where(asks, probes[(_leaf(forest[0], x) >> down) - len(probes)], 0)  # others lie in their own leaves only
            for most in np.unique(wanted):
                alike = np.flatnonzero(wanted == most)
                step = max(16, 2048 * PROBES // max(1, int(most)))
                for a in range(0, len(alike), step):
                    part = alike[a : a + step]
                    leaf, own = search_leaves(forest, x[part], int(most)) if most else _own_leaves(forest, x[part])
                    rows = np.repeat(part, leaf.shape[1])
                    keep = slice(None) if only is None else np.isin(leaf.ravel(), only)
                    yield pd.DataFrame({"leaf": leaf.ravel()[keep], "own": own.ravel()[keep], "asks": asks[rows[keep]], "bar": bar[rows[keep]], "class": names[rows[keep]], "code": code[rows[keep]]})


def _near(c: np.ndarray, who: np.ndarray, at: np.ndarray, k: int, lowest: np.ndarray, error: float, most: int | None) -> tuple[list, list, list]:
    """For each of the rows `who`, the rows of `at` that are among its k best or may be, as (left, right); and the rows with more than `most` of them."""
    left, right, wide = [], [], []
    for a in range(0, len(who) if len(at) else 0, 1024):
        rows = who[a : a + 1024]
        s = c[rows] @ c[at].T
        n = np.searchsorted(at, rows)
        itself = (n < len(at)) & (at[np.minimum(n, len(at) - 1)] == rows)
        s[np.flatnonzero(itself), n[itself]] = -2
        bar = (lowest[rows] - error).astype(s.dtype)
        if s.shape[1] > k:
            full = np.flatnonzero((s >= bar[:, None]).sum(1) > k)
            if len(full):
                bar[full] = np.maximum(bar[full], np.partition(s[full], -k, axis=1)[:, -k] - error)
        good = s >= bar[:, None]
        many = good.sum(1) > (s.shape[1] if most is None else most)
        wide.append(rows[many])
        good[many] = False
        i, j = np.nonzero(good)
        left.append(rows[i])
        right.append(at[j])
    return left, right, wide


def _divided(c: np.ndarray, who: np.ndarray, at: np.ndarray, k: int, least: float | None, leaf_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(who, at) for the parts of a leaf that is too large: a forest fitted on a sample of its vectors, visited as the forest above it is."""
    rng = np.random.default_rng(len(at))
    x = c[rng.choice(at, min(len(at), SAMPLE_ROWS), replace=False)].astype(np.float32)
    depth = 0
    while len(at) >> depth > leaf_rows and len(x) >> depth > 8:
        depth += 1
    forest = [fit_tree(x, depth, seed) for seed in range(3)]
    visits = probes_needed(forest, x, max(1, math.ceil(k * len(x) / len(at))), least)
    level = int(len(visits)).bit_length() - 1
    own, _ = _own_leaves(forest, c[at].astype(np.float32))
    wanted = visits[(_leaf(forest[0], c[who].astype(np.float32)) >> (depth - level)) - len(visits)]
    parts: dict[int, list[np.ndarray]] = {}
    for most in np.unique(wanted):
        alike = who[wanted == most]
        for a in range(0, len(alike), 2048):
            leaf, _ = search_leaves(forest, c[alike[a : a + 2048]].astype(np.float32), int(most))
            order = np.argsort(leaf.ravel(), kind="stable")
            names, start = np.unique(leaf.ravel()[order], return_index=True)
            for name, rows in zip(names, np.split(np.repeat(alike[a : a + 2048], leaf.shape[1])[order], start[1:]), strict=True):
                parts.setdefault(int(name), []).append(rows)
    order = np.argsort(own.ravel(), kind="stable")
    names, start = np.unique(own.ravel()[order], return_index=True)
    for name, rows in zip(names, np.split(np.repeat(at, own.shape[1])[order], start[1:]), strict=True):
        if int(name) in parts:
            yield np.sort(np.concatenate(parts[int(name)])), np.sort(rows)


def _candidates(pdf: pd.DataFrame, k: int, least: float | None, exact: bool = False, leaf_rows: int = LEAF_ROWS) -> pd.DataFrame:
    """Pairs (a, b) of one leaf: for each vector that asks there, the k best that lie in it and all that may be as good.

    A vector with more than WIDE of them gets one row (leaf, a, null) instead, but for exact, where code is the stored vector.
    """
    names = pdf["class"].to_numpy()
    c = np.frombuffer(b"".join(pdf["code"]), dtype=np.float32 if exact else np.int8).reshape(len(pdf), -1).astype(np.float64 if exact else np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    at, who = np.flatnonzero(pdf["own"]), np.flatnonzero(pdf["asks"])
    lowest = np.maximum(pdf["bar"].to_numpy(np.float64), -1.5 if least is None else least)
    parts = _divided(c, who, at, k, least, leaf_rows) if len(at) > SPLIT * leaf_rows and len(who) else [(who, at)]
    left, right, wide = [], [], []
    for some, there in parts:
        x, y, z = _near(c, some, there, k, lowest, 1e-12 if exact else CODE_ERROR, None if exact else WIDE)
        left, right, wide = left + x, right + y, wide + z
    if not left:
        return pd.DataFrame({"leaf": [], "a": [], "b": []})
    a, b = names[np.concatenate(left)], names[np.concatenate(right)]
    pairs = {(x, y) if x < y else (y, x) for x, y in zip(a, b, strict=True) if x != y}
    leaf = int(pdf["leaf"].iloc[0])
    found = [(None, x, y) for x, y in sorted(pairs)] + [(leaf, x, None) for x in sorted(set(names[np.concatenate(wide)]))]
    return pd.DataFrame({"leaf": pd.array([r[0] for r in found], dtype="Int64"), "a": [r[1] for r in found], "b": [r[2] for r in found]})


def most_similar(vectors: DataFrame, key: str, vector: str, dim: int, k: int = 10, min_cosine: float | None = None, trees: int = 3, probes: int | None = None, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, asked: Column | None = None) -> DataFrame:
    """(key, other, cosine, rank): the k most similar vectors of every vector, rank 1 first; of equally similar ones
    the smaller key (as string) first. With min_cosine, of those at least that similar.

    Only vectors of exactly `dim` finite numbers that are not all zero take part, under a key that is not
    null; a repeated row is one row (of different vectors under one key the one with the smallest hash counts).
    Equal directions form a class that is indexed once, so that copies cannot fill a leaf; every copy gets its rows.
    Approximate: vectors visit as many leaves as their region of the sample needs to meet 0.99 of its neighbours there,
    12 at least, or `probes` if given. Where neighbours are not near, that is a large part of the leaves.
    With `asked`, a condition on the rows, only vectors of such rows are searched for; all others are still found.
    """
    rows = vectors.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<float>").alias("vector"), (F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))).alias("asks")).filter(f"key is not null and size(vector) = {int(dim)} and not exists(vector, x -> x is null)")
    ready = rows.mapInPandas(_prepare, "key string, asks boolean, class binary, vector array<float>")
    ready = checkpointed(ready)
    members = ready.groupBy("key").agg(F.min("class").alias("class"), F.max("asks").alias("asks"))
    count = vectors.count()
    share = min(1.0, 0.9 * sample_rows / max(1, count))
    sample = ready.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").limit(sample_rows)
    blocks = [r.block for r in sample.mapInPandas(_block, "block binary").collect()]
    x = np.unique(np.frombuffer(b"".join(blocks), np.float32).reshape(-1, dim), axis=0)
    depth = 0
    while count >> depth > leaf_rows and len(x) >> depth > 8:
        depth += 1
    forest = [fit_tree(x, depth, seed) for seed in range(trees if depth else 1)]
    # of the k nearest of all, about this many are in the sample
    near = max(1, math.ceil(k * len(x) / max(1, count)))
    visits = np.array([probes], np.int64) if probes else probes_needed(forest, x, min(k, near), min_cosine) if depth else np.array([PROBES], np.int64)
    classes = ready.groupBy("class").agg(F.first("vector").alias("vector"), F.max("asks").alias("asks"))
    routed = "leaf long, own boolean, asks boolean, bar float, class binary, code binary"
    # for a stated query set the sample is worth comparing with: what lies under its bars need not be ranked. It is bounded by sample_rows
    known = x if asked is not None else x[:0]
    nodes = classes.mapInPandas(lambda it: _route(it, forest, visits, known, k), routed)
    found = checkpointed(nodes.groupBy("leaf").applyInPandas(lambda pdf: _candidates(pdf, k, min_cosine, leaf_rows=leaf_rows), "leaf long, a binary, b binary").distinct())
    pairs = found.filter("b is not null").select("a", "b")
    dense = found.filter("b is null").select("leaf", F.col("a").alias("class"), F.lit(True).alias("wide"))
    only = np.array([r.leaf for r in dense.select("leaf").distinct().collect()], np.int64)
    if len(only):
        stored = classes.mapInPandas(lambda it: _route(it, forest, visits, known, k, only), routed)
        stored = stored.join(dense, ["leaf", "class"], "left").withColumn("asks", F.coalesce("wide", F.lit(False))).filter("own or asks").drop("wide")
        more = stored.groupBy("leaf").applyInPandas(lambda pdf: _candidates(pdf, k, min_cosine, exact=True, leaf_rows=leaf_rows), "leaf long, a binary, b binary")
        pairs = checkpointed(pairs.unionByName(more.select("a", "b")).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    exact = checkpointed(ready.join(wanted, "class", "left_semi").groupBy("class").agg(F.first("vector").alias("vector")))
    both = pairs.join(exact.toDF("a", "va"), "a").join(exact.toDF("b", "vb"), "b")

    def dot(p: str, q: str) -> str:
        return f"aggregate(zip_with({p}, {q}, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x)"

    scored = both.select("a", "b", F.expr(f"{dot('va', 'vb')} / sqrt({dot('va', 'va')} * {dot('vb', 'vb')})").alias("cosine"))
    if min_cosine is not None:
        scored = scored.filter(F.col("cosine") >= min_cosine)
    scored = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    # only the first k + 1 copies of a class can be among the k best of any vector
    first = members.drop("asks").withColumn("nth", F.row_number().over(Window.partitionBy("class").orderBy("key"))).filter(F.col("nth") <= k + 1)
    copied = first.filter("nth = 2").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("cosine"))
    near = scored.unionByName(copied).join(first.select(F.col("class").alias("b"), F.col("key").alias("other")), "b")
    order = [F.desc("cosine"), F.asc("other")]
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(*order))).filter(F.col("nth") <= k + 1)
    spelt = members.filter("asks").drop("asks").join(near.select(F.col("a").alias("class"), "other", "cosine"), "class").filter("key != other")
    return spelt.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("rank") <= k).select("key", "other", "cosine", F.col("rank").cast("long").alias("rank"))


def mutual(similar: DataFrame, min_cosine: float) -> DataFrame:
    """(key_a, key_b), key_a < key_b: pairs at least min_cosine similar that are each among the other's most similar."""
    near = similar.filter(F.col("cosine") >= min_cosine)
    pair = near.select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b"))
    return pair.groupBy("key_a", "key_b").count().filter("count = 2").select("key_a", "key_b")
