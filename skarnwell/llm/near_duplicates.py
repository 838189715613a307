"""Near-duplicate texts by a chosen-path set similarity join.

A text is the multiset of its words, turned into a set by numbering the occurrences of each word. Texts
with the same multiset form one class, and only classes are compared. A class carries minwise hashes of
its set: a few as tree coordinates, many more as one-bit sketch. In each of several independent trees a
class walks down from the root: every node picks one or two coordinates by a hash of the node, and a
class goes on to the children its own values at these coordinates name, so that similar classes keep
meeting while unlike ones part. The first levels decide the shuffle key; the rest of the tree is walked
inside the task that holds the node, until a node is small, and its classes are compared exhaustively by
sketch. Pairs that pass are checked exactly on their words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarnwell.durable import checkpointed

WORD = re.compile(r"\w+")
COORDINATES, SKETCH_WORDS = 32, 8  # 8-bit minwise values for a tree; 64-bit words of one-bit minwise sketch
TREES, LEAF = 8, 48
DEPTH = 5  # levels of a tree; what is still together is compared by sketch, since deeper nodes lose similar classes
TOP_SHARE, TOP_ROWS = 0.02, 20_000  # a coordinate leaves about this share of the classes together; rows of a node that are meant for one task
HOT_ROWS, SAMPLED = 2 * TOP_ROWS, 64  # a node with more rows branches again before the shuffle; one class in so many is counted to find such nodes
ROW_BYTES, TASK_BYTES = 160, 32 << 20
DEPTH_BIT = 40  # a row's number of words and the depth of its node share a long

_M1, _M2, _GOLD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer of murmur3, elementwise."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * _M1
        x = x ^ (x >> np.uint64(33))
        x = x * _M2
        return x ^ (x >> np.uint64(33))


_SEEDS = mix(np.arange(1, COORDINATES + 64 * SKETCH_WORDS + 1, dtype=np.uint64) * _GOLD)


class Hasher:
    """Word hashes, remembered for the words seen lately."""

    def __init__(self, most: int = 500_000):
        self.known: dict[str, int] = {}
        self.most = most

    def tokens(self, text: str) -> np.ndarray | None:
        """Hashes of the numbered word occurrences of a text, sorted."""
        if len(self.known) > self.most:
            self.known.clear()
        known, get, out = self.known, self.known.get, []
        for w, n in Counter(WORD.findall(text.lower())).items():
            h = get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
            if n > 1:
                out += [h + k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for k in range(1, n)]
        return np.sort(mix(np.array(out, dtype=np.uint64)))


def signature(tokens: np.ndarray) -> tuple[bytes, bytes]:
    """(sketch, coordinates) of a set of hashes. Each tree has coordinates of its own; they share their values with the sketch."""
    low = np.full(len(_SEEDS), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for k in range(0, len(tokens), 256):  # blocks bound the memory for very long texts
            np.minimum(low, mix_light(tokens[k : k + 256, None] ^ _SEEDS[None, :]).min(0), out=low)
    bits = np.packbits((low[COORDINATES:] >> np.uint64(17) & np.uint64(1)).astype(np.uint8)).tobytes()
    return bits, (low >> np.uint64(13)).astype(np.uint8).tobytes()


def mix_light(x: np.ndarray) -> np.ndarray:
    """One multiply-and-fold round; its input is already mixed."""
    x = x * _M1
    x ^= x >> np.uint64(32)
    x *= _M2
    return x


def _sketch(batches: Iterator[pd.DataFrame], min_words: int, trees: int) -> Iterator[pd.DataFrame]:
    hasher = Hasher()
    for pdf in batches:
        out = {c: [] for c in ("id", "doc", "n", "bag", "sketch", "coords")}
        for key, doc, text in zip(pdf["id"], pdf["doc"], pdf["text"], strict=True):
            t = hasher.tokens(text)
            if len(t) >= min_words:
                sketch, coords = signature(t)
                for c, v in zip(out, (key, doc, len(t), xxhash.xxh3_128_digest(t.tobytes()), sketch, coords[: COORDINATES * trees]), strict=True):
                    out[c].append(v)
        yield pd.DataFrame(out)


def _bags(batches: Iterator[pd.DataFrame], min_words: int) -> Iterator[pd.DataFrame]:
    hasher = Hasher()
    for pdf in batches:
        rows = [(xxhash.xxh3_128_digest(t.tobytes()), t.astype(np.int64)) for t in map(hasher.tokens, pdf["text"]) if len(t) >= min_words]
        yield pd.DataFrame(rows, columns=["bag", "tokens"])


def _u64(*parts) -> np.ndarray:
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            out = mix((out + _GOLD) ^ np.asarray(p, dtype=np.uint64))
    return out


def children(nodes: np.ndarray, coords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of rows at their nodes: (row, child). A node picks one coordinate, and every second node another."""
    first = _u64(nodes, 1)
    rows = np.arange(len(nodes))
    two = first >> np.uint64(63) == 1
    pick1 = (first % np.uint64(COORDINATES)).astype(np.int64)
    pick2 = (pick1 + 1 + (first >> np.uint64(20)) % np.uint64(COORDINATES - 1)).astype(np.int64) % COORDINATES
    a = _u64(nodes, pick1, coords[rows, pick1])
    b = _u64(nodes, pick2, coords[rows, pick2])[two]
    return np.concatenate([rows, rows[two]]), np.concatenate([a, b])


def _branch(batches: Iterator[pd.DataFrame], trees: int, levels: int, hot: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows at the nodes `levels` deep, and deeper below nodes that are hot (sorted)."""
    for pdf in batches:
        if not len(pdf):
            continue
        coords = np.frombuffer(b"".join(pdf["coords"]), dtype=np.uint8).reshape(len(pdf), -1)
        for tree in range(trees):
            rows, nodes = np.arange(len(pdf)), _u64(np.full(len(pdf), tree), 7)
            at = tree * COORDINATES % coords.shape[1]
            own = coords[:, at : at + COORDINATES]
            for _ in range(levels):
                k, nodes = children(nodes, own[rows])
                rows = rows[k]
            depth = np.full(len(rows), levels)
            while len(hot) and (down := np.isin(nodes, hot)).any():
                k, below = children(nodes[down], own[rows[down]])
                rows, depth = np.concatenate([rows[~down], rows[down][k]]), np.concatenate([depth[~down], depth[down][k] + 1])
                nodes = np.concatenate([nodes[~down], below])
            out = pdf.iloc[rows].copy()
            out["coords"] = np.array([r.tobytes() for r in own], dtype=object)[rows]
            out["n"] = out["n"].to_numpy(np.int64) | depth << DEPTH_BIT if "n" in out else depth << DEPTH_BIT
            out.insert(0, "node", nodes.view(np.int64))
            yield out


def _hot_nodes(sketched: DataFrame, trees: int, levels: int, hot_rows: int) -> np.ndarray:
    """Nodes that more than about hot_rows rows would come to, counted on a sample by hash; level by level, since children of hot nodes may be hot. Their number is bounded by rows / hot_rows."""
    sample = sketched.filter(F.pmod(F.xxhash64("bag"), F.lit(SAMPLED)) == 0).dropDuplicates(["bag"]).select("bag", "coords")
    hot = np.zeros(0, np.uint64)
    for _ in range(levels, DEPTH - 1):
        at = sample.mapInPandas(lambda it, hot=hot: _branch(it, trees, levels, hot), "node long, bag binary, coords binary, n long")
        more = [r.node for r in at.filter(F.shiftright("n", DEPTH_BIT) < DEPTH - 1).groupBy("node").count().filter(F.col("count") * SAMPLED > hot_rows).select("node").collect()]
        if not more:
            break
        hot = np.union1d(hot, np.array(more, np.int64).view(np.uint64))
    return hot


class Node:
    """Classes that met in a node, sorted by it, and the search below."""

    def __init__(self, pdf: pd.DataFrame, agree: float, ratio: float):
        self.node = pdf["node"].to_numpy().view(np.uint64)
        n = pdf["n"].to_numpy()
        self.n, self.depth = n & (1 << DEPTH_BIT) - 1, n >> DEPTH_BIT
        self.doc = pdf["doc"].to_numpy()
        self.coords = np.frombuffer(b"".join(pdf["coords"]), dtype=np.uint8).reshape(len(pdf), -1)
        self.sketch = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint64).reshape(len(pdf), -1)
        self.most = (1 - agree) * 64 * SKETCH_WORDS
        self.ratio = ratio
        self.found: list[np.ndarray] = []
        self.held = 0

    def keep(self, a: np.ndarray, b: np.ndarray) -> None:
        """Of the pairs of rows a, b, those that may be similar."""
        na, nb = self.n[a], self.n[b]
        k = (np.minimum(na, nb) >= self.ratio * np.maximum(na, nb) - 1e-9) & ~((self.doc[a] == self.doc[b]) & (self.doc[a] >= 0))
        a, b = a[k], b[k]
        k = np.bitwise_count(self.sketch[a] ^ self.sketch[b]).sum(1) <= self.most
        if k.any():
            a, b = a[k].astype(np.int64), b[k].astype(np.int64)
            self.found.append(np.minimum(a, b) << 32 | np.maximum(a, b))
            self.held += len(a)

    def taken(self) -> np.ndarray:
        """The pairs found since the last call, distinct."""
        pairs = np.unique(np.concatenate(self.found)) if self.found else np.zeros(0, np.int64)
        self.found, self.held = [], 0
        return np.stack([pairs >> 32, pairs & 0xFFFFFFFF])

    def exhaust(self, node: np.ndarray, order: np.ndarray) -> Iterator[np.ndarray]:
        """All pairs within runs of equal nodes; runs are short, so shifts of the whole array do it."""
        shift = 1
        while True:
            same = np.flatnonzero(node[shift:] == node[:-shift]) if shift < len(node) else ()
            if not len(same):
                return
            for k in range(0, len(same), 1 << 18):
                self.keep(order[same[k : k + (1 << 18)]], order[same[k : k + (1 << 18)] + shift])
                if self.held > 1 << 20:
                    yield self.taken()
            shift += 1

    def search(self, depth: int = DEPTH) -> Iterator[np.ndarray]:
        """Pairs of rows, in blocks that are distinct each; nodes branch down to `depth` levels."""
        node, order, left = self.node, np.arange(len(self.node)), depth - self.depth
        while len(node):
            s = np.argsort(node, kind="stable")
            node, order, left = node[s], order[s], left[s]
            edge = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))
            size = np.repeat(np.diff(edge), np.diff(edge))
            small = (size <= LEAF) | (left <= 0)
            yield from self.exhaust(node[small & (size > 1)], order[small & (size > 1)])
            node, order, left = node[~small], order[~small], left[~small] - 1
            if len(node):
                k, node = children(node, self.coords[order])
                order, left = order[k], left[k]
        yield self.taken()


def _compare(batches: Iterator[pd.DataFrame], agree: float, ratio: float, depth: int = DEPTH) -> Iterator[pd.DataFrame]:
    def flush(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        bag = pdf["bag"].to_numpy(dtype=object)
        for a, b in Node(pdf, agree, ratio).search(depth):
            pairs = {(x, y) if x < y else (y, x) for x, y in zip(bag[a], bag[b], strict=True) if x != y}
            yield pd.DataFrame(sorted(pairs), columns=["a", "b"])

    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        node = pdf["node"].to_numpy()
        cut = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
        held.append(pdf.iloc[:cut])
        if cut and sum(map(len, held)):
            yield from flush(pd.concat(held))
            held = []
        held.append(pdf.iloc[cut:])
    if held and sum(map(len, held)):
        yield from flush(pd.concat(held))


def similar_classes(texts: DataFrame, key: str, group: str, text: str, threshold: float = 0.8, min_words: int = 60, trees: int = TREES, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the class of every text, and the pairs of similar classes.

    members: id, doc, class - one row per text with at least min_words words (repeated rows once).
    pairs: class_a, class_b, similarity - words in common, counted with repetition and in any order, over
    the words of the longer text, where that is at least the threshold. Classes of which all texts belong to
    one and the same group are not compared with each other. Keys and groups must be integers; rows with a null key,
    group or text take no part. Every pair is right; each similar pair is found with a probability that grows
    with `trees`, each of which has coordinates of its own up to 17 (0.98 with 8 at similarity 0.8 and equal lengths, the
    hardest case, also where many texts are that similar).
    """
    rows = texts.select(F.col(key).cast("long").alias("id"), F.col(group).cast("long").alias("doc"), F.col(text).alias("text")).filter(f"id is not null and doc is not null and length(text) >= {2 * min_words - 1}")
    sketched = checkpointed(rows.mapInPandas(lambda it: _sketch(it, min_words, trees), "id long, doc long, n int, bag binary, sketch binary, coords binary"))
    members = sketched.select("id", "doc", F.col("bag").alias("class")).distinct()
    same = F.when(F.min("doc") == F.max("doc"), F.min("doc")).otherwise(F.lit(-1))
    classes = sketched.groupBy("bag").agg(same.alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("coords").alias("coords"))
    count = texts.count()
    levels, left = 1, count * TOP_SHARE
    while left > TOP_ROWS and levels < DEPTH - 1:
        levels, left = levels + 1, left * TOP_SHARE
    hot = _hot_nodes(sketched, trees, levels, hot_rows)
    # as many partitions as keep a task's share the same at every size
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) if count > TOP_ROWS else 1, int(count * trees * 1.5**levels * ROW_BYTES / TASK_BYTES))
    # of two sets of equal size with overlap t their Jaccard similarity is t/(2-t); three standard deviations of the sketch below
    jaccard = threshold / (2 - threshold)
    agree = (1 + jaccard) / 2
    agree -= 3 * (agree * (1 - agree) / (64 * SKETCH_WORDS)) ** 0.5
    schema = "node long, bag binary, doc long, n long, sketch binary, coords binary"
    nodes = classes.mapInPandas(lambda it: _branch(it, trees, levels, hot), schema)
    found = nodes.repartition(parts, "node").sortWithinPartitions("node").mapInPandas(lambda it: _compare(it, agree, threshold), "a binary, b binary").distinct()
    bags = rows.mapInPandas(lambda it: _bags(it, min_words), "bag binary, tokens array<long>")
    found = checkpointed(found)
    wanted = found.select(F.explode(F.array("a", "b")).alias("bag")).distinct()
    bags = bags.join(wanted, "bag", "left_semi").groupBy("bag").agg(F.first("tokens").alias("tokens"))
    bags = checkpointed(bags)
    both = found.join(bags.toDF("a", "ta"), "a").join(bags.toDF("b", "tb"), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    pairs = both.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), (common / F.greatest(F.size("ta"), F.size("tb"))).alias("similarity"))
    return members, pairs.filter(F.col("similarity") >= threshold - 1e-12)


def similar_pairs(members: DataFrame, pairs: DataFrame, max_copies: int | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: texts of different groups that are similar.

    Pairs of classes are spelt out into pairs of their members, and so are classes themselves. With max_copies,
    of a class of more than that many members only the first member of each group stands for the
    others of that group against other classes, and within it the first members of the groups are each paired
    with the smallest. Their membership stays whole in `members`.
    """
    size = members.groupBy("class").agg(F.count("*").alias("size"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    many = "false" if max_copies is None else f"size > {int(max_copies)}"
    linked = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).union(size.filter("size > 1 and first_doc != last_doc").select("class")).distinct()
    m = members.join(linked, "class", "left_semi").join(size.select("class", "size"), "class")
    stand_in = m.filter(many).groupBy("class", "doc").agg(F.min("id").alias("id"), F.first("size").alias("size")).select("class", "id", "doc", "size")
    m = checkpointed(m.filter(f"not ({many})").select("class", "id", "doc", "size").unionByName(stand_in))
    a = m.select(F.col("class").alias("class_a"), F.col("id").alias("x"), F.col("doc").alias("dx"))
    b = m.select(F.col("class").alias("class_b"), F.col("id").alias("y"), F.col("doc").alias("dy"))
    across = pairs.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").filter("dx != dy").select("x", "y")
    few = m.filter(f"not ({many}) and size > 1")
    within = few.alias("p").join(few.alias("q"), F.expr("p.class = q.class and p.id < q.id and p.doc != q.doc")).selectExpr("p.id as x", "q.id as y")
    lead = m.filter(many).groupBy("class").agg(F.min(F.struct("id", "doc")).alias("lead"))
    star = m.filter(many).join(lead, "class").filter("doc != lead.doc").selectExpr("lead.id as x", "id as y")
    return across.union(within).union(star).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
