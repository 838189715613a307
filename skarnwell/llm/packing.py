"""Filling containers of fixed capacity by a grouping genetic algorithm on islands.

Items are spread over blocks of bounded size, and each block is packed by several islands: populations that evolve
apart and pass their best solution on to the next island between epochs. A gene is a whole container:
crossover injects full containers of one parent into the other and removes what they duplicate; of the displaced
items some are swapped into containers that they fill better than what they replace (Falkenauer's dominance
replacement), and the others are best-fitted, the largest first.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarnwell.durable import checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the tokenizer's rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_ITEMS, ISLANDS, EPOCHS = 4000, 3, 2
MOST_TASKS = 20_000
MOST_HARM = 1  # full containers that an injected one may break
POPULATION, OFFSPRING, INJECTED, MUTATED, REFILLS = 6, 60, 0.3, 4, 8


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, tokens): the size of every text in tokens of the public tokenizer in the given rank file; 0 for null and empty texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "tokens": [len(encode(t)) for t in pdf["text"]]})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(count, "key long, tokens long").select(F.col("key").alias(key), "tokens")


def _sums(sizes: np.ndarray, most: int = 48) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, i, j), rising: sizes of one item (j = -1), and of two of the `most` largest; the places of the items."""
    n = len(sizes)
    i, j = _pairs(min(n, most))
    i, j = i + max(0, n - most), j + max(0, n - most)
    total = np.concatenate([sizes, sizes[i] + sizes[j]])
    k = np.argsort(total, kind="stable")
    return total[k], np.concatenate([np.arange(n), i])[k], np.concatenate([np.full(n, -1), j])[k]


@cache
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


class Packing:
    """Containers of one solution: which container each item is in, and what room each container has left."""

    def __init__(self, sizes: np.ndarray, capacity: int, bins: np.ndarray | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = np.full(len(sizes), -1, np.int64) if bins is None else bins
        self.used = int(self.bins.max()) + 1 if len(sizes) else 0
        self.room = np.full(len(sizes) + 1, -1, np.int64)
        self.room[: self.used] = capacity - np.bincount(self.bins[self.bins >= 0], weights=sizes[self.bins >= 0], minlength=self.used).astype(np.int64) if self.used else 0

    def fit(self, items: np.ndarray) -> None:
        """Puts items, in the order given, each where it leaves the least room; a new container where it fits nowhere."""
        by_room: dict[int, list[int]] = {}
        for b in range(self.used):
            by_room.setdefault(int(self.room[b]), []).append(b)
        free = np.zeros(self.capacity + 1, bool)
        free[[r for r in by_room if r >= 0]] = True
        for i in items:
            s = int(self.sizes[i])
            r = s + int(free[s:].argmax())
            if free[r]:
                b = by_room[r].pop()
                if not by_room[r]:
                    free[r] = False
            else:
                r, b = self.capacity, self.used
                self.used += 1
            self.bins[i] = b
            self.room[b] = left = r - s
            by_room.setdefault(left, []).append(b)
            free[left] = True

    def swap_in(self, loose: np.ndarray) -> np.ndarray:
        """Dominance replacement: in every container with room, none, one or two items give way to one or two loose ones that fill it better.

        Containers with most room come first, each is left as full as such a swap makes it; what came out is loose in turn. Returns the loose items.
        """
        order = np.argsort(self.bins, kind="stable")
        start = np.searchsorted(self.bins[order], np.arange(self.used + 1))
        loose = loose[np.argsort(self.sizes[loose], kind="stable")]
        put, x, y = _sums(self.sizes[loose])
        for b in np.argsort(-self.room[: self.used], kind="stable"):
            room = int(self.room[b])
            if room <= 0 or not len(loose):
                break
            inside = order[start[b] : start[b + 1]]
            out, i, j = _sums(self.sizes[inside])
            out, i, j = np.append(out, 0), np.append(i, -1), np.append(j, -1)
            at = np.searchsorted(put, out + room, side="right") - 1
            gain = np.where(at >= 0, put[np.maximum(at, 0)] - out, 0)
            k = int(gain.argmax())
            if gain[k] <= 0:
                continue
            taken = [q for q in (x[at[k]], y[at[k]]) if q >= 0]
            freed = [inside[q] for q in (i[k], j[k]) if q >= 0]
            self.bins[loose[taken]] = b
            self.bins[freed] = -1
            self.room[b] = room - gain[k]
            loose = np.append(np.delete(loose, taken), np.array(freed, np.int64))
            loose = loose[np.argsort(self.sizes[loose], kind="stable")]
            put, x, y = _sums(self.sizes[loose])
        return loose

    def fitness(self) -> float:
        """Falkenauer's: the mean square of how full the containers are; it prefers full and nearly empty ones to equal ones."""
        return float(np.mean((1 - self.room[: self.used] / self.capacity) ** 2)) if self.used else 1.0

    def compact(self) -> Packing:
        """Without empty containers."""
        _, bins = np.unique(self.bins, return_inverse=True)
        return Packing(self.sizes, self.capacity, bins.astype(np.int64))


def first_solution(sizes: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> Packing:
    """Best fit of the items by falling size, the sizes blurred by noise."""
    p = Packing(sizes, capacity)
    p.fit(np.argsort(-sizes * (1 + noise * rng.standard_normal(len(sizes))), kind="stable"))
    return p


def ancestor(sizes: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> Packing:
    """A first solution of which all containers that are not full were emptied and filled again by exchange, so that it has full containers to pass on."""
    p = first_solution(sizes, capacity, rng, noise).compact()
    for _ in range(REFILLS if noise else 0):
        p = _refit(p, mutate(p, p.bins, rng), rng).compact()
    return p


def _refit(p: Packing, bins: np.ndarray, rng: np.random.Generator) -> Packing:
    """A solution from bins, some items of which are in no container (-1): those are swapped in where they fill better, and what is left then is best-fitted, the largest first."""
    kept = bins >= 0
    if kept.any():
        _, bins[kept] = np.unique(bins[kept], return_inverse=True)
    child = Packing(p.sizes, p.capacity, bins)
    loose = child.swap_in(np.flatnonzero(~kept))
    child.fit(loose[np.argsort(-p.sizes[loose], kind="stable")])
    return child


def crossover(a: Packing, b: Packing, rng: np.random.Generator) -> np.ndarray:
    """Containers of a, with full containers of b injected whole and what they duplicate removed; displaced items are in none (-1).

    Only full containers of b are injected that a has not, and that break few full ones of a.
    """
    full = b.room[: b.used] == 0
    of = np.where(full[b.bins], b.bins, -1)
    items = np.flatnonzero(of >= 0)
    pairs = np.unique(of[items] * (a.used + 1) + a.bins[items])
    inject, hit = np.divmod(pairs, a.used + 1)
    spread = np.bincount(inject, minlength=b.used)
    harm = np.bincount(inject, weights=a.room[hit] == 0, minlength=b.used)
    good = full & (spread > 1) & (harm <= MOST_HARM) & (rng.random(b.used) < INJECTED)
    injected = good[b.bins]
    broken = np.zeros(a.used, bool)
    broken[a.bins[injected]] = True
    bins = np.where(broken[a.bins], -1, a.bins)
    bins[injected] = a.used + b.bins[injected]
    return bins


def mutate(p: Packing, bins: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """bins without the container of most room and a few others that are not full, most of them with much room."""
    room = p.room[: p.used]
    open_ = np.flatnonzero(room > 0)
    if not len(open_):
        return bins
    emptied = np.append(rng.choice(open_, min(len(open_), MUTATED), replace=False), room.argmax())
    drop = np.zeros(p.used + 1, bool)
    drop[emptied] = True
    return np.where((bins < p.used) & drop[np.minimum(bins, p.used)], -1, bins)


def evolve(sizes: np.ndarray, capacity: int, population: list[Packing], rng: np.random.Generator) -> list[Packing]:
    """One epoch of an island; best first. Ends early where no fewer containers are possible."""
    least = -(-int(sizes.sum()) // capacity)
    pop = population or []
    for k in range(len(pop), POPULATION):
        if pop and min(p.used for p in pop) <= least:
            break
        pop.append(ancestor(sizes, capacity, rng, 0.0 if k == 0 else 0.02 * k))

    def rank(p: Packing) -> tuple:
        return p.used, -p.fitness()

    pop.sort(key=rank)
    for _ in range(OFFSPRING):
        if pop[0].used <= least or len(pop) < 2:
            break
        a, b = rng.choice(len(pop), 2, replace=False)
        mother, father = pop[min(a, b)], pop[max(a, b)]
        child = _refit(mother, mutate(mother, crossover(mother, father, rng), rng), rng).compact()
        pop = sorted([*pop, child], key=rank)[:POPULATION]
    return pop


def _island(key: tuple, items: pd.DataFrame, arrived: pd.DataFrame, capacity: int, epoch: int) -> pd.DataFrame:
    """An epoch of island `key` = (block, island): its new population, and its best solution sent on to the next island."""
    block, island = key
    columns = ["block", "island", "used", "fitness", "bins", "best_fit"]
    if not len(items):
        return pd.DataFrame([], columns=columns)
    sizes = items.sort_values(["item", "part", "size"], kind="stable")["size"].to_numpy()
    pop = [Packing(sizes, capacity, np.frombuffer(b, np.int32).astype(np.int64)) for b in arrived["bins"]]
    rng = np.random.default_rng([int(block), int(island), epoch])
    best_fit = int(arrived["best_fit"].iloc[0]) if len(arrived) else first_solution(sizes, capacity, rng, 0.0).used
    pop = [p.compact() for p in evolve(sizes, capacity, pop, rng)]
    rows = [(block, island, p.used, p.fitness(), p.bins.astype(np.int32).tobytes(), best_fit) for p in pop]
    rows.append((block, (island + 1) % ISLANDS, *rows[0][2:]))
    return pd.DataFrame(rows, columns=columns)


def _epoch(capacity: int, epoch: int):
    def run(key: tuple, items: pd.DataFrame, arrived: pd.DataFrame) -> pd.DataFrame:
        return _island(key, items, arrived, capacity, epoch)

    return run


def _packed(sizes: DataFrame, key: str, size: str, capacity: int, block_items: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(full, rest, best): parts that fill a container each, the other items with their block, and the best solution of every block."""
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    # numbered before anything else, so that equal rows stay apart
    items = checkpointed(sizes.select(F.col(key).cast("long").alias("item"), n.alias("n")))
    whole = F.floor(F.col("n") / capacity).cast("long")
    full = items.filter(F.col("n") >= capacity).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)))
    full = full.select("item", "part", F.lit(capacity).cast("long").alias("size"), F.concat_ws("-", F.lit("full"), F.coalesce(F.col("item").cast("string"), F.lit("null")), "part", F.monotonically_increasing_id()).alias("container"))
    rest = items.select("item", whole.alias("part"), (F.col("n") % capacity).alias("size")).filter("size > 0 or part = 0")
    blocks = max(1, -(-items.count() // block_items))
    # a hash of the place among equal keys spreads repeated keys too
    rest = checkpointed(rest.withColumn("block", F.pmod(F.xxhash64("item", "part", F.monotonically_increasing_id()), F.lit(blocks))))
    isles = rest.withColumn("island", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ISLANDS - 1).cast("long"))))
    schema = "block long, island long, used long, fitness double, bins binary, best_fit long"
    pop = sizes.sparkSession.createDataFrame([], schema)
    tasks = min(blocks * ISLANDS, MOST_TASKS)  # a block is little data but much work, so partitions are not merged by size
    isles = isles.repartition(tasks, "block", "island")
    for epoch in range(EPOCHS):
        both = isles.groupBy("block", "island").cogroup(pop.repartition(tasks, "block", "island").groupBy("block", "island"))
        pop = checkpointed(both.applyInPandas(_epoch(capacity, epoch), schema))
    best = pop.groupBy("block").agg(F.min(F.struct("used", -F.col("fitness"), "bins", "best_fit")).alias("best")).select("block", "best.used", "best.bins", "best.best_fit")
    return full, rest, best


def pack(sizes: DataFrame, key: str, size: str, capacity: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(key, part, size, container): every item in a container of at most `capacity`.

    An item is divided only if it alone exceeds the capacity: into parts that fill a container each (part 0, 1 and so on)
    and a rest that is packed like an item. Null sizes count as 0, and an item of size 0 takes no room but has a container. Items
    given twice are packed twice; null keys are packed like others. Blocks hold about block_items items each, chosen by hash, so no task
    grows with the data; each block leaves at most about one container partly empty.
    """
    full, rest, best = _packed(sizes, key, size, capacity, block_items)

    def place(k: tuple, items: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["item", "part", "size"], kind="stable")
        bins = np.frombuffer(best["bins"].iloc[0], np.int32) if len(items) else []
        return pd.DataFrame({"item": items["item"], "part": items["part"], "size": items["size"], "container": [f"{k[0]}-{b}" for b in bins]})

    packed = rest.groupBy("block").cogroup(best.select("block", "bins").groupBy("block")).applyInPandas(place, "item long, part long, size long, container string")
    return packed.unionByName(full).withColumnRenamed("item", key)


def savings(sizes: DataFrame, key: str, size: str, capacity: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(block, items, least, best_fit, evolved): containers per block: the least that could do, those of best fit by falling size, and those the genetic search needs."""
    _, rest, best = _packed(sizes, key, size, capacity, block_items)
    b = rest.groupBy("block").agg(F.count("*").alias("items"), F.ceil(F.sum("size") / capacity).cast("long").alias("least"))
    return b.join(best, "block").select("block", "items", "least", "best_fit", F.col("used").alias("evolved"))


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row on a packing: containers, the least number that could do, and the share of their room that is used."""
    c = packed.groupBy("container").agg(F.sum("size").alias("size"))
    return c.agg(F.count("*").alias("containers"), F.ceil(F.sum("size") / capacity).alias("least"), F.max("size").alias("fullest"), (F.sum("size") / (F.count("*") * capacity)).alias("used"))
