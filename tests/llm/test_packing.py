import numpy as np
import pytest

from skarnwell.llm import packing as P


def test_pieces_fit_and_nothing_is_lost(spark):
    rng = np.random.default_rng(2)
    sizes = [int(s) for s in rng.integers(1, 3000, 900)] + [0, 100, 200, 100]
    rows = [(i, s) for i, s in enumerate(sizes)] + [(None, 5), (7, 9), (7, 9), (5000, None)]
    df = spark.createDataFrame([(i, s, "clash") for i, s in rows], "doc long, block long, container string")
    out = P.pack(df, "doc", "block", 1000, block_items=250).collect()
    room, got = {}, {}
    for r in out:
        room[r.container] = room.get(r.container, 0) + r.size
        got.setdefault(r.doc, []).append((r.part, r.size))
    assert max(room.values()) <= 1000
    want = {}
    for i, s in rows:
        s = s or 0
        parts = [(p, 1000) for p in range(s // 1000)] + ([(s // 1000, s % 1000)] if s % 1000 or s < 1000 else [])
        want.setdefault(i, []).extend(parts)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    least = -(-sum(room.values()) // 1000)
    assert len(room) <= 1.03 * least + 4
    f = P.fill(P.pack(df, "doc", "block", 1000), 1000).first()
    assert f.fullest <= 1000 and f.containers >= f.least


def test_empty(spark):
    df = spark.createDataFrame([], "doc long, size long")
    assert P.pack(df, "doc", "size", 100).count() == 0


def test_evolution_beats_best_fit_on_triplets():
    """Items in threes that fill a container exactly: falling best fit wastes room, the genetic search wins some back."""
    rng = np.random.default_rng(4)
    sizes = []
    for _ in range(40):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2 + 1))
        sizes += [a, b, 1000 - a - b]
    sizes = np.array(sizes)
    fit = P.first_solution(sizes, 1000, rng, 0.0)
    pop: list = []
    for _ in range(12):
        pop = P.evolve(sizes, 1000, pop, rng)
    best = pop[0]
    assert 40 <= best.used < fit.used
    for p in pop:
        filled = np.bincount(p.bins, weights=sizes)
        assert filled.max() <= 1000 and (p.bins >= 0).all() and (1000 - filled == p.room[: p.used]).all()


def test_sizes_in_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc long, text string")
    try:
        got = {r.doc: r.tokens for r in P.token_sizes(df, "doc", "text").collect()}
    except Exception as e:
        if "No such file" in str(e):
            pytest.skip("no tokenizer files")
        raise
    assert got[1] >= 2 and got[2] == got[3] == 0 and got[4] > 1


@pytest.mark.parametrize("low, high, saved", [(200, 1000, 10), (400, 1200, 20)])
def test_evolution_saves_containers(low, high, saved):
    sizes = np.random.default_rng(7).integers(low, high, 2000)
    fit = P.first_solution(sizes, 2048, np.random.default_rng(1), 0.0)
    pop = P.evolve(sizes, 2048, [], np.random.default_rng(1))
    assert pop[0].used <= fit.used - saved // 2 and np.bincount(pop[0].bins, weights=sizes).max() <= 2048


def test_crossover_keeps_full_containers_whole():
    sizes = np.random.default_rng(3).integers(100, 900, 600)
    rng = np.random.default_rng(2)
    a, b = (P.ancestor(sizes, 2048, rng, n) for n in (0.02, 0.05))
    bins = P.crossover(a, b, rng)
    held = {frozenset(np.flatnonzero(bins == k)) for k in np.unique(bins[bins >= 0])}
    mine = {frozenset(np.flatnonzero(a.bins == k)) for k in range(a.used)}
    theirs = {frozenset(np.flatnonzero(b.bins == k)) for k in range(b.used) if b.room[k] == 0}
    assert held - mine <= theirs and held - mine


def test_savings(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(200, 1000, 3000))], "doc long, size long")
    rows = P.savings(df, "doc", "size", 2048, block_items=1000).collect()
    assert sum(r["items"] for r in rows) == 3000 and all(r.least <= r.evolved < r.best_fit for r in rows)
    packed = P.pack(df, "doc", "size", 2048, block_items=1000)
    assert packed.select("container").distinct().count() <= sum(r.best_fit for r in rows)
