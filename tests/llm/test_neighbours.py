import numpy as np

from skarnwell.llm import neighbours as N


def brute(keys, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    out = {}
    for i, key in enumerate(keys):
        order = sorted((j for j in range(len(keys)) if s[i, j] >= least), key=lambda j: (-s[i, j], keys[j]))[:k]
        out[key] = {keys[j] for j in order}
    return out


def data(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 2, dim))
    near = base[: n // 4] + 0.25 * rng.standard_normal((n // 4, dim)) * np.linalg.norm(base[: n // 4], axis=1, keepdims=True) / dim**0.5
    x = np.concatenate([base, near, rng.standard_normal((n - n // 2 - n // 4, dim))]).astype(np.float32)
    return [f"k{i:05d}" for i in range(n)], x


def test_recall_above_a_cosine(spark):
    keys, x = data(4000, 64)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)], "key string, v array<float>")
    got = {}
    for r in N.most_similar(df, "key", "v", 64, k=10, min_cosine=0.9, leaf_rows=128).collect():
        got.setdefault(r.key, set()).add(r.other)
    want = {k: v for k, v in brute(keys, x.astype(np.float64), 10, 0.9).items() if v}
    hit = sum(len(v & got.get(k, set())) for k, v in want.items())
    assert len(want) > 1000 and hit >= 0.98 * sum(map(len, want.values()))


def test_recall_of_all_ten(spark):
    keys, x = data(1500, 64, 1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)], "key string, v array<float>")
    got = {}
    for r in N.most_similar(df, "key", "v", 64, k=10, trees=6, probes=36, leaf_rows=128).collect():
        got.setdefault(r.key, set()).add(r.other)
    want = brute(keys, x.astype(np.float64), 10, -1)
    assert sum(len(v & got[k]) for k, v in want.items()) >= 0.9 * 10 * len(keys)


def test_copies_bad_vectors_and_clashing_names(spark):
    one, two = [1.0] * 4, [1.0, 1.0, 1.0, 0.9]
    rows = [("a", one), ("b", one), ("b", one), ("c", [2.0] * 4), ("d", two), ("z", [0.0] * 4), ("n", None), ("s", [1.0]), (None, one), ("x", [float("nan")] * 4), ("y", [None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "class string, vector array<float>, cosine int")
    got = N.most_similar(df, "class", "vector", 4, k=2)
    by = {}
    for r in got.orderBy("key", "rank").collect():
        by.setdefault(r.key, []).append(r.other)
    assert by == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"], "d": ["a", "b"]}
    assert sorted(map(tuple, N.mutual(got, 0.9).collect())) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert N.most_similar(df.limit(0), "class", "vector", 4).count() == 0


def test_leaves_hold_every_vector_once_per_tree():
    _, x = data(600, 16)
    x = N.unit(x.astype(np.float64))
    forest = [N.fit_tree(x, 4, s) for s in range(3)]
    leaf, own = N.search_leaves(forest, x, 12)
    assert (own.sum(1) == 3).all() and all(len(set(r)) == 12 for r in leaf)


def test_ten_best_in_a_tight_cluster(spark):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal(64) + 0.015 * rng.standard_normal((600, 64))).astype(np.float32)
    keys = [f"k{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)], "key string, v array<float>")
    got = {}
    for r in N.most_similar(df, "key", "v", 64, k=10).collect():
        got.setdefault(r.key, set()).add(r.other)
    assert got == brute(keys, x.astype(np.float64), 10, -1)


def test_recall_in_a_cluster_with_a_third_of_the_rows(spark):
    rng = np.random.default_rng(6)
    hot = rng.standard_normal(64) + 0.3 * rng.standard_normal((1500, 64))
    x = np.concatenate([hot, rng.standard_normal((3000, 64))]).astype(np.float32)
    keys = [f"k{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)], "key string, v array<float>")
    got = {}
    for r in N.most_similar(df, "key", "v", 64, k=10, min_cosine=0.9, leaf_rows=32).collect():
        got.setdefault(r.key, set()).add(r.other)
    want = {k: v for k, v in brute(keys, x.astype(np.float64), 10, 0.9).items() if v}
    hit, total = sum(len(v & got.get(k, set())) for k, v in want.items()), sum(map(len, want.values()))
    assert len(want) > 1400 and hit >= 0.98 * total


def test_leaves_beyond_the_sample_are_divided(spark):
    """A sample of 200 vectors gives 32 leaves of 250; meant are 32 vectors, so every leaf gets a forest of its own."""
    keys, x = data(8000, 64, 8)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)], "key string, v array<float>")
    got = {}
    for r in N.most_similar(df, "key", "v", 64, k=10, min_cosine=0.9, sample_rows=200, leaf_rows=32).collect():
        got.setdefault(r.key, set()).add(r.other)
    want = {k: v for k, v in brute(keys, x.astype(np.float64), 10, 0.9).items() if v}
    assert len(want) > 2000 and sum(len(v & got.get(k, set())) for k, v in want.items()) >= 0.95 * sum(map(len, want.values()))


def test_a_stated_query_set(spark):
    from pyspark.sql import functions as F

    keys, x = data(1500, 64, 3)
    df = spark.createDataFrame([(k, v.tolist(), i) for i, (k, v) in enumerate(zip(keys, x))], "key string, v array<float>, asks int")
    got = {}
    for r in N.most_similar(df, "key", "v", 64, k=10, leaf_rows=128, asked=F.col("asks") % 20 == 0).collect():
        got.setdefault(r.key, set()).add(r.other)
    want = {k: v for k, v in brute(keys, x.astype(np.float64), 10, -1).items() if int(k[1:]) % 20 == 0}
    assert got.keys() == want.keys() and sum(len(v & got[k]) for k, v in want.items()) >= 0.95 * 10 * len(want)
