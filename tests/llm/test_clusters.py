"""Centroid clustering against plain rounds over exact integers."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import clusters as C


def brute(rows, clusters, rounds, size, scale, seed):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == size and all(x is not None and np.isfinite(x) for x in e):
            kept.append((vec_id, [int(np.floor(min(max(float(np.float32(x)) * scale, -C.MOST), C.MOST))) for x in e]))
    hashed = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [list(v) for _, v in hashed[:clusters]]
    if not centroids:
        return []
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        for k, vs in own.items():
            centroids[k] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = {k: sum(d for _, c, d in out if c == k) for k in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums.values()), sha[c]) for i, c, d in out), key=repr)


def ran(df, **settings):
    out = C.cluster(df, **settings)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


SCHEMA = "vec_id long, embedding array<float>, cluster string, v int, ids string, distance string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, "x", 1, None, "y") for i, e in rows], SCHEMA)


def test_rounds_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 2, (5, 4))
    rows = [(k, (centres[k % 5] + rng.normal(0, 0.7, 4)).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[3][1]) for k in range(200)]  # a very common vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, None), (2000, []), (2001, [1.0] * 3), (2002, [1.0, None, 0.0, 0.0]), (2003, [1.0, float("nan"), 0.0, 0.0]), (2004, [float("inf")] + [0.0] * 3), (2005, [-0.0004] * 4)]
    settings = dict(clusters=6, rounds=5, size=4, scale=64, seed=3)
    assert ran(table(spark, rows).repartition(3), **settings) == brute(rows, **settings)


def test_ties_go_to_the_smaller_number_and_equal_centroids_stay_empty(spark):
    rows = [(k, [float(k % 2), 0.0]) for k in range(40)]
    settings = dict(clusters=7, rounds=3, size=2, scale=2, seed=3)
    assert ran(table(spark, rows), **settings) == brute(rows, **settings)


def test_components_of_any_size(spark):
    rows = [(k, [3e38 if k % 3 else -3e38, float(k) * 1e4]) for k in range(30)]
    settings = dict(clusters=3, rounds=2, size=2, scale=1024, seed=3)
    assert ran(table(spark, rows), **settings) == brute(rows, **settings)


def test_few_and_no_vectors(spark):
    two = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    settings = dict(clusters=8, rounds=2, size=2, scale=10, seed=3)
    assert ran(table(spark, two), **settings) == brute(two, **settings)
    assert ran(table(spark, []), **settings) == []
    assert ran(table(spark, [(None, [1.0, 2.0]), (4, None)]), **settings) == []


@pytest.mark.parametrize("spread", [3, 300, C.MOST])
def test_cover_tree_holds_its_promises(spread):
    rng = np.random.default_rng(spread)
    v = rng.integers(-spread, spread, (400, 5))
    v[100:180] = v[5]
    tree = C.cover_tree(v, leaf=4)
    assert sorted(tree.order.tolist()) == list(range(400))
    w = v[tree.order]
    for n in range(len(tree.begin)):
        b, e = tree.begin[n], tree.end[n]
        assert ((w[b:e] - w[b]) ** 2).sum(1).max() == tree.radius[n]
        if tree.child[n] < 0:
            assert e - b <= 4 or tree.radius[n] == 0
            continue
        kids = range(tree.child[n], tree.child[n] + tree.children[n])
        assert tree.begin[kids[0]] == b and tree.end[kids[-1]] == e and len(kids) > 1
        near = max(tree.radius[k] for k in kids)
        assert near < tree.radius[n]
        for i in kids:
            for j in kids:
                assert i == j or ((w[tree.begin[i]] - w[tree.begin[j]]) ** 2).sum() > near
            assert i == kids[-1] or tree.end[i] == tree.begin[i + 1]


def test_pairs_of_far_nodes_are_never_compared(monkeypatch):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(10_000 * k, 20, (200, 6)) for k in range(-2, 3)]).astype(np.int64)
    tree = C.cover_tree(v)
    w, c = v[tree.order], v[::200].copy()
    spent = 0
    plain = C.squared

    def counted(a, b):
        nonlocal spent
        spent += len(a) * len(b)
        return plain(a, b)

    monkeypatch.setattr(C, "squared", counted)
    sums, counts = C.sums_of(w, tree, c, C.cover_tree(c, leaf=1))
    assert counts.tolist() == [200] * 5 and (sums == [w[(w // 5_000 + 1) // 2 == k].reshape(-1, 6).sum(0) for k in range(-2, 3)]).all()
    assert spent < len(v)  # five thousand comparisons without trees


def test_sizes_of_blocks_change_nothing(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(0, 1, 3).tolist()) for k in range(120)]
    kept = table(spark, rows).select("vec_id", C.integers(F.col("embedding"), 3, 100).alias("v"))
    for block in (1, 7, 500):
        made = C.trees(kept, 3, block).collect()
        assert sorted(i for r in made for i in r["ids"]) == list(range(120))
        assert all(len(r["ids"]) <= block and len(r["vectors"]) == 12 * len(r["ids"]) for r in made)
