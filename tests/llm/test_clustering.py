import hashlib
import random
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from conftest import rows_equal_sql

from stackloom.llm import centroid_clustering as C
from stackloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k, rounds, dims):
    """Vector by vector, in Python's whole numbers."""
    kept = [(i, [floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and abs(x) < float("inf") for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    z = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for step in range(rounds + 1):
        own = [min(range(len(z)), key=lambda c: (far(v, z[c]), c)) for _, v in kept]
        if step == rounds:
            break
        for c in range(len(z)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                z[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    dist = [far(v, z[c]) for (_, v), c in zip(kept, own, strict=True)]
    fit = lambda x: x if x < 2**63 else None
    inner = {c: sum(d for d, o in zip(dist, own, strict=True) if o == c) for c in set(own)}
    if any(d >= 2**63 for d in dist):
        inner = {c: None if any(d >= 2**63 for d, o in zip(dist, own, strict=True) if o == c) else s for c, s in inner.items()}
    whole = None if None in inner.values() else fit(sum(inner.values()))
    sha = lambda c: hashlib.sha256(",".join(map(str, z[c])).encode()).hexdigest()
    return [(i, c, fit(d), None if inner[c] is None else fit(inner[c]), whole, sha(c)) for (i, _), c, d in zip(kept, own, dist, strict=True)]


def rows_of(seed, n, dims, size=1.0):
    rng = random.Random(seed)
    hot = [rng.gauss(0, size) for _ in range(dims)]
    rows = []
    for i in range(n):
        v = list(hot) if i % 3 == 0 else [rng.choice([-1, 0, 1]) * size / 4 for _ in range(dims)] if i % 3 == 1 else [rng.gauss(0, size) for _ in range(dims)]
        rows.append((i, v))
    bad = [float("nan"), float("inf"), None]
    rows += [(n + j, [b, *hot[1:]]) for j, b in enumerate(bad)] + [(n + 3, None), (n + 4, []), (n + 5, hot[1:]), (None, hot), (None, None), (7, rows[8][1]), rows[9], rows[9]]
    return rows


@pytest.mark.parametrize(("seed", "n", "k", "dims", "size"), [(1, 300, 12, 3, 1.0), (2, 120, 40, 8, 0.3), (3, 20, 40, 2, 1.0), (4, 90, 5, 3, 1e36), (5, 90, 5, 3, 1e306)])
def test_clusters_by_brute_force(spark, monkeypatch, seed, n, k, dims, size):
    monkeypatch.setattr(C, "LEAF_ROWS", 4)
    rows = rows_of(seed, n, dims, size)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    got = C.cluster_vectors(df, k=k, rounds=4, dims=dims)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows, k, 4, dims)))


def test_query_equals_sql(spark, sf_dir):
    rows_equal_sql(QUERIES["op11_centroid_clustering"](spark, sf_dir), ORACLE_SQL["op11_centroid_clustering"], sf_dir)


def test_empty_tables_and_clashing_columns(spark):
    assert C.cluster_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 2.0], "x", "y", "z")], "vec_id long, embedding array<double>, v string, cluster string, ids string")
    assert [tuple(r)[:4] for r in C.cluster_vectors(df, dims=2).collect()] == [(1, 0, 0, 0)]
    odd = df.select("vec_id", df.embedding.alias("a.b"))
    assert C.cluster_vectors(odd, dims=2, vec_col="a.b").count() == 1


def test_whole_nodes_are_assigned_without_their_vectors():
    """A node of equal vectors and one far from all but one centroid are settled by their boxes; ties are left to the leaves."""
    rng = np.random.default_rng(0)
    x = np.concatenate([np.full((3000, 4), 0.5), 100 + rng.random((1000, 4))])
    tree, order = C.Tree.build(x, 256)
    z = np.array([[128] * 4, [130] * 4, [25700] * 4], object)
    nodes, own, points, _ = C.nearest(tree, z)
    assert len(points) == 0 and sorted(set(own.tolist())) == [0, 2]
    assert sum(int(tree.end[i] - tree.start[i]) for i in nodes) == 4000
    assert (np.sort(order) == np.arange(4000)).all()
    _, _, points, best = C.nearest(tree, np.array([[127] * 4, [129] * 4, [25700] * 4], object))
    assert len(points) == 3000 and set(best.tolist()) == {0}


def test_sums_of_any_size_add_up():
    a = '[[1, 0], [[100000000000000000000000000000, -5], [0, 0]]]'
    count, total = C.added([a, a, a])
    assert count == [3, 0] and total.tolist() == [[3 * 10**29, -15], [0, 0]]
