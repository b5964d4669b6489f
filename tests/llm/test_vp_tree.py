"""Vantage-point trees against brute force."""

import math

import numpy as np
import pytest
from quern.llm import vp_tree

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = min(kept.get(i, v), v)
    out = {}
    for i in asked:
        if i in kept:
            score = {j: sum(x * y for x, y in zip(kept[i], kept[j])) for j in kept if j != i}
            out[i] = [(j, score[j]) for j in sorted(score, key=lambda j: (-score[j], j))[:k]]
    return out


def found(spark, rows, asked, k, factor, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS cell", "1 AS sub", "2 AS v", "3 AS ask", "4 AS score")
    queries = df.where(df.vec_id.isin(asked)).selectExpr("vec_id AS query_id", "embedding AS vec", "5 AS cell", "6 AS least")
    out = {}
    for r in sorted(vp_tree.search(vp_tree.build(df, **how), queries, k, factor).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def clusters(n, dim, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    rows = centres[rng.integers(8, size=n)] + spread * rng.normal(size=(n, dim))
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(rows)]


def test_factor_one_is_exact(spark):
    rows = clusters(600, 6, 1)
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a third of all rows are one vector
    asked = [0, 7, 300, 599, 1000, 1100]
    got = found(spark, rows, asked, 20, 1.0, rows_per_shard=100, leaf=16)
    want = brute(rows, asked, 20)
    assert {i: [j for j, _ in x] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for i in want for a, b in zip(got[i], want[i]))


def test_lengths_that_differ_widely(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(10.0 ** rng.integers(-3, 4) * rng.normal(size=5))]) for i in range(300)]
    asked = list(range(0, 300, 30))
    got, want = found(spark, rows, asked, 7, 1.0, rows_per_shard=64, leaf=8), brute(rows, asked, 7)
    assert {i: [j for j, _ in x] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in want.items()}


def test_tuned_recall(spark):
    rows = clusters(1500, 24, 3, spread=0.6)
    asked = list(range(0, 1500, 25))
    got, want = found(spark, rows, asked, 10, None, rows_per_shard=150, leaf=16), brute(rows, asked, 10)
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits >= 0.93 * 10 * len(want) and all(len(got[i]) == 10 for i in want)


def test_smaller_factors_look_at_less():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(512, 8))
    tree, at = vp_tree.fit(rows, 5, tight=True)
    d = vp_tree.distances(rows[:40], rows)
    low = tree.bounds(rows[:40])
    # A bound never exceeds the nearest row of its leaf.
    for leaf in range(32):
        assert (low[:, leaf] <= d[:, at == leaf].min(axis=1) + 1e-9).all()
    reach = np.sort(d, axis=1)[:, 5]
    visited = [(low <= f * reach[:, None]).mean() for f in (0.1, 0.5, 1.0)]
    assert visited == sorted(visited) and visited[0] < 0.7 * visited[2] < 0.7
    loose, at = vp_tree.fit(rows, 3, tight=False)
    assert (loose.place(rows) == at).all()


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [2.0]), (8, [float("-inf"), 1.0])]
    got = found(spark, rows, [0, 2, 3, 4, 5, 6, 7], 20, None)
    assert got == {0: [(7, 2.0), (1, 0.5)], 7: [(0, 2.0), (1, 1.0)]}
    assert found(spark, [], [1], 5, None) == {} and found(spark, rows, [], 5, 1.0) == {}
    assert found(spark, [(1, [1.0])], [1], 5, None) == {}
