"""Hard negatives against a plain computation of every window."""

import math
import random

import pytest
from quern.llm import hard_negatives
from quern.llm.hard_negatives import _scores

SCHEMA = "vec_id long, label int, embedding array<float>, anchor boolean"
FIELDS = "anchor_id positive_id rank negative_id positive_score negative_score".split()


def brute(rows, positives=5, negatives=3, low=50, high=95):
    kept = {}
    for i, label, v, anchor in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i] = min(kept.get(i, (label, v, anchor)), (label, v, anchor))
    codes = {i: [math.floor(256 * x) for x in v] for i, (_, v, _) in kept.items()}
    out = []
    for a, (label, _, anchor) in kept.items():
        if not anchor:
            continue
        score = {i: sum(x * y for x, y in zip(codes[a], codes[i])) for i in kept if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == label][:positives]:
            inside = [i for i in order if kept[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(inside[:negatives])]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS score", "1 AS slot", "2 AS v", "3 AS _pair", "4 AS place")
    return sorted(tuple(r[f] for f in FIELDS) for r in hard_negatives.mine(df, **how).collect())


def test_all_windows(spark):
    rng = random.Random(3)
    # Few directions and coarse steps: many ties, negative scores, equal limits.
    rows = [(i, rng.randrange(3), [rng.randrange(-3, 4) / 8 for _ in range(4)], i % 7 == 0) for i in range(300)]
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=1, low=0, high=100) == brute(rows, 2, 1, 0, 100)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.randrange(4), [rng.gauss(0.3, 1) for _ in range(5)], i % 5 == 0) for i in range(200)]
    want = brute([(i, l, [float(__import__("numpy").float32(x)) for x in v], a) for i, l, v, a in rows])
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    assert mined(spark, rows) == want


def test_rows_that_take_no_part(spark):
    one = [1.0, 0.5]
    rows = [(0, 1, one, True), (1, 1, one, False), (2, 1, one, False), (3, 2, [0.75, 0.25], False), (3, 2, [0.75, 0.25], False), (4, 2, [0.75, 0.25], False), (None, 2, [0.7, 0.2], False), (5, None, one, True), (6, 2, None, True), (7, 2, [float("nan"), 1.0], False), (8, 2, [None, 1.0], False), (9, 2, [], False), (10, 2, [0.75], False), (11, 2, [float("inf"), 0.0], True)]
    got = mined(spark, rows)
    assert got == brute([r for r in rows if r[0] not in (9, 10)] + [(9, 2, [0.0, 0.0], False), (10, 2, [0.75, 0.0], False)]) and {r[3] for r in got} >= {3, 4, 10}


def test_no_rows_no_anchors_no_positives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0], False), (2, 1, [1.0], False)]) == []
    assert mined(spark, [(1, 1, [1.0], True), (2, 2, [1.0], False)]) == []


def test_scores_are_exact():
    import numpy as np

    a = np.array([[2.0**40, 1.0]])
    assert _scores(a, np.array([[2.0**21, 1.0]]))[0, 0] == 2**61 + 1
    with pytest.raises(OverflowError):
        _scores(a, a * 2**10)
