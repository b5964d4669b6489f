import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import mixing

from . import cases


def test_targets():
    sizes, w = np.array([100, 1000, 10]), np.array([5.0, 2.0, 1.0])
    t = mixing.water_fill(sizes, w, 3.0)
    assert t.sum() == pytest.approx(1110) and t[0] == 300 and t[2] == 30 and t[1] == pytest.approx(780)
    assert mixing.water_fill(np.array([50, 50]), np.array([1.0, 1.0]), 3.0).tolist() == [50, 50]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 63, 64, 65, 1000])
def test_permutations(n):
    i = np.arange(n)
    out = [mixing.permuted(i, n, np.full(n, k, np.uint64)) for k in range(5)]
    assert all(sorted(x) == list(range(n)) for x in out)
    assert n < 60 or any((out[0] != x).any() for x in out[1:])


def test_shards_add_up():
    slots = np.array([1000, 0, 37, 5000])
    shards = -(-6037 // 100)
    parts = [mixing.shard_counts(slots, s, shards, 100, 3) for s in range(shards)]
    before = np.zeros(4, np.int64)
    for counts, base in parts:
        assert (base == before).all() and counts.sum() <= 100
        before += counts
    assert (before == slots).all()
    first = np.array([c[0] for c, _ in parts[:-1]])
    assert first.std() > 0 and abs(first.mean() - 100 * 1000 / 6037) < 2


def test_draws_over_ten_thousand_million_slots_are_random_and_exact():
    slots, size = np.array([7_000_000_000, 0, 2_999_999_997, 5]), 4096
    shards = -(-int(slots.sum()) // size)
    at = [0, 1, shards // 3, shards - 1]
    by_seed = [[mixing.shard_counts(slots, s, shards, size, seed) for s in at] for seed in range(6)]
    assert len({tuple(parts[2][1]) for parts in by_seed}) == 6  # what two thirds of the shards hold differs from seed to seed
    for parts in by_seed:
        assert (parts[0][1] == 0).all() and (parts[1][1] == parts[0][0]).all()
        assert (parts[-1][0] + parts[-1][1] == slots).all() and all(c.sum() == size for c, _ in parts[:-1])
        assert abs(int(parts[2][1][0]) - 0.7 * parts[2][1].sum()) < 6 * np.sqrt(1e10 * 0.21 * 2 / 9)


def test_drawn_counts_follow_the_hypergeometric_law():
    rng, counts = np.random.default_rng(2), np.array([60, 30, 10])
    x = np.array([mixing.drawn(counts, 40, rng) for _ in range(20_000)])
    assert (x.sum(axis=1) == 40).all() and (x <= counts).all()
    assert np.allclose(x.mean(axis=0), 40 * counts / 100, atol=0.06)
    assert np.allclose(x.var(axis=0), 40 * counts / 100 * (1 - counts / 100) * 60 / 99, rtol=0.05)


def test_equal_ids_and_sizes_are_in_one_order(spark):
    rows = [(1, f"{w} " * 40) for w in cases.WORDS] + [(2, "x y"), (2, "x y")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    a, b = (sorted(map(str, mixing.mixed_blocks(d, block=16).collect())) for d in (docs, docs.orderBy(F.col("text").desc()).repartition(3)))
    assert a == b


def brute(rows, block, most=3.0):
    sizes = {}
    for s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    t = mixing.water_fill(np.array([sizes[s] for s in order]), np.resize(np.array([5.0, 2.0, 1.0]), len(order)), most)
    return sizes, dict(zip(order, t, strict=True))


def test_taken_words(spark):
    rows = [(i, cases.sentence(i, 5 + (i * 37) % 300)) for i in range(300)] + cases.TEXTS
    docs = cases.documents(spark, rows)
    got = mixing.taken(docs).collect()
    again = mixing.taken(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    info = [(r.source, len((r.text or "").encode().split())) for r in docs.collect()]
    sizes, targets = brute(info, 64)
    assert sorted((r.size for r in got)) == sorted(n for _, n in info)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    for s, t in targets.items():
        mine = [r for r in got if r.source_size == sizes[s]]  # no two sources are of one size here
        assert abs(sum(r.taken for r in mine) - t) <= 64 * 3 and {round(r.target, 6) for r in mine} == {round(t, 6)}


def test_blocks_hold_the_words_that_are_taken(spark):
    docs = cases.documents(spark, [(i, f"d{i} " * (10 + i)) for i in range(80)])
    taken = {r.doc_id: r.taken for r in mixing.taken(docs, block=16).collect()}
    words = {}
    blocks = mixing.mixed_blocks(docs, block=16).collect()
    for r in blocks:
        for w in r.text.split():
            words[int(w[1:])] = words.get(int(w[1:]), 0) + 1
        assert set(r.doc_ids) == {int(w[1:]) for w in r.text.split()} and len(r.text.split()) <= 16
    assert words == {i: n for i, n in taken.items() if n}
    assert len({(r.shard, r.slot) for r in blocks}) == len(blocks)


def test_rows_of_every_kind(spark):
    assert cases.ids(mixing.taken(cases.documents(spark))) == cases.ALL_IDS
    assert mixing.taken(cases.documents(spark, [])).count() == 0
    assert mixing.mixed_blocks(cases.documents(spark, [])).count() == 0
    assert [(r.size, r.taken, r.target) for r in mixing.taken(cases.documents(spark, [(1, ""), (1, None)])).collect()] == [(0, 0, 0.0)] * 2


def test_rows_without_ids_are_dealt_out(spark):
    """A third of all rows has no id; no bucket of a source holds much more than another."""
    rows = [(None if i % 3 == 0 else i, "one source", f"text {i} of some words") for i in range(6000)]
    sizes = mixing.sized(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    bucket = mixing.bucket(64)
    n = [r["count"] for r in sizes.groupBy(bucket).count().collect()]
    assert len(n) == 64 and max(n) < 2 * sum(n) / 64
