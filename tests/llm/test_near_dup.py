import contextlib
import io
import random

import numpy as np
import pytest

from quern.llm import components, near_dup
from quern.llm.components import connected_components

from . import cases


def brute(rows, n, percent):
    """Every pair by its definition; a null or empty text links with nothing."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            both = len(sets[i] & sets[j])
            if same_id or sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(spark, rows, s):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.components(cases.documents(spark, rows), s).collect()), key=str)


def copies(seed, groups, size, edits):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(120)]
        for _ in range(size):
            mine = list(words)
            for _ in range(rng.randint(0, edits)):
                mine[rng.randrange(len(mine))] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(mine)))
    rng.shuffle(rows)
    return rows


def boilerplate(n, clusters=0, common=60, own=40, seed=4):
    """Texts that share their first ``common`` words and nothing else, but for ``clusters`` groups of four near copies."""
    rng = random.Random(seed)
    shared = [f"c{i}" for i in range(common)]
    rows = [(i, " ".join(shared + [f"u{rng.randint(0, 10**9)}" for _ in range(own)])) for i in range(n - 4 * clusters)]
    for c in range(clusters):
        words = [f"k{rng.randint(0, 10**9)}" for _ in range(own)]
        rows += [(n + 4 * c + j, " ".join(shared + words[: own - j] + [f"e{c}x{j}"] * j)) for j in range(4)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("rows", "s"), [
    (copies(1, 30, 4, 8), near_dup.Settings(words=4)),
    (copies(2, 2, 60, 7), near_dup.Settings(words=4, cell=16, guests=2)),
    (copies(3, 1, 90, 9), near_dup.Settings(words=5, cell=12, guests=1)),
    (boilerplate(240, 20), near_dup.Settings(words=4, cell=12, guests=1, cell_shingles=900)),
], ids=["small", "cells", "rest", "boilerplate"])
def test_components_equal_all_pairs(spark, rows, s):
    assert found(spark, rows, s) == brute(rows, s.words, s.percent)


def test_rows_of_every_kind(spark):
    s = near_dup.Settings(words=4)
    rows = [r for r in cases.TEXTS if r[0] is not None]
    assert found(spark, rows, s) == brute(rows, 4, 80)
    assert cases.ids(near_dup.components(cases.documents(spark), s)) == cases.ALL_IDS


def test_null_ids_get_the_component_of_an_equal_text(spark):
    rows = [(5, "a b c d e"), (None, "a b c d e"), (None, "lonely text of its own")]
    assert found(spark, rows, near_dup.Settings(words=4)) == sorted([(5, 2, 5), (None, 2, 5), (None, 2, None)], key=str)


def test_common_passages_do_not_make_all_texts_meet(spark, monkeypatch):
    """Texts at a similarity of 0.4 share keys and so a family; what is compared after its first cells mustn't grow with the square."""
    seen = []
    compare = near_dup._compare
    monkeypatch.setattr(near_dup, "_compare", lambda rows, s: seen.append(rows.select("node", "cell").count()) or compare(rows, s))
    for n in (300, 600):
        near_dup.components(cases.documents(spark, boilerplate(n, 5), extra=False), near_dup.Settings(words=4, cell=32, guests=2)).count()
    assert 250 < seen[0] and seen[2] < 2.5 * seen[0]
    assert seen[1] <= 60 and seen[3] <= 60  # the clusters alone


@pytest.mark.parametrize("query", [near_dup.components, near_dup.distinct_documents])
def test_only_bounded_sides_are_broadcast(spark, monkeypatch, query):
    """A join left to the planner is a broadcast by the bytes of a compressed file, or of rows before they are exploded; the driver has to hold it."""
    joins = []

    def note(df, *_):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain("extended")
        logical = out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        joins.extend(x.strip() for x in logical.splitlines() if " Join " in f" {x.lstrip(' :+-')}")
        return df

    for module in (near_dup, components):
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: f(note(df), name))
    note(query(cases.documents(spark, boilerplate(240, 20)), near_dup.Settings(words=4, cell=12, guests=1, cell_shingles=900)))
    assert len(joins) > 20 and [x for x in joins if "strategy=" not in x] == []


def test_the_rarest_shingles_of_alike_sets_meet():
    rng = np.random.default_rng(3)
    hashes = np.sort(rng.integers(0, 2**40, 500).astype(np.uint64))
    counts = rng.integers(2, 90, 500)
    for _ in range(300):
        a = np.unique(np.r_[rng.choice(hashes, 60), rng.integers(0, 2**40, rng.integers(1, 30)).astype(np.uint64)])
        b = np.unique(np.r_[rng.choice(a, max(1, int(len(a) * 0.9)), replace=False), rng.integers(0, 2**40, rng.integers(0, 4)).astype(np.uint64)])
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            assert len(np.intersect1d(near_dup.rarest(a, hashes, counts, 80), near_dup.rarest(b, hashes, counts, 80)))


def test_texts_under_one_id_are_texts_of_their_own(spark):
    lone = [f"text number {i} of its own with words w{i} x{i} y{i} z{i}" for i in range(4)]
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(1, lone[0]), (1, lone[1]), (1, near), (0, near + " end"), (0, near + " end"), (None, lone[2]), (None, lone[2]), (None, near), (3, lone[0]), (4, ""), (4, ""), (5, None), (None, lone[3])]
    got = near_dup.distinct_documents(cases.documents(spark, rows))
    assert got.columns == cases.documents(spark).columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, lone[0]), (1, lone[1]), (0, near + " end"), (None, lone[2]), (4, ""), (5, None), (None, lone[3])], key=str)


def test_no_documents(spark):
    assert near_dup.components(cases.documents(spark, [])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (3, 3)]
    for portion in (1_000_000, 9):
        got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), portion).collect()}
        assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}}


def test_components_of_random_graphs_in_portions(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for portion in (1_000_000, 20):
        got = {r.node: r.root for r in connected_components(df, portion).collect()}
        assert got == {x: r for x, r in root.items() if x != r}
