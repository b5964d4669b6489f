import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import queries, toxicity

from . import cases


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(0)
    chain = toxicity.Chain(start=-1.0, move=rng.normal(size=(2, 2)))
    lengths = [5, 1, 7, 3, 9]
    begins = np.cumsum([0, *lengths[:-1]])
    scores = rng.normal(size=sum(lengths)) * 2
    p, pair = chain.marginals(scores, begins, pairs=True)
    for b, n in zip(begins, lengths, strict=True):
        z, m, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            q = np.exp(chain.start * y[0] + sum(scores[b + i] * y[i] for i in range(n)) + sum(chain.move[y[i - 1], y[i]] for i in range(1, n)))
            z, m = z + q, m + q * np.array(y)
            for i in range(1, n):
                both[i, y[i - 1], y[i]] += q
        assert np.allclose(m / z, p[b : b + n])
        assert np.allclose(both[1:] / z, pair[b + 1 : b + n])


def test_marginals_do_not_depend_on_what_stands_beside():
    rng = np.random.default_rng(1)
    chain = toxicity.Chain(move=rng.normal(size=(2, 2)))
    a, b = rng.normal(size=400), rng.normal(size=37)
    both = chain.marginals(np.r_[a, b], np.array([0, 400]))
    assert np.allclose(both, np.r_[chain.marginals(a, np.array([0])), chain.marginals(b, np.array([0]))])


def corpus(n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(cases.WORDS) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.3
        for _ in range(rng.randint(1, 4) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["vilething", "vilestuff", "grimword"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def learnt(spark):
    rows, labels = corpus()
    docs, marks = cases.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return rows, labels, docs, toxicity.train(docs, marks)


def test_held_out_documents_are_told_apart(spark, learnt):
    rows, labels, docs, model = learnt
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    out = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    truth = {i: y for i, _, y in labels}
    assert sum((got[i].score >= 0.5) == truth[i] for i in out) / len(out) > 0.97
    text = dict(rows)
    for r in got.values():
        assert all(text[r.doc_id][s.start : s.end].split()[0] in ("vilething", "vilestuff", "grimword") for s in r.spans)


def test_rows_of_every_kind(spark, learnt):
    model = learnt[3]
    got = toxicity.score(cases.documents(spark), model, tokens_at_once=50)
    assert cases.ids(got) == cases.ALL_IDS
    assert all(0 <= r.score <= 1 for r in got.collect())
    kept = toxicity.without_toxic(cases.documents(spark), model)
    assert kept.columns == cases.documents(spark).columns and cases.ids(kept) == cases.ALL_IDS
    assert toxicity.score(cases.documents(spark, []), model).count() == 0


def test_held_out_rule(spark):
    got = spark.range(-20, 200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_held_out_labels_change_nothing(spark):
    rows, labels = corpus(120)
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    docs = cases.documents(spark, rows)
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert a.chain.weights == b.chain.weights and np.array_equal(a.curve, b.curve)


def test_no_labels_or_one_class(spark):
    schema = "doc_id long, quality int, toxic int"
    docs = cases.documents(spark)
    for labels, high in (([], False), ([(5, 1, 0), (7, 1, None)], False), ([(i, 1, 1) for i in range(12)], True)):
        got = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, schema))).collect()
        assert all((r.score > 0.5) == high and not r.spans for r in got)


def test_query_has_the_contracts_columns(spark, sf):
    df = queries.op7_toxicity(spark, sf)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert df.where("predicted <> cast(score >= 0.5 as int)").isEmpty()


def test_repeated_rows_are_learnt_once_and_within_the_limits(spark):
    rows = [(1, "plain words " * 20)] * 3000 + [(1, "other words")] * 5 + [(i, f"text {i}") for i in range(2, 60)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(60)] + [(4, 1, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts, toxic, weights = toxicity.training_rows(docs, marks, 10, 1000)
    assert len(texts) == len(toxic) == len(weights) == 20 and sum(map(len, texts)) <= 1000
    texts, _, _ = toxicity.training_rows(docs, marks, 1000, 100_000)
    out = {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(texts) == len({i for i, _ in rows} - out)


def test_held_out_documents_of_the_tables_are_told_apart(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest table has too few labels for a rate
    found = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").collect()
    hits = [r.predicted for r in found if r.toxic == 1]
    assert len(found) > 20 and sum(r.predicted == r.toxic for r in found) / len(found) >= 0.9
    assert not hits or sum(hits) / len(hits) >= 0.6
