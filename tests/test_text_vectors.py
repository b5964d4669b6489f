"""Tokens, weights and vectors against values worked out by hand."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import ids, text, vectors
from quern.operators import tfidf, vector_store
from quern.sources import tables


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


def test_tokenizer_edges(spark):
    got = one(spark, "café don't 'tis dogs' abc1 1abc x_y 3'abc naïve été it's a''b", text.tokens)
    assert got == ["caf", "don't", "tis", "dogs", "'abc", "na", "ve", "t", "it's", "a''b"]
    assert one(spark, None, text.tokens) == []


def test_titles(spark):
    for title, fine in (("Computer Science", True), ("a_b 9", True), ("C++", False), ("Café", False)):
        assert one(spark, title, text.plain_title) is fine


def test_leading_int(spark):
    for v, n in (("+0022", 22), ("-0011", -11), ("12abc", 12), ("abc", None)):
        assert one(spark, v, text.leading_int) == n


def test_sections(spark):
    s = one(spark, "a\n\nb\n\nc", text.sections)
    assert (s.intro, s.rest) == ("a", "b c")
    assert one(spark, "", text.sections).rest == ""


DOCS = [(1, "Cat", "the cat dog", "dog fish"), (2, "Dog", "dog", ""), (3, "Fish", "the fish fish cat", "zebra"), (4, "zebra", "the", "")]
LEXICON = [("cat", [1.0, 0.0]), ("dog", [0.0, 1.0]), ("fish", [1.0, 1.0])]


def test_document_vectors_by_hand(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, title string, intro string, rest string")
    lexicon = spark.createDataFrame(LEXICON, "word string, vec array<double>")
    words = tfidf.in_vocabulary(tfidf.without_stop_words(tfidf.section_words(docs), tables.stop_words(spark)), lexicon)
    w = tfidf.weights(tfidf.section_freq(words), docs.agg(F.count("*").alias("total")))
    got = {r.doc_id: r.vec for r in tfidf.document_vectors(w, lexicon, docs).collect()}
    assert got[1] == pytest.approx([0.074529485571, 0.024843161857], abs=1e-10)
    assert got[2] == pytest.approx([0, 0.304147465438], abs=1e-10)
    assert got[3] == pytest.approx([0.111959287532, 0.083969465649], abs=1e-10)
    assert got[4] == [0.0, 0.0]


def test_no_weight_is_null(spark):
    docs = spark.createDataFrame([(1, "cat", "", ""), (2, "dog", "", "")], "doc_id long, title string, intro string, rest string")
    lexicon = spark.createDataFrame(LEXICON, "word string, vec array<double>")
    w = tfidf.weights(tfidf.section_freq(tfidf.section_words(docs)), docs.agg(F.count("*").alias("total")))
    assert [r.vec for r in tfidf.document_vectors(w, lexicon, docs).collect()] == [None, None]  # ln(2 / 2) = 0


def test_online_statistics_follow_the_order(spark):
    rng = random.Random(3)
    docs = [(i * 7, " ".join(rng.choice("abcd") * 2 for _ in range(3))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.word): (r.n_docs, r.df) for r in tfidf.online_idf(tfidf.term_freq(tfidf.words(df)), df).collect()}
    expected, seen = {}, {}
    for n, (i, t) in enumerate(docs, 1):
        for w in set(t.split()):
            seen[w] = seen.get(w, 0) + 1
            expected[i, w] = (n, seen[w])
    assert got == expected


def test_upsert_keeps_the_latest(spark):
    now = spark.createDataFrame([("b", [0.0, 2.0])], "doc_id string, embedding array<double>")
    writes = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 2), ("a", [1.0, 1.0], 3)], "doc_id string, embedding array<double>, seq long")
    c = vector_store.upsert(now, writes)
    assert {r.doc_id: r.embedding for r in c.collect()} == {"a": [1.0, 1.0], "b": [0.0, 1.0]}
    q = spark.createDataFrame([([1.0, 0.0],)], "vec array<double>")
    top = vector_store.nearest(c, q, 2).collect()
    assert [(r["rank"], r.doc_id) for r in top] == [(1, "a"), (2, "b")]
    assert top[0].distance == pytest.approx(1 - 1 / math.sqrt(2))


def test_vectors_without_length_are_left_out(spark):
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([([3.0, 4.0],)], "vec array<double>")
    assert [r.doc_id for r in vector_store.nearest(c, q, 5).collect()] == [2]
    assert c.select(vectors.norm(F.col("embedding")).alias("n")).collect() == [(0.0,), (5.0,)]


def test_cells_find_most_and_compare_few(spark, sf, tmp_path):
    """On the clustered table made of the test vectors: at most a tenth of all pairs is compared."""
    from quern.operators import cells
    from quern.plans import catalogue

    c = catalogue._clustered(spark, sf).cache()
    asked = c.where("doc_id % 50 = 0").selectExpr("doc_id AS query_id", "embedding AS vec")
    exact = {(r.query_id, r.doc_id) for r in vector_store.nearest_batch(c, asked, 10).collect()}
    index = cells.build(c, str(tmp_path / "index"))
    found = {(r.query_id, r.doc_id) for r in cells.search(index, asked, 10).collect()}
    c.unpersist()
    assert len(exact) == 10 * asked.count() and len(exact & found) >= 0.9 * len(exact)
    assert cells.compared(index, asked) <= 0.1
    # One query reads the folders of its cells and no others.
    one = cells.search(index, asked.limit(1), 10, probes=2)
    assert one.count() == 10 and len({f for f in index.rows(spark).inputFiles()}) > 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_cells_of_odd_collections(spark, tmp_path):
    from quern.operators import cells

    schema = "doc_id string, embedding array<double>"
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None), ("zero", [0.0, 0.0])], "query_id string, vec array<double>")
    assert cells.search(cells.build(spark.createDataFrame([], schema), str(tmp_path / "a")), asked, 3).count() == 0
    same = spark.createDataFrame([(f"d{i}", [2.0, 0.0]) for i in range(9)] + [("far", [-1.0, 0.1]), ("null", None), ("zero", [0.0, 0.0])], schema)
    got = cells.search(cells.build(same, str(tmp_path / "b"), cells=3), asked, 3).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id, r.distance) for r in got] == [("q", f"d{i}", 0.0) for i in range(3)]


def test_lexicon_file_first_definition_wins(spark, tmp_path):
    (tmp_path / "v.txt").write_text("rank -1.06 0.5\ncat 1 2\nrank 9 9\n")
    got = {r.word: r.vec for r in tables.word_vectors(spark, str(tmp_path)).collect()}
    assert got["rank"] == pytest.approx([-1.06, 0.5]) and got["cat"] == [1.0, 2.0]


def test_lists_and_logs(spark, tmp_path):
    (tmp_path / "nodes.txt").write_text("10.0.0.1\n\n10.0.0.2\n")
    assert [r.ip for r in tables.node_list(spark, str(tmp_path / "nodes.txt")).collect()] == ["10.0.0.1", "10.0.0.2"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "k.txt").write_text("one\n \ntwo\n")
    assert [(r.key, r.value) for r in tables.log_lines(spark, str(tmp_path / "log")).orderBy("seq").collect()] == [("k", "one"), ("k", "two")]


def test_placement_by_hand(spark):
    nodes = spark.createDataFrame([("127.0.0.1", p) for p in (10000, 10001, 10002)], "ip string, port int")
    nodes = nodes.withColumn("nid", ids.node_id(F.col("ip"), F.col("port")))
    nid = {r.port: r.nid for r in nodes.collect()}
    assert [nid[p][:8] for p in (10000, 10001, 10002)] == ["8df6d087", "919d3f2a", "8970c410"]
    keys = spark.createDataFrame([(f"key{i}",) for i in range(30)], "key string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kid = {f"key{i}": sha(f'"key{i}"') for i in range(30)}
    ring = sorted(nid.values())
    assert {r.key: r.k for r in keys.select("key", ids.key_id(F.col("key")).alias("k")).collect()} == kid
    assert {r.key: r.nid for r in ids.consistent_owner(keys, nodes).collect()} == {k: min((n for n in ring if n >= x), default=ring[0]) for k, x in kid.items()}
    assert {r.key: r.nid for r in ids.rendezvous_owner(keys, nodes).collect()} == {k: max(ring, key=lambda n: sha(f'"{x}{n}"')) for k, x in kid.items()}
    assert {r.key: r.nid for r in ids.naive_owner(keys, nodes).collect()} == {k: ring[int(x, 16) % 3] for k, x in kid.items()}


def test_equal_distances_go_by_id(spark):
    """Sums in another order differ in their last bits, which mustn't order anything."""
    c = spark.createDataFrame([(i, [0.1, 0.2, 0.3] if i % 2 else [0.3, 0.2, 0.1]) for i in range(9, 0, -1)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 1.0, 1.0])], "query_id long, vec array<double>")
    assert [r.doc_id for r in vector_store.nearest(c, q, 9).orderBy("rank").collect()] == list(range(1, 10))
    for size in (64 << 20, 600):
        many = spark.createDataFrame([(i, [1.0, 1.0, 1.0 + i]) for i in range(20)], "query_id long, vec array<double>")
        got = vector_store.nearest_batch(c, many, 3, block_bytes=size)
        assert got.count() == 60 and [r.doc_id for r in got.where("query_id = 0").orderBy("rank").collect()] == [1, 2, 3]
