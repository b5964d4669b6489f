"""Steps whose cost must not outgrow their input."""

import json
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import graph, postings, tfidf, vector_store
from quern.plans import catalogue
from quern.sources import page_source


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_and_weighted_where_their_document_is(spark, sf):
    found = plan(catalogue._weights(spark, sf))
    assert "REPARTITION_BY_NUM" in found and "hashpartitioning(word" not in found
    assert not re.search(r"hashpartitioning\(doc_id#\w+, word", found)


def test_vectors_with_a_lexicon_that_is_not_sent_whole(spark):
    docs = spark.createDataFrame([(1, "a", "b c c", "d"), (2, "c", "c", ""), (3, "e", "zzz", "e b"), (4, "zzz", "", ""), (5, "d", "e", "e")], "doc_id long, title string, intro string, rest string")
    words = ["c", "b", "e", "d"]
    lexicon = spark.createDataFrame([(w, [float(i + 1), 0.5 * i], i) for i, w in enumerate(words)], "word string, vec array<double>, place long")
    freq = tfidf.in_vocabulary(tfidf.section_freq(tfidf.section_words(docs)), lexicon)
    weighted = tfidf.weights(freq, docs.agg(F.count("*").alias("total")))
    whole = {r.doc_id: r.vec for r in tfidf.document_vectors(weighted, lexicon, docs).collect()}
    for most in (1, 160, 240):
        got = {r.doc_id: r.vec for r in tfidf.document_vectors(weighted, lexicon, docs, most).collect()}
        assert got.keys() == whole.keys() and all(np.allclose(got[i], whole[i]) for i in whole)


def test_many_queries_meet_a_batch_of_vectors_in_products_of_bounded_size(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = np.round(rng.normal(size=(700, 6)), 2)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc_id long, embedding array<double>").repartition(2)
    asked = c.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vec"))
    d = np.round(1 - vectors @ vectors.T / np.outer(*[np.linalg.norm(vectors, axis=1)] * 2), 6) + 0.0
    want = {i: np.lexsort((np.arange(700), d[i]))[:4].tolist() for i in range(700)}
    monkeypatch.setattr(vector_store, "CELLS", 5000)
    real, cells = vector_store.largest, spark.sparkContext.accumulator(0)

    def seen(scores, *rest):
        assert scores.size <= 5000
        cells.add(scores.size)
        return real(scores, *rest)

    monkeypatch.setattr(vector_store, "largest", seen)
    got = vector_store.nearest_batch(c, asked, 4).orderBy("query_id", "rank").collect()
    assert {i: [r.doc_id for r in got if r.query_id == i] for i in want} == want


def test_answers_are_written_and_read_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(page_source, "FILE_BYTES", 20_000)
    rows = spark.range(300).select(F.format_string("T%03d", "id").alias("title"), F.repeat(F.lit("xy "), 100).alias("extract"))
    answers = rows.select("title", page_source.answer_of(F.col("title"), F.col("extract"), F.array(F.lit("Main"))).alias("answer"))
    assert page_source.save_answers(answers, str(tmp_path / "a"), 2) == len(os.listdir(tmp_path / "a")) > 4
    monkeypatch.setattr(page_source, "BATCH_BYTES", 3000)
    reader = page_source.PageReader({"path": str(tmp_path / "a"), "partitions": "1"})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 300 and max(b.num_rows for b in batches) < 10
    assert sorted(t for b in batches for t in b.column("title").to_pylist()) == [f"T{i:03d}" for i in range(300)]


def test_values_of_other_kinds_are_texts(spark, tmp_path):
    page = {"title": 5, "extract": True, "links": [{"title": None}, {"title": 1.5}]}
    (tmp_path / "0~a.answers").write_text(json.dumps({"asked": "a", "answer": json.dumps({"query": {"pages": {"1": page}}})}) + "\n")
    spark.dataSource.register(page_source.PageSource)
    assert [tuple(r) for r in spark.read.format("pages").load(str(tmp_path)).collect()] == [("5", "true", [None, "1.5"], None)]


def test_online_counts_go_on_from_range_to_range(spark, sf):
    rows = [(3 * i - 40, " ".join(w for j, w in enumerate(["often", "a", "even", "third", "b's"]) if i % (j + 1) == 0) + " often") for i in range(60)] + [(None, "often even"), (500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stop = spark.createDataFrame([("a",)], "word string")
    got = {(r.doc_id, r.word): (r.n, r.size, r.n_docs, r.df) for r in tfidf.online(docs, stop, spark.createDataFrame([("even", 10)], "word string, known long"), part_bytes=150).collect()}
    df, want = {"even": 10}, {}
    for at, (i, t) in enumerate(rows[:60], 1):
        kept = [w for w in t.split() if w != "a"]
        for w in set(kept):
            df[w] = df.get(w, 0) + 1
            want[i, w] = (kept.count(w), len(kept), at, df[w])
    assert got == want
    found = plan(catalogue.tfidf_online(spark, sf))
    assert not re.search(r"hashpartitioning\(doc_id#\w+, word|hashpartitioning\(word#\w+, doc_id|hashpartitioning\(_range#\w+, word", found)


def test_two_hops_are_dealt_by_the_pairs_they_make(spark):
    links = spark.createDataFrame([(i % 13, i % 29) for i in range(400)] + [(i, 999) for i in range(40)], "src long, dst long")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    rows = {(r.src, r.dst) for r in links.collect()}
    want = {s: len({x for x, m in rows for y, k in rows if y == s and k == m}) for s, _ in rows}
    few = graph.two_hop(links, back, pairs_per_task=100)
    assert {r.src: r.n for r in few.collect()} == want == {r.src: r.n for r in graph.two_hop(links, back).collect()}
    numbers = [int(x) for x in re.findall(r"hashpartitioning\(src#\w+, dst#\w+, (\d+)\)", plan(few))]
    assert numbers and max(numbers) > 40


def test_stored_lists_are_read_back_by_one_sum(spark, sf, tmp_path):
    far = [-(2**62) - 5, -7, 0, 2**62 + 9]
    rows = spark.createDataFrame([("far", x) for x in far * 2] + [("bare", None), ("both", None), ("both", 4)], "word string, doc_id long").repartition(3)
    want = {("far", x) for x in far} | {("both", 4)}
    for n, most in (("a", None), ("b", 10)):
        path = str(tmp_path / n)
        postings.build(rows, path, most, buckets=2, per_list=2 if n == "a" else 1_000_000)
        found = postings.ids(postings.blocks(spark, path))
        assert sorted(map(tuple, found.collect())) == sorted(want)
        assert "aggregate(" not in plan(found)
        assert [tuple(r) for r in postings.blocks(spark, path).where("word = 'bare'").select("block", "first", "last", "steps").collect()] == [(0, None, None, [])]
        assert sorted(os.listdir(tmp_path))[-1] == n
    assert "aggregate(" not in plan(catalogue.index_blocks(spark, sf))


def test_words_of_documents_without_an_id_have_a_row(spark, tmp_path):
    texts = [(1, "a b"), (None, "b c"), (3, None), (4, ""), (5, "b")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "some/documents.parquet"))
    assert sorted(map(tuple, catalogue.index_blocks(spark, str(tmp_path / "some")).collect())) == [("a", 1, 1, 1), ("b", 2, 1, 5), ("c", 0, None, None)]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert catalogue.index_blocks(spark, str(tmp_path / "none")).count() == 0


def test_index_of_more_documents_than_a_range(spark, sf, monkeypatch):
    want = sorted(map(tuple, catalogue.index_blocks(spark, sf).collect()))
    monkeypatch.setattr(postings, "PER_LIST", 30)
    monkeypatch.setattr(postings, "IDS_PER_TASK", 300)
    assert sorted(map(tuple, catalogue.index_blocks(spark, sf).collect())) == want


@pytest.mark.parametrize("held,block", [(1, 4), (50, 4), (50, 1024), (10**6, 7)])
def test_pieces_are_merged_a_bounded_number_at_a_time(monkeypatch, held, block):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(postings, "HELD_ROWS", held)
    monkeypatch.setattr(postings, "BLOCK", block)
    ids = np.sort(rng.integers(-300, 300, 2000))
    pairs = [(w, int(i)) for i in ids for w in {f"w{int(x)}" for x in rng.geometric(0.3, 2)}] + [("bare", None), ("w1", None)]
    rng.shuffle(pairs)
    pairs = [(w, None if i is None else int(i)) for w, i in pairs]
    kinds = pa.schema([("word", pa.string()), ("_range", pa.int32()), ("doc_id", pa.int64())])
    rows = pa.Table.from_pylist([{"word": w, "_range": -1 if i is None else (i + 300) // 40, "doc_id": i} for w, i in pairs], kinds)
    pieces = pa.Table.from_batches(postings._pieces(iter(rows.to_batches(37))))
    assert max(len(x) for x in pieces.column("steps").to_pylist()) <= block
    real, seen = postings._packed, []
    monkeypatch.setattr(postings, "_packed", lambda rows, *rest: seen.append(sum(map(len, rows.column("steps").to_pylist()))) or real(rows, *rest))
    batches = pieces.sort_by([("word", "ascending"), ("_range", "ascending")]).to_batches(5)
    found = pa.Table.from_batches(postings._merged(iter(batches)))
    if held == 50:
        assert max(seen) < 50 + 5 * min(block, 40) + 2000 // 8  # a batch, and a range of a word with its repeats
    ids, lengths = postings._decoded(found)
    words = found.column("word").to_pylist()
    assert sorted(zip(np.repeat(words, lengths).tolist(), ids.tolist())) == sorted({p for p in pairs if p[1] is not None})
    for w in set(words):
        at = [i for i, x in enumerate(words) if x == w]
        assert sorted(found.column("block").to_pylist()[i] for i in at) == list(range(len(at)))
        assert sorted(lengths[at])[1:] == [block] * (len(at) - 1)
    assert [found.column("first").to_pylist()[i] for i, x in enumerate(words) if x == "bare"] == [None]
