"""Crawl rounds, node groups and streams."""

from pyspark.sql import functions as F
from quern.operators import graph, groups
from quern.sources import stores
from quern.streaming import streams

EDGES = [("A", "B"), ("A", "C"), ("B", "A"), ("B", "D"), ("C", "D"), ("D", "E")]


def test_crawl_rounds(spark):
    links = spark.createDataFrame(EDGES, "src string, dst string")
    seeds = spark.createDataFrame([("A",)], "title string")
    for rounds, fetched, titles in ((1, "A", "BC"), (2, "ABC", "ABCD"), (3, "ABCD", "ABCDE"), (9, "ABCDE", "ABCDE")):
        c = graph.crawl(seeds, links, rounds)
        assert sorted(r.title for r in c.fetched.collect()) == list(fetched)
        assert sorted({r.title for r in c.extracted.collect()}) == list(titles)
    stats = graph.crawl_stats(c).first()
    assert (stats.n_fetched, stats.n_pages, stats.rounds) == (5, 5, 4)
    figures = graph.throughput(c).collect()
    assert [r["round"] for r in figures] == [1, 2, 3, 4] and sum(r.fetched for r in figures) == 5 and all(r.seconds > 0 and r.per_second == r.extracted / r.seconds for r in figures)


def test_odd_titles_are_not_crawled(spark):
    links = spark.createDataFrame([("A", "C++"), ("A", "B")], "src string, dst string")
    c = graph.crawl(spark.createDataFrame([("A",), ("X!",)], "title string"), links, 3)
    assert sorted(r.title for r in c.fetched.collect()) == ["A", "B"]


def test_prune_sizes(spark):
    assert [graph.kept_of(n, 0.001, 500) for n in (1000, 600_000, 20)] == [500, 600, 20]
    titles = spark.range(30).selectExpr("cast(id as string) as title")
    assert graph.prune(titles, 0.1, 5).count() == 5
    assert graph.prune(titles, 0.1, 5, seed=1).count() == 5


def test_two_hop_sketch(spark):
    """Within a few per cent of the exact number, on a graph with one middle that links to most."""
    rows = spark.range(3000).select((F.col("id") % 60).alias("src"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 200).alias("dst"))
    right = spark.range(6000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 200).alias("src"), F.col("id").alias("dst"))
    exact = {r.src: r.n for r in graph.two_hop(rows, right).collect()}
    about = {r.src: r.n for r in graph.two_hop_sketch(rows, right).collect()}
    assert set(exact) == set(about) and max(abs(about[k] - n) / n for k, n in exact.items()) < 0.06


def test_a_filter_lets_no_visited_title_through(spark):
    visited = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("title"))
    titles = spark.range(4000, 9000).select(F.concat(F.lit("t"), "id").alias("title"))
    want = {f"t{i}" for i in range(5000, 9000)}
    for few in (0, 10_000):
        assert {r.title for r in graph.unseen_filtered(titles, visited, 5000, few).collect()} == want
    maps, n = graph.bloom_filter(visited, "title", 5000)
    maybe = titles.join(F.broadcast(maps)).where(graph.maybe_in(F.col("title"), F.col("maps"), n)).count()
    assert 1000 <= maybe <= 1000 + 0.05 * 4000  # all repeats, few others
    assert graph.bloom_filter(visited, "title", 10**9) is None
    assert graph.unseen_filtered(titles, visited, 10**9).count() == 4000 == graph.unseen_filtered(titles, visited.limit(0), 0).count() - 1000


def test_postings_in_blocks(spark, tmp_path):
    from quern.operators import postings

    rows = spark.range(5000).select(F.lit("often").alias("word"), (F.col("id") * F.col("id")).alias("doc_id")).union(spark.createDataFrame([("once", 7), ("twice", -3), ("twice", 9), ("twice", 9)], "word string, doc_id long"))
    for n, most in (("a", None), ("b", 10_000)):
        path = str(tmp_path / n)
        postings.build(rows, path, most, buckets=4, per_list=2048 if n == "a" else 1_000_000)
        assert sorted(r.doc_id for r in postings.lookup(spark, path, "often", 4).collect()) == [i * i for i in range(5000)]
        assert sorted(r.doc_id for r in postings.lookup(spark, path, "twice", 4).collect()) == [-3, 9] and postings.lookup(spark, path, "never", 4).count() == 0
        assert postings.blocks(spark, path).groupBy("word").count().where("word = 'often'").first()["count"] == 5
    from .test_runs_buckets import files_read

    assert files_read(postings.blocks(spark, path).where("bucket = 1")) <= 1


def test_groups(spark):
    g = spark.createDataFrame([("all", "s1", "a", 1), ("mine", "s1", "a", 1)], "gid string, sid string, ip string, port int")
    more = groups.add(g, "mine", spark.createDataFrame([("s2", "b", 2), ("s1", "a", 1)], "sid string, ip string, port int"))
    assert sorted((r.gid, r.sid) for r in more.collect()) == [("all", "s1"), ("all", "s2"), ("mine", "s1"), ("mine", "s2")]
    assert sorted(r.sid for r in groups.members(groups.remove(more, "mine", "s1"), "mine").collect()) == ["s2"]
    assert groups.remove(more, "nobody", "s1").count() == 4
    assert groups.members(groups.drop(more, "mine"), "mine").isEmpty()


def test_gathered_replies(spark):
    v = spark.createDataFrame([("g", "s1", 5, None), ("g", "s2", None, "down")], "gid string, sid string, value int, error string")
    r = groups.gather(v).first()
    assert (r.oks, r.errors) == ({"s1": 5}, {"s2": "down"})
    assert groups.sum_metric(v, "value").first().total == 5


def test_stream_upsert_over_batches(spark, tmp_path):
    for i, rows in enumerate(([("a", [1.0], 1), ("b", [2.0], 2)], [("a", [3.0], 3)])):
        spark.createDataFrame(rows, "doc_id string, embedding array<double>, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = streams.upsert_stream(streams.stream_table(spark, str(tmp_path / "in")))
    assert {r.doc_id: r.embedding for r in got.collect()} == {"a": [3.0], "b": [2.0]}


def put(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id string, embedding array<double>, seq long").coalesce(1).write.mode("append").parquet(folder)


def test_stream_upsert_goes_on_after_a_restart(spark, tmp_path):
    """Three batches in two runs with one checkpoint; a flush after each one, or never."""
    for flush_at in (1, 3000):
        source, root, checkpoint = (str(tmp_path / f"{x}{flush_at}") for x in ("in", "kept", "checkpoint"))
        put(spark, source, [("a", [1.0], 1), ("b", [2.0], 2)])
        put(spark, source, [("a", [3.0], 3)])
        streams.upsert_stream(streams.stream_table(spark, source), root, checkpoint, flush_at)
        put(spark, source, [("c", [4.0], 4), ("b", [5.0], 5)])
        got = streams.upsert_stream(streams.stream_table(spark, source), root, checkpoint, flush_at)
        assert {r.doc_id: r.embedding for r in got.collect()} == {"a": [3.0], "b": [5.0], "c": [4.0]}
        again = streams.upsert_stream(streams.stream_table(spark, source), root, checkpoint, flush_at)
        assert again.count() == 3
        assert len(stores.folder_names(spark, f"{root}/flushed")) == (1 if flush_at == 1 else 0)


def test_streams_without_a_batch(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [("a", [1.0], 1)])
    stream = streams.stream_table(spark, str(tmp_path / "in")).where("false")
    assert streams.collected(stream).count() == 0
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema("doc_id string, embedding array<double>, seq long").parquet(str(tmp_path / "none"))
    assert streams.collected(empty).count() == 0 and streams.upsert_stream(empty).count() == 0


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], stores.KEY_VALUES)
    store = stores.Store(spark, str(tmp_path / "s"), stores.KEY_VALUES).create()
    assert store.read().count() == 0
    assert store.append(rows).append(rows.where("seq = 2").withColumn("seq", rows.seq + 1)).create().read().count() == 3
    assert store.latest("key", "value").collect() == [("k", "y")]
    assert store.reset().read().count() == 0 and store.append(rows).read().count() == 2


def test_pages_and_registry(spark):
    from pyspark.sql import functions as F

    from quern.functions import registry
    from quern.sources import pages

    answers = ['{"query":{"pages":{"7":{"title":"A b","extract":"text","links":[{"ns":0,"title":"C"},{"title":"D"}]}}}}', '{"query":{"pages":{"-1":{"title":"Gone"}}}}', "no json", None]
    got = [r.p for r in spark.createDataFrame([(x,) for x in answers], "x string").select(pages.first_page(F.col("x")).alias("p")).collect()]
    assert (got[0].title, got[0].extract, got[0].links) == ("A b", "text", ["C", "D"]) and got[1].links == [] and got[2] is None and got[3] is None
    registry.put(spark, "twice", lambda s: s * 2, "long")
    assert registry.has(spark, "twice") and spark.range(3).selectExpr("twice(id) as x").agg({"x": "sum"}).first()[0] == 6


def test_stream_sees_each_key_once(spark, tmp_path):
    for _ in range(2):
        spark.createDataFrame([("x",), ("y",)], "title string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.stream_table(spark, str(tmp_path / "in"))
    assert sorted(r.title for r in streams.collected(streams.first_seen(stream, "title")).collect()) == ["x", "y"]


def test_stream_with_event_time(spark, tmp_path):
    import datetime

    spark.createDataFrame([("x", datetime.datetime(2024, 1, 1)), ("x", datetime.datetime(2024, 1, 1))], "title string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.stream_table(spark, str(tmp_path / "in"))
    assert streams.collected(streams.first_seen(stream, "title", "ts")).count() == 1
