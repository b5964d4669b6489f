from pyspark.sql import functions as F

from quern.llm import oracle, queries, url_filter

from ..oracle import connect, rows_of_spark, rows_of_sql

URLS = [
    (1, "http://a.example.com/en/x?q#f"), (2, "https://WWW.Example.COM/en/y"), (3, "http://example.com"), (4, None), (5, "no scheme"), (6, ""),
    (7, "http://b.net/es/1"), (8, "http://net/fr/"), (9, "http://b.net/esx"), (10, "http://notexample.com/en/"), (11, "x://h.org#f/en/"), (12, "a://b://c.net/fr/"), (13, "http://dom\n.net/es/"),
    (14, "http://bad.org/1"), (14, "http://bad.org/1"), (15, "http://bad.org/2"), (16, "http://good.org/1"), (None, "http://good.org/2"),
]


def rule(host, path):
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name)) if fit else None


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    cut = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").select("*", F.lit("x").alias("domain"), F.lit(1).alias("n"), F.lit(2).alias("bad"))
    outcomes = spark.createDataFrame([("http://bad.org/%d" % i, 1) for i in range(60)] + [("http://good.org/%d" % i, 0) for i in range(200)] + [(None, None)], "url string, bad int")
    got = url_filter.filter_urls(pages, outcomes).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r.host, r.path) == parts(r.url)
        want = rule(r.host, r.path)
        assert r.rule == (want.name if want else None)
        assert r.verdict == (want.verdict if want else "block" if r.host == "bad.org" else "allow")


def test_posterior_shrinks_to_the_level_above(spark):
    rows = [("big.a.org", i < 50) for i in range(100)] + [("one.a.org", True)] + [("x.b.org", False)] * 300
    rep = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame([(h, int(b)) for h, b in rows], "host string, bad int")).collect()}
    assert abs(rep["big.a.org"].posterior - 0.5) < 0.03
    assert rep["one.a.org"].posterior < 0.75 and rep["one.a.org"].lower < rep["big.a.org"].lower
    assert rep["x.b.org"].upper < 0.1


def test_hosts_without_labels_get_the_prior_of_their_level(spark):
    outcomes = [(f"http://h{h}.bad.org/{i}", int(i > 1)) for h in range(20) for i in range(40)] + [(f"http://h{h}.good.org/{i}", 0) for h in range(20) for i in range(40)]
    outcomes += [(f"http://h{h}.d{d}.evil/{i}", 1) for h in range(2) for d in range(4) for i in range(40)]
    pages = [(1, "http://new.bad.org/"), (2, "http://new.good.org/"), (3, "http://new.new.evil/"), (4, "http://new.new.org/"), (5, "http://h1.bad.org/x")]
    df = spark.createDataFrame(outcomes, "url string, bad int")
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), df).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 5)] == ["block", "allow", "block", "block"]
    assert got[2].lower < got[4].lower < got[1].lower


def test_columns_with_the_names_of_results_and_a_very_long_url(spark):
    rows = [(1, "http://a.org/" + "x" * 2_000_000, 5), (2, "http://b.net/es/", 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, n long").select("*", *[F.lit("old").alias(c) for c in ("lower", "HOST", "path", "rule", "verdict", "_salt", "__pages_", "suffix")])
    outcomes = spark.createDataFrame([("http://a.org/", 0)] * 9, "url string, bad int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, outcomes).collect()}
    assert (got[1].host, len(got[1].path), got[1].verdict, got[1]._salt, got[1].n) == ("a.org", 2_000_001, "allow", "old", 5)
    assert (got[2].rule, got[2].verdict, got[2].lower, got[2].suffix) == ("net/es/", "block", None, "old")


def test_registered_domains(spark):
    hosts = [("a.b.co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("x.y.example.org", "example.org"), ("localhost", "localhost"), ("", "")]
    got = spark.createDataFrame(hosts, "host string, d string").select("d", url_filter.domain_of(F.col("host")).alias("x")).collect()
    assert all(r.d == r.x for r in got)


def test_sql_judges_hosts_without_labels_too(spark, sf, tmp_path):
    """Over tables of which some hosts have no labelled page."""
    for t in ("pages", "labels"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        (df.where("doc_id % 7 = 0") if t == "labels" else df.withColumn("url", F.when(F.col("page_id") % 5 == 1, F.concat(F.lit("http://h"), "page_id", F.lit(".new.org/"))).otherwise(F.col("url")))).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    con = __import__("duckdb").connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert rows_of_spark(queries.op5_url_filters(spark, str(tmp_path))) == rows_of_sql(con, oracle.OP5)


def test_no_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    outcomes = spark.createDataFrame([], "url string, bad int")
    assert url_filter.filter_urls(none, outcomes).count() == 0
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(pages, outcomes).collect()] == ["allow"]


def test_query_equals_sql(spark, sf):
    assert rows_of_spark(queries.op5_url_filters(spark, sf)) == rows_of_sql(connect(sf), oracle.OP5)
