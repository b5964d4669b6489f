import base64
import gzip
import hashlib
import random
import re

from pyspark.sql import functions as F

from quern.llm import chat_format as C
from quern.llm import queries, warc
from quern.llm.common import new_path, written

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["\\", "\\e", "\\h", "\\c", "</turn>", "</turn>\n", "### ", "###", ": ", "\n", "word", "<", "é𝒳", "\\\\", "assistant"]


def chats():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd: role", "### x", None, ""]), rng.choice([None, "", "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9)))])) for c in range(150) for t in range(rng.randint(1, 5))]
    return rows + [(3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, None, "assistant", "x"), (900, 1, "assistant", "long " * 20_000)]


def test_round_trip_of_everything(spark):
    rows = chats()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("clash")).withColumn("source", F.lit(1))
    got = {r.conv_id: r for r in C.format_chat(df).collect()}
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort()
        r = got[c]
        assert r.round_trip
        assert [(x.role, x.text) for x in r.turns] == [x[2:] for x in turns]
        bodies = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert len(bodies) == sum(x[2] == "assistant" for x in turns)
        assert bodies == [x.body for x in r.turns if x.role == "assistant"]


def test_texts_hold_no_control_string(spark):
    df = spark.createDataFrame([(1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "fine")], SCHEMA)
    r = C.format_chat(df).first()
    assert r.formatted.count("</turn>") == 2 and r.formatted.count("### ") == 2 and r.n_escaped == 1


def test_no_conversations(spark):
    assert C.format_chat(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_reads_back_the_source(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, i, r, r"\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]
    groups = {}
    for c, t, role, text in sorted(rows):
        groups.setdefault(c, []).append((role, text))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = {}
    for c, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        expected[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op9_chat_formatting(spark, sf).collect()}
    assert got == expected


PAGES = [(5, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (None, "n", "alone"), (None, "n", "same"), (7, "é", "日本 " * 30_000), (5, "http://a/", "same"), (8, "v", "other")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def archive(spark, rows=PAGES, least=0):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(1)).withColumn("file", F.lit("x"))
    return written(warc.write(warc.dedup_records(pages, least), new_path(spark, "warc")), "index")


def key(x):
    return tuple((y is not None, y) for y in x)


def test_records_come_back(spark):
    index = archive(spark)
    got = warc.read(index.select("file", "offset", "length")).collect()
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[digest(html)] = min(i, first.get(digest(html), i))
    expected = []
    for i, _, html in PAGES:
        lead = first.get(digest(html))
        revisit = lead is not None and i != lead
        expected.append((i, len((html or "").encode()), digest(html), "revisit" if revisit else "response", lead if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(expected, key=key)
    text = {i: (h or "").encode() for i, _, h in PAGES}
    assert all(bytes(r.payload) == text[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)


def test_only_selected_records_are_read(spark):
    index = archive(spark)
    got = warc.read(index.where("page_id in (7, 8)").select("file", "offset", "length"), gap=0, most=64).collect()
    assert sorted(r.page_id for r in got) == [7, 8]


def test_short_payloads_can_stay_apart(spark):
    index = archive(spark, least=5)
    assert index.where("record_type = 'revisit'").isEmpty()


def test_records_are_whole_by_the_standard(spark):
    index = archive(spark)
    ids = set()
    for r in index.collect():
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            head, block = gzip.decompress(f.read(r.length)).split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and fields["Content-Type"] == "application/http;msgtype=response"
        assert len(block) == int(fields["Content-Length"]) + 4 and block.startswith(b"HTTP/1.1 200 OK\r\n")
        ids.add(fields["WARC-Record-ID"])
    assert len(ids) == len(PAGES)


def test_ranges_are_read_in_many_tasks(spark):
    index = archive(spark, [(i, "u", f"page {i} " * 50) for i in range(300)])
    found = warc.read(index.select("file", "offset", "length"), gap=0, most=256, task_bytes=1024)
    assert found.rdd.getNumPartitions() > 20 and found.select("page_id", F.spark_partition_id().alias("p")).distinct().agg(F.count_distinct("p")).first()[0] > 20


def test_a_payload_of_very_many_pages(spark):
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("same").alias("html"))
    got = warc.dedup_records(pages).groupBy("record_type", "refers_to").count().collect()
    assert {(r.record_type, r.refers_to, r["count"]) for r in got} == {("response", None, 1), ("revisit", 0, 4999)}


def test_ranges_are_joined(spark):
    rows = [("f", 0, 10), ("f", 10, 5), ("f", 100, 5), ("f", 5000, 7), ("g", 3, 4)]
    got = warc.coalesce_ranges(spark.createDataFrame(rows, "file string, offset long, length long"), gap=90, most=4096).collect()
    assert sorted((r.file, r.start, r.end, len(r.members)) for r in got) == [("f", 0, 105, 3), ("f", 5000, 5007, 1), ("g", 3, 7, 1)]


def test_no_pages(spark):
    index = archive(spark, [])
    assert index.count() == 0
    assert warc.read(index.select("file", "offset", "length")).count() == 0


def test_a_payload_on_a_third_of_all_pages_stays_spread(spark):
    """No partition of the deduplicated records holds much more than its share, however many pages one payload is on."""
    from pyspark.sql import functions as F

    pages = spark.range(0, 30_000, 1, 16).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 9000).cast("string"))).alias("html"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        records = warc.dedup_records(pages)
        sizes = [r["count"] for r in records.groupBy(F.spark_partition_id()).count().collect()]
        # The pages of the hot payload stay in their 16 tasks; no task has more than one read.
        assert max(sizes) <= 30_000 / 16 and len(sizes) >= 32
        assert records.where("record_type = 'response'").count() == 1 + 6000
        assert records.where("payload = binary('hot') and record_type = 'revisit' and refers_to = 0").count() == 9_999
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
