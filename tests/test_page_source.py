"""The page source: ranges of titles, answers that can't be read, streams that go on."""

import json
import os

import pytest
from pyspark.sql import functions as F
from quern.sources import page_source
from quern.streaming import streams


def save(spark, folder, titles, files=3):
    rows = spark.createDataFrame([(t,) for t in titles], "title string")
    answer = page_source.answer_of(F.col("title"), F.concat(F.lit("text of "), "title"), F.array(F.lit("Main"), F.lower("title")))
    return page_source.save_answers(rows.select("title", answer.alias("answer")), str(folder), files)


@pytest.fixture
def pages(spark):
    spark.dataSource.register(page_source.PageSource)
    return spark.read.format("pages")


def test_reads_all_and_ranges(spark, pages, tmp_path):
    titles = [f"Title/{c}{i} é" for c in "ABCDEFGH" for i in range(5)]
    assert save(spark, tmp_path / "a", titles, 5) == 5 == len(os.listdir(tmp_path / "a"))
    rows = {r.title: r for r in pages.load(str(tmp_path / "a")).collect()}
    assert sorted(rows) == sorted(titles) and rows[titles[0]].links == ["Main", titles[0].lower()] and rows[titles[0]].extract == "text of " + titles[0]
    part = pages.option("from", "Title/C").option("to", "Title/D9").load(str(tmp_path / "a"))
    assert sorted(r.title for r in part.collect()) == [t for t in titles if "Title/C" <= t <= "Title/D9"]
    # Files outside the range are not opened: they may be broken.
    reader = page_source.PageReader({"path": str(tmp_path / "a"), "from": "Title/A0", "to": "Title/A1"})
    assert sum(len(p.names) for p in reader.partitions()) < 5


def test_bad_answers_and_files_are_rows_with_errors(pages, tmp_path):
    os.makedirs(tmp_path / "b")
    answers = [("a", None), ("b", "{"), ("c", json.dumps({"query": {"pages": {}}})), ("d", json.dumps({"query": {"pages": {"-1": {"missing": ""}}}})), ("e", "[]"), ("f", json.dumps({"query": {"pages": {"9": {"title": "F"}}}}))]
    (tmp_path / "b" / "0~a.answers").write_text("".join(json.dumps({"asked": t, "answer": a}) + "\n" for t, a in answers) + "\n")
    (tmp_path / "b" / "1~x%20y.answers").write_bytes(b"\xff\xfe not lines\n")
    (tmp_path / "b" / "2~z.answers.draft").write_text("not finished")
    got = {r.title: r.error for r in pages.load(str(tmp_path / "b")).collect()}
    assert set(got) == {"a", "b", "c", "d", "e", "F", "x y"} and got["F"] is None and got["c"] == got["d"] == "no page"
    assert all(got[t].startswith("unreadable") for t in ("a", "b", "e", "x y"))
    assert pages.load(str(tmp_path / "none")).count() == 0


def test_a_stream_takes_each_file_once(spark, pages, tmp_path):
    save(spark, tmp_path / "c", ["a", "b", "c"], 2)
    seen = []

    def run():
        stream = spark.readStream.format("pages").load(str(tmp_path / "c"))
        streams.run_to_end(stream, lambda rows, i: seen.append(sorted(r.title for r in rows.collect())), str(tmp_path / "checkpoint"))

    run()
    run()  # nothing new
    save(spark, tmp_path / "more", ["d", "e"], 1)
    for f in os.listdir(tmp_path / "more"):
        os.rename(tmp_path / "more" / f, tmp_path / "c" / f"9{f}")
        os.utime(tmp_path / "c" / f"9{f}")
    run()
    assert [x for x in seen if x] == [["a", "b", "c"], ["d", "e"]]
