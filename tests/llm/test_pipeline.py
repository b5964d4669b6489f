import corpus_pipeline
import pytest

from quern.llm import decontaminate, near_dup, toxicity
from quern.llm.common import table, written

from . import cases
from .test_near_dup import brute


def test_stages_keep_the_columns(spark, sf):
    docs = cases.documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf), "stage")
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def test_stages_take_no_rows(spark, sf):
    docs = cases.documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.fixture(scope="module")
def through(spark, sf):
    """What each stage got and gave."""
    docs, seen = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), name)
        seen.append((docs, out))
        docs = out
    return seen


def test_toxic_documents_go(spark, sf, through):
    docs, out = through[0]
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf, "labels"))
    assert cases.ids(out) == sorted(r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5)


def test_one_of_each_group_stays(spark, through):
    docs, out = through[1]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert cases.ids(out) == sorted(i for i, _, c in brute(rows, 5, 80) if i == c)
    assert near_dup.Settings().words == 5


def test_leaks_go(spark, sf, through):
    docs, out = through[2]
    gone = set(cases.ids(docs)) - set(cases.ids(out))
    assert gone == {r.doc_id for r in decontaminate.find_leaks(docs, table(spark, sf, "benchmark")).collect()}


def test_personal_data_goes(through):
    docs, out = through[3]
    from quern.llm import pii

    assert cases.ids(docs) == cases.ids(out)
    left = pii.digest_columns(pii.detect(out)).selectExpr("sum(n_email + n_ip + n_card + n_phone) as n").first().n
    assert left == 0
    assert out.where("n_chars <> length(text)").isEmpty()


def test_the_mix_is_of_what_is_left(through):
    docs, out = through[4]
    words = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    total = sum(len(r.text.split()) for r in out.collect())
    assert abs(total / sum(words.values()) - 1) < 0.03
    assert {i for r in out.collect() for i in r.doc_ids} <= set(words)


def test_the_package_stands_without_these_operators():
    import pathlib
    import re

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for p in (root / "quern").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import)\s+[\w.]*\bllm\b", p.read_text()), p
