"""Every registered query over the small tables: against its SQL, or against a plain computation."""

import collections

import pytest

from quern.llm import oracle, queries, token_scan, winnow

from ..oracle import connect, rows_of_spark, rows_of_sql
from . import cases


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(name, spark, sf):
    assert rows_of_spark(queries.queries()[name](spark, sf)) == rows_of_sql(connect(sf), oracle.oracle_sql()[name])


def test_token_counts(spark, sf, docs):
    tiktoken = pytest.importorskip("tiktoken")
    coder = tiktoken.Encoding("t", pat_str=token_scan.PATTERN, mergeable_ranks=token_scan.vocabulary(), special_tokens={})
    got = {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, sf).collect()}
    assert got == {i: len(coder.encode_ordinary(t or "")) for i, t, _ in docs}


def test_leaks_hold_all_verbatim_copies(spark, sf, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    squeeze = lambda t: " ".join((t or "").split())
    copies = {(d, i) for d, t, _ in docs for i, b in items.items() if len(squeeze(b).split()) >= 13 and squeeze(b) in squeeze(t)}
    got = {(r.doc_id, r.item_id) for r in queries.op3_benchmark_decontamination(spark, sf).collect()}
    assert copies and copies <= got


def test_fingerprints(spark, sf, docs):
    from .test_winnow import fingerprint

    got = {r.doc_id: r.fingerprint for r in queries.op6_document_fingerprints(spark, sf).collect()}
    for i, t, _ in docs[:60]:
        assert got[i] == ",".join(f"{h % 2**64:x}@{p}" for h, p in fingerprint(t))
    assert len(got) == len(docs) and winnow.PIECE > winnow.K


def test_mix(spark, sf, docs):
    from .test_mixing import brute

    sizes, targets = brute([(s, len((t or "").encode().split())) for _, t, s in docs], 64)
    got = queries.op8_mixing_sources(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in docs) and all(r.taken <= 3 * r.size for r in got)
    source = {i: s for i, _, s in docs}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(targets[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - t) <= 64 * 3 for s, t in targets.items())


def test_all_thirteen_and_the_pipeline_are_registered():
    names = queries.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n != "pipeline"} == set(range(1, 14))
    assert cases.ALL_IDS
