import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import token_scan
from quern.llm.common import new_path, written

from . import cases

needs_vocabulary = pytest.mark.skipif(not os.path.exists(token_scan.VOCABULARY), reason="no public vocabulary file")


@needs_vocabulary
def test_counts_equal_encoding(spark):
    import tiktoken

    ranks = token_scan.vocabulary()
    folder = new_path(spark, "tokens")
    order = written(token_scan.write_token_files(cases.documents(spark), folder, ranks), "order")
    got = order.join(token_scan.scan(token_scan.token_files(spark, folder), len(ranks), block_tokens=1000), ["file", "seq"]).select("doc_id", "n_tokens").collect()
    coder = tiktoken.Encoding("t", pat_str=token_scan.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = [(i, len(coder.encode_ordinary(t or ""))) for i, t in cases.TEXTS]
    order_ = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=order_) == sorted(expected, key=order_)


@needs_vocabulary
def test_no_documents(spark):
    folder = new_path(spark, "tokens")
    order = written(token_scan.write_token_files(cases.documents(spark, []), folder, token_scan.vocabulary()), "order")
    assert order.count() == 0
    assert token_scan.scan(token_scan.token_files(spark, folder), 7).count() == 0


@pytest.mark.parametrize(("block", "stretch", "width"), [(4, 3, 2), (1, 2, 4), (1000, 1024, 2)])
def test_scan_equals_search_in_whole_files(spark, tmp_path, block, stretch, width):
    rng = np.random.default_rng(block)
    expected = []
    for k in range(4):
        a = rng.integers(0, 9 if k else 2, rng.integers(1, 300)).astype(f"<u{width}")
        a[0] = 7 if k == 2 else a[0]
        a.tofile(tmp_path / f"{k}.tok")
        ends = np.flatnonzero(a == 7)
        starts = np.r_[0, ends + 1]
        for i, (s, e) in enumerate(zip(starts, np.r_[ends, len(a)], strict=True)):
            if i < len(ends) or e > s:
                expected.append((f"{k}.tok", i, int(s), int(e - s), i < len(ends)))
    (tmp_path / "empty.tok").write_bytes(b"")
    found = token_scan.scan(token_scan.token_files(spark, f"file://{tmp_path}"), 7, width, block, stretch).collect()
    assert sorted((os.path.basename(r.file), r.seq, r.start, r.n_tokens, r.ended) for r in found) == sorted(expected)


def test_half_a_token_is_an_error(spark, tmp_path):
    (tmp_path / "odd.tok").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number of tokens"):
        token_scan.scan(token_scan.token_files(spark, str(tmp_path)), 7).collect()


def test_blocks_are_read_in_many_tasks(spark, tmp_path):
    np.zeros(100_000, "<u2").tofile(tmp_path / "a.tok")
    found = token_scan._searched(token_scan.token_files(spark, f"file://{tmp_path}"), 7, 1000, 4096)
    assert found.rdd.getNumPartitions() == -(-200_000 // 4096) and found.select(F.spark_partition_id()).distinct().count() > 20


def test_wide_tokens_are_known_by_their_file(spark, tmp_path):
    np.array([70_000, 7, 7 << 16, 7], "<u4").tofile(tmp_path / "a.32.tok")
    found = token_scan.scan(token_scan.token_files(spark, f"file://{tmp_path}"), 7).orderBy("seq").collect()
    assert [(r.start, r.n_tokens) for r in found] == [(0, 1), (2, 1)]
