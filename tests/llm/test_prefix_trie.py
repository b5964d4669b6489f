"""The trie against one that is built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F
from quern.llm import prefix_trie

FIELDS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: y[:2])] for c, x in conv.items()}
    members, text, kids = defaultdict(list), {}, defaultdict(set)
    whole = {}
    for c in turns:
        h, b = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(b, [])[:h] + turns[c][h:])
        for d in range(len(whole[c]) + 1):
            node = whole[c][:d]
            members[node].append(c)
            text[node] = node[-1][1] if node else ""
            if d:
                kids[node[:-1]].add(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=lambda n: -len(n)):
        below = kids[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = (len(members[node]) - 1) * len(text[node]) + sum(saved[x] for x in below)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(whole[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(spark, rows, task_nodes):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS conv", "'x' AS part", "3 AS n", "4 AS depth", "5 AS comp")
    conv = F.col("conv")
    got = prefix_trie.report(df, conv - conv % 100, F.crc32(conv.cast("string")) % 6, 5, task_nodes)
    return sorted(tuple(r[f] for f in FIELDS) for r in got.collect())


def family(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 12), *range(100, 130), *range(250, 260), -7, -100, -150]:
        for t in range(rng.choice([1, 2, 3, 7, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "é𝒳", "long " * 3])))
    rows += [(400 + i, t, "user", f"common {t}") for i in range(20) for t in range(8)]  # copies
    rows += [(777, t, "user", f"step {t}") for t in range(120)]  # a deep one
    rows += [(None, 1, "user", "lost"), (500, None, None, None), (500, 3, "user", None), (501, 1, "user", "x"), (501, 1, "user", "x")]
    rng.shuffle(rows)
    return rows


def test_recursion_down_to_few_nodes(spark, monkeypatch):
    """Components of at most 6 nodes are left to tasks; ranges of 40 rows cut conversations."""
    monkeypatch.setattr(prefix_trie, "ROWS_PER_RANGE", 40)
    rows = family(1)
    want = brute(rows)
    assert found(spark, rows, 6) == want and max(r[1] for r in want) > 100


def test_in_one_task(spark):
    rows = family(2)
    assert found(spark, rows, 20_000) == brute(rows)


def test_no_turns_left_and_no_rows(spark):
    # 301 has one turn and takes none of its own when it leads with more; its base doesn't exist.
    rows = [(c, 0, "user", "hi") for c in (301, 302, 303, 304)]
    want = brute(rows)
    assert found(spark, rows, 1) == want and want[0][1] == 0
    assert found(spark, [], 10) == []


def test_long_texts_and_batches(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STREAM_ROWS", 3)
    rows = [(c, t, "user", "word " * 20_000 if t else f"{c % 2}") for c in range(600, 606) for t in range(7)]
    assert found(spark, rows, 8) == brute(rows)
