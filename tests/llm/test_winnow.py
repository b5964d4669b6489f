import hashlib
import re
import struct

import xxhash
from pyspark.sql import functions as F

from quern.llm import winnow

from . import cases


def signed(x):
    return struct.unpack("<q", struct.pack("<Q", x))[0]


def hash_longs(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def fingerprint(text, k=winnow.K, w=winnow.W):
    """Window by window, as defined."""
    units = []
    for run in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()):
        unit = ""
        for c in run:
            alone = any(low <= ord(c) <= high for low, high in ((0xE00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)))
            if alone and unit:
                units.append(unit)
                unit = ""
            unit += c
            if alone or c in "jkqvxz7":
                units.append(unit)
                unit = ""
        if unit:
            units.append(unit)
    h = [signed(xxhash.xxh64_intdigest(u.encode(), 42)) for u in units]
    grams = [hash_longs(h[i : i + k]) for i in range(len(h) - k + 1)] or ([hash_longs(h)] if h else [])
    out = []
    for i in range(max(1, len(grams) - w + 1) if grams else 0):
        window = range(i, min(i + w, len(grams)))
        low = min(grams[j] >> 28 for j in window)
        at = max(j for j in window if grams[j] >> 28 == low)
        if (grams[at], at) not in out:
            out.append((grams[at], at))
    return out


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_the_definition(spark):
    texts = [(i, t) for i, (_, t) in enumerate(cases.TEXTS) if "İ" not in (t or "")]  # Java and Python lower this letter differently
    texts += [(100 + i, cases.sentence(i, i)) for i in range(40)]
    rng = __import__("random").Random(2)
    texts += [(200 + i, "".join(rng.choice("abkz7 天地人\U00020001\u0e01é.") for _ in range(5 * i))) for i in range(40)]
    got = spark.createDataFrame(texts, "i long, text string").select("i", winnow.fingerprint(F.col("text")).alias("p")).collect()
    for r in got:
        assert [(x.hash, x.position) for x in r.p] == fingerprint(dict(texts)[r.i])


def test_shared_passages_leave_a_shared_hash(spark):
    passage = cases.sentence(3, winnow.K + winnow.W - 1)
    docs = spark.createDataFrame([(f"{cases.sentence(i, 20 + i)} {passage} {cases.sentence(i + 3, 15)}",) for i in range(30)], "t string")
    sets = [set(r.h) for r in docs.select(winnow.hashes_of(winnow.fingerprint(F.col("t"))).alias("h")).collect()]
    assert all(a & b for a in sets for b in sets)


def test_passages_in_texts_without_spaces_are_found_at_any_offset(spark):
    rng = __import__("random").Random(6)
    letters = [chr(0x4E00 + i) for i in range(2000)]
    passage = "".join(rng.choice(letters) for _ in range(40))
    texts = ["".join(rng.choice(letters) for _ in range(30 + i)) + passage + "".join(rng.choice(letters) for _ in range(20)) for i in range(8)]
    sets = [set(r.h) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(winnow.hashes_of(winnow.fingerprint(F.col("t"))).alias("h")).collect()]
    least = (len(passage) - winnow.K + 1) // winnow.W
    assert all(len(a & b) >= least for a in sets for b in sets)


def test_it_does_not_matter_where_a_passage_is_wrapped(spark):
    rng = __import__("random").Random(8)
    for letters in ([chr(0x4E00 + i) for i in range(2000)], list("abcdefghijklmnopqrstuvwxyz0123456789"), list("0123456789abcdef"), list("0123456789")):
        passage = "".join(rng.choice(letters) for _ in range(3000))
        wrapped = [passage] + ["\n".join(passage[i : i + n] for i in range(0, len(passage), n)) for n in (24, 25, 40, 1000)]
        sets = [set(r.h) for r in spark.createDataFrame([(t,) for t in wrapped], "t string").select(winnow.hashes_of(winnow.fingerprint(F.col("t"))).alias("h")).collect()]
        if ord(letters[0]) > 0x4E00 - 1:
            assert all(x == sets[0] for x in sets)
        assert len(sets[0] & sets[-1]) > 0.7 * len(sets[0]), letters[0]


def test_ids_far_apart(spark):
    rows = [(-(2**62) - 5, "a b c"), (2**62 + 7, "d e f"), (2**63 - 1, "g h i"), (-(2**63), "j k l")]
    got = {r.doc_id: r.edited_sha256 for r in winnow.edited(cases.documents(spark, rows)).collect()}
    assert got == {i: hashlib.sha256(changed.encode()).hexdigest() for i, _, changed, _ in edits(rows)}


def edits(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: -x[0])
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        cut = len(t) // 3
        yield i, t, t[: len(t) - cut] + following[:cut], following


def test_edited_texts_and_next_documents(spark):
    rows = [(i * i, t) for i, (_, t) in enumerate(cases.TEXTS)] + [(-500 - i, cases.sentence(i, 40)) for i in range(50)]
    got = {r.doc_id: r for r in winnow.edited(cases.documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text, changed, following in edits(rows):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        if "İ" not in text + changed + following:
            assert r.near_edited == likeness(fingerprint(text), fingerprint(changed))
            assert r.near_next == likeness(fingerprint(text), fingerprint(following))


def test_one_document_follows_itself(spark):
    (r,) = winnow.edited(cases.documents(spark, [(7, "abc def ghi")])).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest()


def test_rows_of_every_kind(spark):
    assert cases.ids(winnow.edited(cases.documents(spark))) == cases.ALL_IDS
    assert winnow.edited(cases.documents(spark, [])).count() == 0
    assert cases.ids(winnow.edited(cases.documents(spark, [(None, "a"), (None, None)]))) == [None, None]
