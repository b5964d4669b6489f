import hashlib
import random
import re

from quern.llm import pii

from . import cases

HARD = [
    "a@b.c_d@e.fg x@y.z..w@q.r",
    "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111111",
    "+1 (415) 555-0100 +44.20.7946.0958x +12 3",
    "𝒳 p@q.r é@b.c",
    "a" * 3000 + "@b.c " + "1" * 5000,
    "+1+1+1 (22) 3333 44444-",
    "x@@y.z a.b@c-d.e-f.g@h.i 12 34 56 78 90 12 34 5 6",
]


def base(text):
    """The contract's patterns, one by one."""
    out = []
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    for rank, (kind, p) in enumerate(patterns):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(x - 9 * (x > 9) for x in doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(1)
    rows = [(100 + i, t) for i, t in enumerate(HARD)] + cases.TEXTS
    rows += [(1000 + i, "".join(rng.choice("ab1 .-@+(4") for _ in range(60))) for i in range(300)]
    got = {(r.doc_id, r.base_sha256) for r in pii.digest_columns(pii.detect(cases.documents(spark, rows))).collect()}
    expected = {(i, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in base(t)).encode()).hexdigest()) for i, t in rows}
    assert got == expected


def corpus():
    filler = [(i, f"plain words number {i} about nothing in particular here") for i in range(200)]
    hits = [(1000 + i, f"report {i}: write to Eve@Example.org from Zanzibar about words") for i in range(4)]
    return filler + hits


def test_revealing_terms_are_found_by_counts(spark):
    """zanzibar stands only near the address and in four documents; words stand in all."""
    rows = {r.doc_id: r for r in pii.digest_columns(pii.detect(cases.documents(spark, corpus()))).collect()}
    text = dict(corpus())[1000]
    marked = {text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in rows[1000].spans.split(",")}
    assert {"Eve@Example.org", "Zanzibar"} <= marked and "words" not in marked
    assert all(rows[i].spans == "" for i in range(200))


def test_single_sightings_and_terms_far_away_count(spark):
    """Both words stand in one text, with the only mention of an address; one is hundreds of code points away."""
    rows = corpus() + [(2000, "ask Ophelia at solo@example.org " + "about plain words in particular " * 20 + "near Samarkand"), (2001, "nothing of words")]
    docs = cases.documents(spark, rows + [(2002, rows[-2][1]), (None, rows[-2][1])])
    got = {r.doc_id: r.spans for r in pii.digest_columns(pii.detect(docs)).collect()}
    text = dict(rows)[2000]
    marked = {text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[2000].split(",")}
    assert {"Ophelia", "Samarkand"} <= marked and "words" not in marked and "particular" not in marked
    assert got[2002] == got[None] == got[2000] and got[2001] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not {"Ophelia", "Samarkand"} & set(clean[2000].split()) and clean[2002] == clean[None] == clean[2000]


def test_sanitised_texts(spark):
    docs = cases.documents(spark, corpus() + cases.TEXTS)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    assert "<EMAIL>" in got[1000] and "Zanzibar" not in got[1000] and "Eve" not in got[1000]
    assert got[5] == dict(corpus() + cases.TEXTS)[5] and got[2] is None
    assert cases.ids(clean) == cases.ids(docs)


def test_no_documents(spark):
    assert pii.digest_columns(pii.detect(cases.documents(spark, []))).count() == 0
    assert pii.sanitise(cases.documents(spark, [])).count() == 0


def test_repeated_rows_stay(spark):
    assert cases.ids(pii.detect(cases.documents(spark))) == cases.ALL_IDS


def test_terms_equal_the_counts_of_a_table(spark):
    """PMI and IC of every pair by their definitions; repeated rows count once."""
    import math

    rng = random.Random(9)
    names = [f"name{i}" for i in range(30)]
    rows = []
    for i in range(260):
        words = [rng.choice(cases.WORDS) for _ in range(rng.randint(3, 25))]
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            k = rng.randint(0, 19)
            words.insert(rng.randrange(len(words)), f"user{k}@example.org")
            words.insert(rng.randrange(len(words)), names[k] if rng.random() < 0.7 else rng.choice(names))
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[7][1]) for i in range(12)]
    texts = {t for _, t in rows}
    found = {t: (set(re.findall(r"user\d+@example\.org", t)), re.sub(r"user\d+@example\.org", lambda m: " " * len(m.group()), t)) for t in texts}
    every = {t: set(re.findall(r"[^\W_]{2,}", t)) for t in texts}
    n = len(texts)
    expected = {}
    for t, (mails, rest) in found.items():
        out = set()
        for m in re.finditer(r"[^\W_]{2,}", rest):
            c_t = sum(m.group() in w for w in every.values())
            for e in mails:
                c_e = sum(e in f for f, _ in found.values())
                both = sum(e in f and m.group() in re.findall(r"[^\W_]{2,}", r) for f, r in found.values())
                if math.log2(n * both / (c_e * c_t)) >= 0.8 * math.log2(n / c_e):
                    out.add(f"term:{m.start()}:{m.end()}")
        expected[t] = out
    got = {r.doc_id: r.spans for r in pii.digest_columns(pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert any(expected.values()) and {i: {s for s in got[i].split(",") if s.startswith("term")} for i, _ in rows} == {i: expected[t] for i, t in rows}


def test_a_long_list_of_addresses(spark):
    """Time grows with the text; every address and every name beside it goes."""
    import time

    took = []
    for n in (1500, 6000):
        text = "\n".join(f"person{i}x <mail{i}@host{i % 7}.example.org>, +1 415 555 {i:05d}" for i in range(n))
        docs = spark.createDataFrame([(1, text), (2, text + " again"), (3, "nothing here")] + [(9 + i, f"filler {i} words") for i in range(50)], "doc_id long, text string")
        began = time.time()
        clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
        took.append(time.time() - began)
        assert "@" not in clean[1] and "person" not in clean[1] and clean[1].count("<EMAIL>") == n and clean[3] == "nothing here"
    assert took[1] < 8 * took[0]
