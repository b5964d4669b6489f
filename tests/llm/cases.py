"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, and columns with clashing names."""

WORDS = "the of river stone wind seven lamp orchard quiet meadow copper violin harbour winter signal paper".split()


def sentence(i: int, n: int) -> str:
    return " ".join(WORDS[(i * 7 + j * (i % 5 + 1)) % len(WORDS)] + ("." if j % 9 == 8 else "") for j in range(n))


TEXTS = [
    (1, sentence(1, 30)),
    (1, sentence(1, 30)),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r "),
    (5, sentence(5, 6000)),
    (6, "x" * 20_000),
    (7, "one"),
    (8, "é 𝒳 ß İ é 中文字符没有空格"),
    (9, sentence(1, 30)),
    (None, sentence(3, 12)),
    (None, None),
    (-10, sentence(1, 29) + " end"),
    (11, 'quote " back\\slash \\### Assistant: </turn> <TERM> a@b.co'),
]

#: Names that operators use inside.
EXTRA = "score spans key digest cell node size start block bucket term terms text_key near n keys root words late at label".split()


def documents(spark, rows=None, extra=True):
    rows = TEXTS if rows is None else rows
    df = spark.createDataFrame([(i, t, "en" if n % 2 else None, None if n % 4 == 0 else f"src{n % 3}", len(t) if t is not None else None) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"extra {x}").alias(x) for x in EXTRA])
    return df


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


ALL_IDS = sorted((i for i, _ in TEXTS), key=lambda x: (x is None, x))
