"""PII: base patterns, and terms that reveal the protected values.

Base spans are e-mail addresses, IP addresses, card and phone numbers; each value
is a protected entity e.  Terms are the words of the texts that mention one,
outside the base spans.  Over the whole corpus

    IC(e)    = log2(N / c(e))                     information of the entity
    PMI(e,t) = log2(N * c(e,t) / (c(e) * c(t)))   what the term tells about it

with N distinct texts, c(e) those that mention e, c(t) those that hold t and
c(e,t) those that do both.  Every pair is scored, single sightings too.  A term
with PMI >= disclose * IC is generalised to a typed placeholder wherever it
stands in the texts that mention e, or removed from there if PMI >= remove * IC.

As c(e,t) <= min(c(e), c(t)), PMI is at most log2(N / max(c(e), c(t))); pairs
that this bound rules out aren't built.  Entities that stand in the same texts have the same counts
with every term, and so have terms that do; they are counted as one bundle, so that a list of
thousands of addresses doesn't make a pair of each one with each word.

Everything is built-in functions: Java's matches and the text between them give
positions.  The patterns are written so that no text makes them backtrack over a long
run: a match may start inside a run only where the last match ended.

Defined results
---------------
* null text: empty, no spans;
* equal texts get the same spans and count once, whatever their doc_id;
* of a word that runs into a base span, the rest is a term only if it is a word elsewhere;
* null doc_id: as any other value; texts are searched whole, whatever their length;
* an empty table gives an empty result; extra columns are kept by `sanitise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, join_counted, running, running_sum, sha256_hex, slices, written

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
#: As the contract's patterns; ``\G`` or not after a character of the same run, and without giving back.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text that doesn't have this has no match.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")) & t.rlike(r"\+[0-9][ ().0-9-]"),
}
TERM = r"[\p{L}\p{N}]{2,}+"
_SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(value))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points, end exclusive."""

    def place(matches: Column) -> Column:
        steps = lambda pieces: F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
        ends = bound(F.split(text, pattern, -1), lambda pieces: running_sum(steps(pieces)))
        return F.transform(F.arrays_zip(matches.alias("value"), ends.alias("end")), lambda x: F.struct((x["end"] - F.length(x["value"])).cast("int").alias("start"), x["end"].cast("int").alias("end"), x["value"].alias("value")))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def base_spans(text: Column) -> Column:
    """array of (start, rank, kind, end, value), by start, then kind."""
    none = F.array().cast(f"array<{_SPAN}>")

    def of(rank: int, kind: str) -> Column:
        valid = F.filter(located(text, PATTERNS[kind]), lambda s: _valid(kind, s.value))
        named = F.transform(valid, lambda s: F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s.end.alias("end"), s.value.alias("value")))
        return F.when(GATES[kind](text), named).otherwise(none)

    return F.array_sort(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)]))


def entity(span: Column) -> Column:
    value = F.when(span.kind.isin("card", "phone"), _digits(span.value)).otherwise(F.lower(span.value))
    return F.xxhash64(span.kind, value)


def _spliced(text: Column, spans: Column, by) -> Column:
    """``text`` with by(span, end of what came before) in place of each of the sorted spans; linear in the text and the spans."""

    def build(ends: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0)).cast("int")
        gaps = F.transform(spans, lambda s, i: F.struct(before(i).alias("start"), F.greatest(s.start, before(i)).alias("end")))
        tail = F.array(F.struct(F.element_at(ends, -1).cast("int").alias("start"), F.length(text).alias("end")))
        pieces = slices(text, F.concat(gaps, tail))
        return bound(pieces, lambda p: F.concat(F.array_join(F.transform(spans, lambda s, i: F.concat(F.get(p, i), by(s, before(i)))), ""), F.element_at(p, -1)))

    highest = running(F.transform(spans, lambda s: s.end), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) == 0, text).otherwise(bound(highest, build))


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with blanks in place of the spans, of the same length."""
    return _spliced(text, spans, lambda s, at: F.repeat(F.lit(" "), F.greatest(s.end - F.greatest(at, s.start), F.lit(0))))


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _words(text: Column, spans: Column) -> Column:
    """array<struct<term, start, end>>: the words outside the base spans."""
    return F.transform(located(_blanked(text, spans), TERM), lambda t: F.struct(_term(t.value).alias("term"), t.start.alias("start"), t.end.alias("end")))


_WORDS = "array<struct<term:bigint,start:int,end:int>>"


def found(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, spans (base) and words (those of texts with spans), written to the shared folder."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("spans", base_spans(F.col("text")))
    words = F.when(F.size("spans") > 0, _words(F.col("text"), F.col("spans"))).otherwise(F.array().cast(_WORDS))
    return written(docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "spans", words.alias("words")), "pii")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _holders(rows: DataFrame) -> DataFrame:
    """text_key, entities and words of each distinct text with base spans."""
    held = rows.where(F.size("spans") > 0).select("text_key", F.array_distinct(F.transform("spans", entity)).alias("entities"), "words")
    return written(held.dropDuplicates(["text_key"]), "pii-holders")


def _term_counts(documents: DataFrame) -> DataFrame:
    """term, c_t: in how many distinct texts each word stands."""
    texts = documents.select(text_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["text_key"])
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), _term))
    return written(texts.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("c_t")), "pii-terms")


def _kinds(rows: DataFrame, what: str) -> DataFrame:
    """(what, n, x1, x2): in how many texts it stands, and two numbers for which ones."""
    return rows.groupBy(what).agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("text_key", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)])


def disclosive(documents: DataFrame, rows: DataFrame, holders: DataFrame, disclose: float = 0.8, remove: float = 0.95) -> DataFrame:
    """(text_key, term, share, removed) of the terms over the threshold, for each text that has both; share is the largest PMI / IC."""
    total = F.lit(rows.select("text_key").distinct().count())
    c_t = _term_counts(documents)
    of = holders.select("text_key", F.explode("entities").alias("entity"))
    c_e = _kinds(of, "entity").select("entity", "n", F.col("n").alias("c_e"), F.xxhash64("n", "x1", "x2").alias("bundle"))
    counted = join_counted(of, c_e, "entity", of.count())
    entities = counted.groupBy("text_key").agg(F.collect_set(F.struct("bundle", "c_e")).alias("entities"), F.max("c_e").alias("most"))
    terms = holders.select("text_key", F.explode(F.array_distinct(F.transform("words", lambda w: w.term))).alias("term"))
    kinds = _kinds(terms, "term").join(c_t, "term").select("term", "n", "c_t", F.xxhash64("n", "x1", "x2", "c_t").alias("of_terms"))
    terms = written(join_counted(terms, kinds, "term", terms.count()), "pii-words")
    ic = lambda c: F.log2(total / F.col(c))
    possible = lambda c: F.log2(total / F.greatest(F.col(c), F.col("c_t"))) >= disclose * ic(c) - 1e-9
    met = terms.select("text_key", "of_terms", "c_t").distinct().join(entities, "text_key").where(possible("most"))
    pairs = met.select("text_key", "of_terms", "c_t", F.inline("entities")).where((F.col("c_e") < total) & possible("c_e"))
    # Pairs in many texts are dealt out; c_et is at most the smaller count.
    parts = F.least(F.floor(F.least("c_e", "c_t") / 256) + 1, F.lit(64)).cast("int")
    pairs = written(pairs.withColumn("salt", F.pmod("text_key", parts).cast("int")), "pii-pairs")
    both = pairs.groupBy("bundle", "of_terms").agg(F.count("*").alias("c_et"), F.first("c_e").alias("c_e"), F.first("c_t").alias("c_t"))
    pmi = F.log2(total * F.col("c_et") / (F.col("c_e") * F.col("c_t")))
    flagged = both.withColumns({"pmi": pmi, "ic": ic("c_e")}).where(F.col("pmi") >= disclose * F.col("ic"))
    flagged = flagged.select("bundle", "of_terms", (F.col("pmi") / F.col("ic")).alias("share"), (F.col("pmi") >= remove * F.col("ic")).alias("removed"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    found = pairs.select("text_key", "bundle", "of_terms", "salt").join(flagged, ["bundle", "of_terms", "salt"])
    found = found.groupBy("text_key", "of_terms").agg(F.max("share").alias("share"), F.max("removed").alias("removed"))
    return terms.select("text_key", "term", "of_terms").join(found, ["text_key", "of_terms"]).drop("of_terms")


def term_spans(documents: DataFrame, rows: DataFrame, **thresholds) -> DataFrame:
    """text_key, terms: array of (start, end, removed), each place once."""
    holders = _holders(rows)
    flagged = disclosive(documents, rows, holders, **thresholds)
    places = holders.select("text_key", F.inline("words"))
    return places.join(flagged, ["text_key", "term"]).groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "removed"))).alias("terms"))


_TERMS = "array<struct<start:int,end:int,removed:boolean>>"


def _with_terms(rows: DataFrame, key: Column, terms: DataFrame, salt: int = 16) -> DataFrame:
    """``rows`` with __pii_terms; a text of many copies is dealt out by doc_id."""
    t = terms.select(F.col("text_key").alias("__pii_key"), F.col("terms").alias("__pii_terms"), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("__pii_salt"))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(salt)).cast("int")
    joined = rows.join(t, (key == t["__pii_key"]) & (at == t["__pii_salt"]), "left").drop("__pii_key", "__pii_salt")
    return joined.withColumn("__pii_terms", F.coalesce("__pii_terms", F.array().cast(_TERMS)))


def detect(documents: DataFrame, **thresholds) -> DataFrame:
    """doc_id, spans (base) and terms, a row for each row of ``documents``."""
    rows = found(documents)
    hit = _with_terms(rows.where(F.size("spans") > 0).select("doc_id", "text_key", "spans"), F.col("text_key"), term_spans(documents, rows, **thresholds))
    clean = rows.where(F.size("spans") == 0).select("doc_id", "spans", F.array().cast(_TERMS).alias("terms"))
    return clean.unionByName(hit.select("doc_id", "spans", F.col("__pii_terms").alias("terms")))


def sanitise(documents: DataFrame, **thresholds) -> DataFrame:
    """``documents`` with base values replaced by placeholders, and disclosive terms generalised or removed."""
    rows = found(documents)
    terms = term_spans(documents, rows, **thresholds)
    keyed = documents.withColumns({"__pii_spans": base_spans(F.coalesce("text", F.lit("")))})
    clean = keyed.where(F.size("__pii_spans") == 0).drop("__pii_spans")
    hit = _with_terms(keyed.where(F.size("__pii_spans") > 0), text_key(F.col("text")), terms)
    marks = F.transform("__pii_spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.concat(F.lit("<"), F.upper(s.kind), F.lit(">")).alias("by")))
    general = lambda words: F.transform("__pii_terms", lambda s, i: F.struct(s.start.alias("start"), s.end.alias("end"), _general(F.get(words, i), s.removed).alias("by")))
    place = F.concat(marks, bound(slices(F.col("text"), F.col("__pii_terms")), general))
    return clean.unionByName(hit.withColumn("text", replaced(F.col("text"), F.array_sort(place))).drop("__pii_spans", "__pii_terms"))


def _general(term: Column, removed: Column) -> Column:
    kind = F.when(term.rlike(r"^\p{N}+$"), "<NUMBER>").when(term.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<TERM>")
    return F.when(removed, "").otherwise(kind)


def replaced(text: Column, places: Column) -> Column:
    """``text`` with each (start, end, by) replaced; what overlaps an earlier place goes with it."""
    return _spliced(text, places, lambda s, at: F.when(s.start >= at, s.by).otherwise(""))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digest_columns(detected: DataFrame) -> DataFrame:
    """The contract's columns from `detect`."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    simple = F.transform("spans", lambda s: F.struct(s.start.alias("start"), s["rank"].alias("rank"), s.kind.alias("kind"), s.end.alias("end")))
    more = F.transform("terms", lambda s: F.struct(s.start.alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), s.end.alias("end")))
    return detected.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        sha256_hex(spans_text(F.col("spans"))).alias("base_sha256"),
        spans_text(F.array_sort(F.concat(simple, more))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )
