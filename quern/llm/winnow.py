"""Document fingerprints by winnowing, in built-in functions only.

A text's units are its runs of non-space characters, lower-cased.  Inside a run, every code point of a script
that is written without spaces is a unit, and a unit ends after each of the letters `ENDS`, which are seldom in
words but cut a long run of any letters or digits.  So what a unit is goes by its own characters alone: it
doesn't matter how long a run is, where it begins, or where a passage is wrapped, but for the units at the wraps.
Every k
units in a row are hashed; of every w hashes in a row the smallest is chosen,
the rightmost one on ties, and kept with its position.  Whatever two texts share
over k + w - 1 units in a row leaves at least one hash in both fingerprints;
what is shorter than k units never does.

For the choice a hash counts by its upper 36 bits, with the position in the
lower 28, so that one comparison settles value and tie; the fingerprint holds
the whole 64-bit hash.  A text may have 2^28 units; Spark's longest string has fewer.

Defined results
---------------
* null or empty text, or white space only: an empty fingerprint;
* fewer than k units: one hash, of all of them, at position 0;
* fewer than w hashes: the smallest one;
* two empty fingerprints are alike (1.0), an empty and another one aren't (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quern.operators.prefix import with_range

from .common import bound

K, W = 5, 8
_POSITIONS = (1 << 28) - 1
#: Thai to Myanmar, Khmer, the radicals, kana and ideographs, and the planes of further ideographs.
SPACELESS = r"\u0E00-\u109F\u1780-\u17FF\u2E80-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: What ends a unit inside a run.
ENDS = "jkqvxz7"
UNIT = rf"[^\x20\x09-\x0D{SPACELESS}{ENDS}]++[{ENDS}]?+|[{ENDS}{SPACELESS}]"


def units(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(UNIT), F.lit(0))


def gram_hashes(unit_array: Column, k: int = K) -> Column:
    """Hashes of every k units in a row; one for a shorter sequence, none for an empty one."""
    one = F.transform(unit_array, lambda u: F.xxhash64(u))
    return bound(one, lambda h: F.when(
        F.size(h) > k - 1,
        F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])),
    ).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>")))


def choose(hashes: Column, w: int = W) -> Column:
    """Positions chosen from an array of hashes, in order, each once."""

    def windows(packed: Column) -> Column:
        n = F.greatest(F.size(packed) - w + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_min(F.slice(packed, i, F.lit(w))))

    # A smaller lower part is a position further right.
    packed = F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~_POSITIONS)).bitwiseOR((F.lit(_POSITIONS) - i).cast("long")))
    chosen = F.array_distinct(bound(packed, windows))
    return F.when(F.size(hashes) > 0, F.transform(chosen, lambda p: (F.lit(_POSITIONS) - p.bitwiseAND(F.lit(_POSITIONS))).cast("int"))).otherwise(F.array().cast("array<int>"))


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """array<struct<hash: long, position: int>>, by position."""
    return bound(
        gram_hashes(units(text), k),
        lambda h: F.transform(choose(h, w), lambda p: F.struct(F.get(h, p).alias("hash"), p.alias("position"))),
    )


def hashes_of(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: x.hash))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def as_text(prints: Column) -> Column:
    """``hash@position`` of each, the hash in hexadecimal, joined by commas."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.lower(F.hex(x.hash)), F.lit("@"), x.position.cast("string"))), ",")


def in_line(documents: DataFrame, ties: str, rows_per_range: int = 2000) -> tuple[DataFrame, WindowSpec]:
    """Rows and a window for `lead`, which gives what stands in the row that follows by descending doc_id; after the last one comes the first.

    Rows are dealt into ranges of doc_id of about equally many rows.  The first row of each range stands as a
    copy at the end of the range before it, so no range looks into another.  Equal
    doc_ids follow one another by the column ``ties``; null doc_ids are last.  Rows
    with ``late`` = 1 are the copies.
    """
    placed = with_range(documents, "doc_id", rows_per_range, "bucket")
    # A row for each range from here on, a fixed number at most.
    firsts = placed.groupBy("bucket").agg(F.max("doc_id").alias("first_id"))
    line = Window.partitionBy(F.lit(0)).orderBy("bucket")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.withColumn("earlier", F.coalesce(F.lead("bucket").over(line), F.min("bucket").over(whole)))
    rows = placed.join(F.broadcast(firsts), "bucket")
    at = lambda late, bucket: F.struct(F.lit(late).alias("late"), F.col(bucket).alias("at"))
    # The row itself, and for the first of a range its copy, which comes last in the range before.
    places = F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.array(at(0, "bucket"), at(1, "earlier"))).otherwise(F.array(at(0, "bucket")))
    rows = rows.select(*documents.columns, F.inline(places)).repartition("at")
    return rows, Window.partitionBy("at").orderBy("late", F.col("doc_id").desc_nulls_last(), ties)


def edited(documents: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each document with its fingerprint, its edited text's, and its likeness to that and to the next document.

    The edited text has its last third replaced by the start of the next document.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, order = in_line(docs, "text")
    rows = rows.withColumn("prints", fingerprint(F.col("text"), k, w))
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_prints": F.lead("prints").over(order)}).where("late = 0")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    changed = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "prints", "next_prints", changed.alias("edited_text"))
    rows = rows.withColumn("edited_prints", fingerprint(F.col("edited_text"), k, w))
    rows = rows.withColumns({f"{x}hashes": hashes_of(F.col(f"{x}prints")) for x in ("", "next_", "edited_")})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "prints",
        "edited_prints",
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
