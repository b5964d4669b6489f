"""MinHash near-duplicates by a multi-index Hamming join.

1. A document's set of word shingles is hashed; equal sets are one class.
2. Each class has a signature of ``chunks`` x ``width`` values of ``bits`` bits, the lowest of as many
   minima.  Two signatures that differ in at most 2 * chunks - 1 places have a chunk that differs in
   at most one (pigeonhole).  The allowed errors of a chunk are enumerated by
   leaving out one place at a time: every such rest is a key, and two chunks with
   at most one error share a key.  So every pair under the signature distance
   meets, and so do most pairs beyond it: at a similarity of 0.8 a chunk of six
   has at most one error with probability 0.66, and ten chunks all miss with 2e-5.
3. Classes that share keys form families (components over key to first class).
   Links are confirmed on the full sets, inside a family: its
   classes are dealt into cells of at most ``cell`` classes and about ``cell_shingles`` shingles, with
   the family's most central classes as guests in each cell, and every pair of a cell is compared.
   A family of one cell is then complete.
4. In a larger one some classes may lie outside the family's largest component by then, be it that they
   share nothing but a passage that stands in very many texts.  Such families are taken apart once more: of two sets
   over the threshold, each has one of the other's among its rarest 100 - percent shingles in a hundred (and one more),
   whatever order of rarity all agree on.  Classes that share such a shingle with one from outside the largest
   component form smaller families; what shares none has no link.  In those, whatever
   isn't in the largest component is compared with every cell, block by block.
   Pairs inside one component need no test, so no link between components is lost.
5. Components over the confirmed links give the result.

Only spanning links leave a task, never the pairs of a group.  Counts of keys are
summed before they are exchanged, and keys with many rows are joined by broadcast (`join_counted`).
Those, a thousand rows at most, are all that the driver gets to broadcast: any other join is one by exchange, as the
planner takes sides for small by the bytes of their compressed files, and a side that `_rest` explodes by the bytes it had before.

Cost: linear in the rows, but for classes that share rare shingles without being similar enough; those
take (size of such a family) x (classes outside its largest component) comparisons.

Defined results
---------------
* null or empty text, or white space only: an empty set, linked with nothing;
* fewer words than a shingle: all of them as one shingle;
* rows with the same doc_id count as one document in `components`, with the links of all, but for those without shingles;
  `distinct_documents` goes by texts alone;
* null doc_id: takes part in links; its component is the smallest doc_id there, null if there is none;
* extra columns are ignored by `components`, kept by `distinct_documents`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, join_counted, written
from .components import connected_components


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    chunks: int = 10
    width: int = 6
    bits: int = 16
    cell: int = 256
    cell_shingles: int = 2_000_000
    guests: int = 4
    seed: int = 29


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _WordHashes(dict):
    """64-bit hashes of words; forgets them when they are many, which changes no hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_set(text: str | None, known: _WordHashes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; bytes.split knows just the ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


class Signer:
    def __init__(self, s: Settings):
        self.s = s
        rng = np.random.default_rng(s.seed)
        k = s.chunks * s.width
        self.times = rng.integers(0, 2**32, (k, 1), dtype=np.uint32) | np.uint32(1)
        self.plus = rng.integers(0, 2**32, (k, 1), dtype=np.uint32)
        # For each key: the places that stay, one left out of a chunk.
        self.rest = np.array([[c * s.width + j for j in range(s.width) if j != out] for c in range(s.chunks) for out in range(s.width)])

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x = _mix(shingles).astype(np.uint32)
        parts = [(x[i : i + 8192][None, :] * self.times + self.plus).min(axis=1) for i in range(0, len(x), 8192)]
        return (np.minimum.reduce(parts) & np.uint32((1 << self.s.bits) - 1)).astype("<u4" if self.s.bits > 16 else "<u2")

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """A row of keys for each row of signatures."""
        sig = signatures.astype(np.uint64)
        out = np.broadcast_to(np.arange(len(self.rest), dtype=np.uint64), (len(sig), len(self.rest)))
        for j in range(self.rest.shape[1]):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, self.rest[:, j]])
        return out.view(np.int64)


def text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


SETS = "doc_id long, text_key long, n_shingles long, digest binary, signature binary"


def signed(documents: DataFrame, s: Settings) -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the set and its signature (null if the set is empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signer = _WordHashes(), Signer(s)
        for batch in batches:
            n, digests, signatures = [], [], []
            for text in batch.column(2):
                shingles = shingle_set(text.as_py(), known, s.words)
                n.append(len(shingles))
                digests.append(blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                signatures.append(signer.signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], schema=schema)

    return documents.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text").mapInArrow(run, SETS)


def keyed(classes: DataFrame, s: Settings) -> DataFrame:
    """(node, key): the keys of each class."""
    schema = pa.schema([("node", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(s)
        kind = np.dtype("<u4" if s.bits > 16 else "<u2")
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                keys = signer.keys(np.frombuffer(b"".join(part.column(1).to_pylist()), kind).reshape(part.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1])), pa.array(keys.ravel())], schema=schema)

    return classes.select("node", "signature").mapInArrow(run, "node long, key long")


def _links(ids: np.ndarray, sets: list[np.ndarray], own: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning links among the sets of a cell; pairs of two sets that aren't ``own`` are left to other cells."""
    m = len(sets)
    lengths = np.array([len(x) for x in sets])
    allof = np.concatenate(sets)
    row = np.repeat(np.arange(m), lengths)
    order = np.argsort(allof, kind="stable")
    allof, row = allof[order], row[order]
    new = np.r_[True, allof[1:] != allof[:-1]]
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1  # what one set alone has is in no intersection
    if not shared.any():
        return []
    group, row = np.unique(group[shared], return_inverse=True)[1], row[shared]
    bits = np.zeros((m, (int(group.max()) >> 6) + 1), np.uint64)
    np.bitwise_or.at(bits, (row, group >> 6), np.uint64(1) << (group & 63).astype(np.uint64))
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for i in range(1, m):
        inter = np.bitwise_count(bits[:i] & bits[i]).sum(axis=1, dtype=np.int64)
        union = lengths[:i] + lengths[i] - inter
        for j in np.flatnonzero((100 * inter >= percent * union) & (own[:i] | own[i])):
            a, b = root(i), root(int(j))
            if a != b:
                parent[a] = b
                found.append((int(ids[i]), int(ids[j])))
    return found


def _compare(members: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) from rows (cell, own, node, text), a cell's rows standing together."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        cell, ids, own, sets = None, [], [], []

        def close() -> pa.RecordBatch:
            links = _links(np.array(ids), sets, np.array(own), s.percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], schema=schema)

        for batch in batches:
            for c, o, d, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != cell:
                    if (done := close()).num_rows:
                        yield done
                    cell, ids, own, sets = c, [], [], []
                ids.append(d)
                own.append(o)
                sets.append(shingle_set(t, known, s.words))
        if (done := close()).num_rows:
            yield done

    rows = members.select("cell", "own", "node", "text").repartition("cell").sortWithinPartitions("cell")
    return rows.mapInArrow(run, "a long, b long")


def _joined_groups(rows: DataFrame, group: str, out: str, f) -> DataFrame:
    """f(iterator of (group, rows as dicts)) over the rows of each value of ``group`` in a row, which is bounded; ``kind`` orders a group's rows."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[dict]:
            for batch in batches:
                for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    yield dict(zip(names, row, strict=True))

        for k, part in groupby(flat(), key=lambda r: r[group]):
            yield from f(k, part)

    return rows.repartition(group).sortWithinPartitions(group, *(["kind"] if "kind" in names else [])).mapInArrow(run, out)


def _common(first_cells: DataFrame, s: Settings) -> DataFrame:
    """(root, hashes, counts): the shingles that stand in a thirty-second or more of a family's first cell, which is dealt by a hash."""
    schema = pa.schema([("root", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def f(root: int, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        sets = [shingle_set(r["text"], known, s.words) for r in rows]
        hashes, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= max(2, len(sets) / 32)
        yield pa.RecordBatch.from_arrays([pa.array([root]), pa.array([hashes[often].tobytes()], pa.binary()), pa.array([counts[often].astype(np.int64).tobytes()], pa.binary())], schema=schema)

    return _joined_groups(first_cells, "root", "root long, hashes binary, counts binary", f)


def rarest(shingles: np.ndarray, hashes: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """So many of a set's rarest shingles that any set over the threshold shares one with as many of its own rarest.

    ``hashes`` (sorted) and ``counts`` tell common shingles; all others are rarer, and ties go by the hash.
    """
    n = len(shingles)
    how_often = np.zeros(n, np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
        how_often = np.where(hashes[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, how_often))[: n + percent * n // -100 + 1]]


def _rare_keys(seats: DataFrame, common: DataFrame, s: Settings) -> DataFrame:
    """(key, node, rest): a key for each of the rarest shingles of each class; ``seats``: (cell, root, node, rest, text), ``common``: (cell, hashes, counts)."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("rest", pa.bool_())])

    def f(_: int, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for r in rows:
            if r["kind"] == 0:
                hashes, counts = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.int64)
                continue
            rare = rarest(shingle_set(r["text"], known, s.words), hashes, counts, s.percent)
            keys = _mix(rare + _mix(np.array([r["root"]], np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), r["node"])), pa.array(np.full(len(keys), r["rest"]))], schema=schema)

    none = F.lit(None).cast("binary")
    both = seats.select("cell", F.lit(1).alias("kind"), "root", "node", "rest", "text", none.alias("hashes"), none.alias("counts")).unionByName(
        common.select("cell", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("boolean").alias("rest"), F.lit(None).cast("string").alias("text"), "hashes", "counts")
    )
    return _joined_groups(both, "cell", "key long, node long, rest boolean", f)


def _linked(documents: DataFrame, sets: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """(a, b): spanning links between classes."""
    keys = written(keyed(classes, s), "keys")
    buckets = keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    buckets = written(buckets, "buckets")
    met = join_counted(keys, buckets.withColumn("weight", F.col("n")), "key", keys.count()).groupBy("node", "first").agg(F.sum("weight").alias("weight"))
    met = written(met, "met")
    drop_written(keys)
    drop_written(buckets)
    families = connected_components(met.select(F.col("node").alias("a"), F.col("first").alias("b")))
    families = families.unionByName(families.select(F.col("root").alias("node"), "root").distinct())
    weight = met.groupBy("node").agg(F.sum("weight").alias("weight"))
    families = families.join(classes.select("node", "doc_id", "text_key", "n_shingles").hint("merge"), "node").join(weight.hint("merge"), "node", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    families = written(families, "families")
    drop_written(met)

    # A family of one cell has no guests; in a larger one the most central classes, which share keys with most others, visit every cell.
    sizes = families.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    needed = F.greatest(F.when(F.col("n") > s.cell, F.ceil(F.col("n") / (s.cell - s.guests))).otherwise(1), F.ceil(F.col("shingles") / s.cell_shingles))
    sizes = written(sizes.select("root", "n", needed.cast("long").alias("cells")), "sizes")
    member = join_counted(families.select("node", "root", "doc_id", "text_key", "n_shingles", "weight"), sizes, "root", families.count())
    member = written(member.withColumn("cell_no", F.pmod(F.xxhash64("node"), "cells")), "members")
    guests = _most_central(member, s.guests).select("node", "root", F.col("cell_no").alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell_no"))
    seated = _seats(member, True).unionByName(_seats(guests.where("cell_no <> home"), False))
    # The texts of members are picked once and kept; members grow with the input, so they are joined in one way at every size.
    where = documents.select(*_place(F.col("doc_id").cast("long"), text_key()), "text").hint("merge")
    texts = member.select("node", *_place(F.col("doc_id"), F.col("text_key"))).join(where, ["__none", "__id", "__key"]).select("node", "text")
    texts = written(texts.dropDuplicates(["node"]), "texts")
    drop_written(families)
    links = written(_compare(seated.join(texts.hint("merge"), "node"), s), "links")
    if not sizes.where("cells > 1").isEmpty():
        every, texts = texts, written(texts.join(member.where("cells > 1").select("node").hint("merge"), "node", "left_semi"), "texts")
        drop_written(every)
        links = links.unionByName(written(_compare(_rest(_taken_apart(member, texts, links, s), s).join(texts.hint("merge"), "node"), s), "links"))
    return links


def _place(doc_id, key) -> list:
    """Columns that tell rows apart, null ids too."""
    return [doc_id.isNull().alias("__none"), F.coalesce(doc_id, F.lit(0)).alias("__id"), key.alias("__key")]


def classes_of(sets: DataFrame) -> DataFrame:
    """node, digest, n (rows), and of the row with the smallest doc_id: doc_id, text_key, n_shingles, signature."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n_shingles", "signature")).alias("r")
    rows = sets.where("digest is not null").groupBy("digest").agg(first, F.count("*").alias("n"))
    return written(rows.select(F.monotonically_increasing_id().alias("node"), "digest", "n", "r.doc_id", "r.text_key", "r.n_shingles", "r.signature"), "classes")


def _grouped(links: DataFrame) -> DataFrame:
    """(node, root) of every class with a link, roots too."""
    roots = connected_components(links)
    return written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")


def components(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of ``documents``."""
    sets = written(signed(documents, s), "sets")
    classes = classes_of(sets)
    links = _linked(documents, sets, classes, s)
    # Different texts under one id: few, and all of them are linked to the first.
    several = sets.where("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    of_ids = sets.where("digest is not null").join(several.hint("merge"), "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "node").hint("merge"), "digest")
    of_ids = of_ids.join(of_ids.groupBy("doc_id").agg(F.min("node").alias("b")).hint("merge"), "doc_id").select(F.col("node").alias("a"), "b")
    linked = _grouped(links.unionByName(of_ids))
    named = linked.join(classes.select("node", "digest", "doc_id", "n").hint("merge"), "node")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component"), F.count("*").alias("__n"))
    moved = join_counted(named, least, "root", linked.count(), "__n").select("digest", "n", "component")
    copied = classes.where("n > 1").join(linked.select("node").hint("merge"), "node", "left_anti").select("digest", "n", F.col("doc_id").alias("component"))
    found = written(moved.unionByName(copied), "found")
    rows = sets.select("doc_id", "n_shingles", "digest")
    full = join_counted(rows.where("digest is not null"), found, "digest", rows.count(), how="left").drop("digest")
    empty = rows.where("digest is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component"))
    return full.unionByName(empty).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def distinct_documents(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row of ``documents`` for each component of texts: of its rows that with the smallest doc_id, else any with a null one.

    Ids link nothing: different texts under one doc_id stay as long as they aren't alike.
    Texts without shingles stay, one row for each doc_id and text.
    """
    sets = written(signed(documents, s), "sets")
    classes = classes_of(sets)
    linked = _grouped(_linked(documents, sets, classes, s))
    place = ["doc_id", "text_key"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *place)).alias("r")
    kept = linked.join(classes.select("node", *place).hint("merge"), "node").groupBy("root").agg(first).select("r.doc_id", "r.text_key")
    kept = kept.unionByName(classes.select("node", *place).join(linked.select("node").hint("merge"), "node", "left_anti").select(*place))
    kept = kept.unionByName(sets.where("digest is null").select(*place).distinct())
    kept = written(kept.select(*_place(F.col("doc_id"), F.col("text_key"))), "kept")
    key = ["__none", "__id", "__key"]
    rows = documents.select("*", *_place(F.col("doc_id").cast("long"), text_key())).join(kept.hint("merge"), key, "left_semi")
    once = Window.partitionBy(*key).orderBy(F.lit(0))
    return rows.withColumn("__rank", F.row_number().over(once)).where("__rank = 1").select(*documents.columns)


def _seats(rows: DataFrame, own: bool, *more: str) -> DataFrame:
    return rows.select("node", F.xxhash64("root", "cell_no", *more).alias("cell"), F.lit(own).alias("own"))


def _most_central(member: DataFrame, n: int) -> DataFrame:
    """The n heaviest classes of each family of several cells: first in each cell, then among those."""
    order = [F.col("weight").desc(), F.col("node")]
    rows = member.where("cells > 1")
    for keys in (("root", "cell_no"), ("root",)):
        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
    return rows


def _outside(placed: DataFrame) -> DataFrame:
    """(root, main, n, shingles, others, other_shingles) of the families that have classes outside ``main``, their largest part."""
    parts = placed.groupBy("root", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    most = F.max(F.struct("n", "part", "shingles")).alias("most")
    main = parts.groupBy("root").agg(most, F.sum("n").alias("n"), F.sum("shingles").alias("shingles")).where("n > most.n")
    return main.select("root", F.col("most.part").alias("main"), "n", "shingles", (F.col("n") - F.col("most.n")).alias("others"), (F.col("shingles") - F.col("most.shingles")).alias("other_shingles"))


def _taken_apart(member: DataFrame, texts: DataFrame, links: DataFrame, s: Settings) -> DataFrame:
    """(node, root, part): the families of several cells once more, by rare shingles that a class outside the largest component shares."""
    linked = _grouped(links)
    placed = member.where("cells > 1").join(linked.withColumnRenamed("root", "part").hint("merge"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    placed = written(placed.select("node", "root", "part", "n_shingles", "cells", "cell_no"), "placed")
    left = written(_outside(placed).select("root", "main", "n"), "outside")
    placed = join_counted(placed, left, "root", placed.count())
    placed = written(placed.withColumn("rest", F.col("part") != F.col("main")), "placed")
    common = written(_common(placed.where("cell_no = 0").select("root", "node").join(texts.hint("merge"), "node"), s), "common")
    cell = F.xxhash64("root", "cell_no").alias("cell")
    served = placed.select("root", "cell_no", cell).distinct().join(common.hint("merge"), "root").select("cell", "hashes", "counts")
    keys = written(_rare_keys(placed.select("node", "root", "rest", cell).join(texts.hint("merge"), "node"), served, s), "rare")
    buckets = written(keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n"), F.max("rest").alias("any_rest")).where("n > 1 and any_rest"), "buckets")
    met = join_counted(keys.select("key", "node"), buckets.select("key", "first", "n"), "key", keys.count())
    apart = _grouped(met.select(F.col("node").alias("a"), F.col("first").alias("b")))
    drop_written(keys)
    return written(apart.join(placed.select("node", "part", "n_shingles").hint("merge"), "node"), "apart")


def _rest(placed: DataFrame, s: Settings) -> DataFrame:
    """Seats that bring each class outside its family's largest component together with every cell of the family."""
    many = lambda rows, shingles: F.ceil(F.greatest(F.col(rows) / s.cell, F.col(shingles) / s.cell_shingles)).cast("long")
    blocks = _outside(placed).select("root", "main", "n", many("n", "shingles").alias("cells"), many("others", "other_shingles").alias("blocks"))
    placed = written(join_counted(placed, blocks, "root", placed.count()), "placed").withColumn("cell_no", F.pmod(F.xxhash64("node"), "cells"))
    rest = placed.where("part <> main").withColumn("block", F.pmod(F.xxhash64("node", "root"), F.col("blocks")))
    visiting = rest.withColumn("cell_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    visited = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return _seats(visiting, True, "block").unionByName(_seats(visited, False, "block"))
