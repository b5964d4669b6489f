"""A trie of conversations' first turns, with sums over subtrees by centroid decomposition.

A conversation is a sequence of turns (role, text); conversations that start with the same d turns are members of one
node of depth d, from the root, which has no turns.  A node is named by its smallest member and its depth.

Nodes are found by a key of each prefix: the exclusive or of two 64-bit hashes of every turn with its place.  It is
a running aggregate, worked out inside ranges of rows and carried over ranges, so a conversation may have any share of all turns.

Sums over subtrees come from splitting the forest of parent edges.  A node weighs as much as it has members, and a subtree as much as
its members have turns left, which is known without a rollup.  A component is split at its centroid, the deepest node whose subtree
has the component's highest power of two in weight; what is below each child and what is above are components of the next round,
all lighter by that power, so rounds are at most the logarithm of the weight, however deep the trie is.  The total below a centroid is added to
the nodes from it up to the component's top.  Whether one node stands under another is looked up in the
rows of its smallest member.  Components of at most ``task_nodes`` nodes are summed where they are.

Turns go by number, null first; equal numbers go by a hash of role and text.  A null role or text is empty; rows without conv_id are left out.
Repeated rows are turns of their own.  Other columns are ignored; an empty table has no nodes.  Texts are hashed and measured whole, in the row, and never exchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_counted, written

ROWS_PER_RANGE, TASK_NODES, STREAM_ROWS = 500_000, 20_000, 65_536


def _hashes(tag: int, *columns) -> list[Column]:
    """Two independent hashes."""
    return [F.xxhash64(F.lit(tag + i), *columns) for i in range(2)]


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv, part, at, h1, h2, chars): turns sorted by conversation and number; ``at`` counts the rows of the whole table, ``part`` is the range of rows."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    h1, h2 = _hashes(1, role, text)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", h1.alias("h1"), h2.alias("h2"), F.length(text).cast("long").alias("chars"))
    # Rows that are alike in everything still have an order, so that they can be cut into ranges.
    order = ["conv", F.asc_nulls_first("turn"), "h1", "h2", "uid"]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_RANGE))
    rows = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The upper bits of the identifier are the range, the lower 33 count its rows.
    rows = written(rows.select("conv", "h1", "h2", "chars", F.monotonically_increasing_id().alias("id")), "trie-turns")
    part, inside = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    sizes = written(sizes.select("part", before.alias("before")), "trie-ranges")
    return rows.withColumn("part", part).join(F.broadcast(sizes), "part").select("conv", "part", (F.col("before") + inside).alias("at"), "h1", "h2", "chars")


def rebuilt(turns: DataFrame, base: Column, lead: Column, most: int) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, chars, left): every prefix of every rebuilt conversation, with the key of the prefix before it and the number of turns from here on.

    A conversation takes the first ``lead`` original turns, ``most`` at most, of the conversation ``base``, then its own after so many; both are columns of ``conv``.
    """
    sizes = turns.groupBy("conv").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    total = turns.count()
    sizes = written(sizes, "trie-sizes")
    firsts = join_counted(turns, sizes, "conv", total).where(F.col("at") - F.col("first") < most)
    firsts = firsts.groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "h1", "h2", "chars"))).alias("firsts"))  # ``most`` at most
    convs = sizes.select("conv", "first", "n", base.alias("base"), lead.cast("int").alias("lead")).join(firsts, "base", "left")
    taken = F.coalesce(F.slice("firsts", F.lit(1), F.col("lead")), F.array().cast("array<struct<at:bigint,h1:bigint,h2:bigint,chars:bigint>>"))

    def grow(acc, x):
        e1, e2 = _hashes(3, F.size(acc).cast("long"), x["h1"], x["h2"])
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct(last["k1"].bitwiseXOR(e1).alias("k1"), last["k2"].bitwiseXOR(e2).alias("k2"), x["chars"].alias("chars"))))

    zero = F.lit(0).cast("long")
    root = F.array(F.struct(zero.alias("k1"), zero.alias("k2"), zero.alias("chars")))
    convs = convs.select("conv", "first", "n", "lead", F.aggregate(taken, root, grow).alias("path"))  # the root and the turns of the base
    head = F.size("path").cast("long") - 1
    convs = written(convs.withColumn("head", head).withColumn("length", head + F.greatest(F.col("n") - F.col("lead"), F.lit(0))), "trie-conversations")

    before = F.get("path", F.col("i") - 1)
    led = convs.select("conv", "length", "path", F.posexplode("path").alias("i", "x"))
    led = led.select("conv", F.col("i").cast("long").alias("depth"), "x.k1", "x.k2", before["k1"].alias("p1"), before["k2"].alias("p2"), "x.chars", (F.col("length") - F.col("i") + 1).alias("left"))

    side = convs.select("conv", "n", "first", "lead", "head", "length", F.element_at("path", -1)["k1"].alias("s1"), F.element_at("path", -1)["k2"].alias("s2"))
    own = join_counted(turns, side, "conv", total).where(F.col("at") - F.col("first") >= F.col("lead"))
    own = own.withColumn("depth", F.col("head") + F.col("at") - F.col("first") - F.col("lead") + 1)
    e1, e2 = _hashes(3, F.col("depth"), "h1", "h2")
    own = written(own.select("conv", "part", "depth", "chars", (F.col("length") - F.col("depth") + 1).alias("left"), "s1", "s2", e1.alias("e1"), e2.alias("e2")), "trie-own")
    inside = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # the ranges of a conversation
    ranges = own.groupBy("conv", "part").agg(F.bit_xor("e1").alias("r1"), F.bit_xor("e2").alias("r2"))
    ranges = ranges.select("conv", "part", *[F.coalesce(F.bit_xor(r).over(earlier), F.lit(0)).alias(r) for r in ("r1", "r2")])
    own = own.withColumns({"k1": F.bit_xor("e1").over(inside), "k2": F.bit_xor("e2").over(inside)}).join(ranges, ["conv", "part"])
    own = own.withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"s{i}")).bitwiseXOR(F.col(f"r{i}")) for i in (1, 2)})
    own = own.select("conv", "depth", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (1, 2)], "chars", "left")
    return written(led.unionByName(own), "trie-prefixes")


def trie(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, parent, n_convs, n_children, chars, weight) and rows (conv, depth, node, parent, left); a node is (conv_id, depth)."""
    key = F.struct("depth", "k1", "k2")
    rows = prefixes.withColumn("key", key)
    nodes = rows.groupBy("key").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.sum("left").alias("weight"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    above = F.when(F.col("key.depth") > 0, F.struct((F.col("key.depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")))
    nodes = written(nodes.select("key", F.struct("conv_id", "key.depth").alias("node"), above.alias("above"), "n_convs", "chars", "weight"), "trie-keys")
    families = nodes.where("above is not null").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(families, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-families")
    parents = nodes.where("n_children > 0").select(F.col("key").alias("above"), F.col("node").alias("parent"), "n_children")
    total = nodes.count()
    children = join_counted(nodes.where("above is not null"), parents.withColumnRenamed("n_children", "n"), "above", total)
    root = nodes.where("above is null").withColumn("parent", F.lit(None).cast("struct<conv_id:bigint,depth:bigint>"))
    nodes = written(children.unionByName(root).drop("above"), "trie-nodes")
    names = nodes.select("key", "node", "parent", F.col("n_convs").alias("n"))
    rows = join_counted(rows.select("conv", "depth", "left", "key"), names, "key", prefixes.count()).drop("key")
    return nodes.drop("key"), written(rows, "trie-rows")


def _streamed(batches, done, rows: int = STREAM_ROWS):
    """Batches of rows sorted by ``comp``, put together so that no component is cut; each holds ``rows`` rows and one component more at most."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            comp = [t.column(c).to_numpy() for c in ("c_conv", "c_depth")]
            ends = np.flatnonzero((comp[0][1:] != comp[0][:-1]) | (comp[1][1:] != comp[1][:-1]))
            if len(ends):
                yield done(t.slice(0, ends[-1] + 1))
                t = t.slice(ends[-1] + 1)
            held = t.to_batches()
    if sum(x.num_rows for x in held):
        yield done(pa.Table.from_batches(held))


def _summed_here(rows: DataFrame, values: list[str]) -> DataFrame:
    """Sums over subtrees in components that fit a task: (conv_id, depth) with its sums, what was added from below included."""
    kinds = "conv_id long, depth long, " + ", ".join(f"{v} long" for v in values)

    def done(t: pa.Table) -> pa.RecordBatch:
        conv, depth, up, c_conv, c_depth = (t.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "depth", "up", "c_conv", "c_depth"))
        names = np.rec.fromarrays([conv, depth])
        order = np.argsort(names, kind="stable")
        inner = np.flatnonzero((conv != c_conv) | (depth != c_depth))  # all but the tops
        above = np.full(len(conv), -1)
        above[inner] = order[np.searchsorted(names[order], np.rec.fromarrays([up[inner].astype(np.int64), depth[inner] - 1]))]
        sums = [t.column(v).to_numpy().copy() for v in values]
        inner = inner[np.argsort(-depth[inner], kind="stable")]
        for level in np.split(inner, np.flatnonzero(np.diff(depth[inner])) + 1):
            for s in sums:
                np.add.at(s, above[level], s[level])
        sums = [s + t.column(f"more_{v}").to_numpy() for s, v in zip(sums, values, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(conv), pa.array(depth), *map(pa.array, sums)], names=["conv_id", "depth", *values])

    rows = rows.select("node.conv_id", "node.depth", F.coalesce("parent.conv_id", F.lit(0)).alias("up"), F.col("comp.conv_id").alias("c_conv"), F.col("comp.depth").alias("c_depth"), *values, *[f"more_{v}" for v in values])
    rows = rows.repartition("c_conv", "c_depth").sortWithinPartitions("c_conv", "c_depth")
    return rows.mapInArrow(lambda batches: _streamed(batches, done), kinds)


def subtree_sums(nodes: DataFrame, rows: DataFrame, values: list[str], task_nodes: int = TASK_NODES) -> DataFrame:
    """(node, values): each value summed over the node's subtree; ``nodes`` (node, parent, weight, values), ``rows`` (conv, depth, node, parent)."""
    top = nodes.where("parent is null").select("node").first()
    if top is None:
        return nodes.select("node", *values)
    # The rows that say what stands on the way to a node; below the root they have a parent.
    paths = rows.where("parent is not null").select(F.col("conv").alias("l_conv"), F.col("depth").alias("l_depth"), F.col("node").alias("l_node"), F.col("parent").alias("l_parent"))
    name = "struct<conv_id:bigint,depth:bigint>"
    state = nodes.select("node", "parent", "weight", *values, *[F.lit(0).cast("long").alias(f"more_{v}") for v in values], F.struct(F.lit(top.node.conv_id).alias("conv_id"), F.lit(0).cast("long").alias("depth")).cast(name).alias("comp"))
    finished = []
    total = nodes.count()
    while total:
        deepest = F.max_by(F.struct("node", "weight"), F.struct(F.length(F.bin("weight")), F.col("node.depth")))
        comps = written(state.groupBy("comp").agg(F.count("*").alias("n"), deepest.alias("z")), "trie-components")
        state = join_counted(state, comps.withColumn("size", F.col("n")), "comp", total)
        small = state.where(F.col("size") <= task_nodes).drop("size", "z")
        finished.append(_summed_here(small, values).select(F.struct("conv_id", "depth").alias("node"), *values))
        if not comps.where(F.col("n") > task_nodes).limit(1).count():
            break
        large = state.where(F.col("size") > task_nodes).select("*", F.col("z.node").alias("zn"), F.col("z.weight").alias("zw")).drop("z")
        d, zd = F.col("node.depth"), F.col("zn.depth")
        # Below: the smallest member's node just under the centroid.  Above: the centroid's smallest member's node just under this one.
        same = F.col("node.conv_id") == F.col("zn.conv_id")
        l_conv = F.when(same | (d == zd), None).when(d > zd, F.col("node.conv_id")).otherwise(F.col("zn.conv_id"))
        large = large.withColumn("l_conv", l_conv).withColumn("l_depth", F.least(d, zd) + 1).join(paths, ["l_conv", "l_depth"], "left")
        below = (d > zd) & (same | F.coalesce(F.col("l_parent") == F.col("zn"), F.lit(False)))
        above = (d < zd) & (same | F.coalesce(F.col("l_parent") == F.col("node"), F.lit(False)))
        child = F.when(same, F.struct("node.conv_id", (zd + 1).alias("depth"))).otherwise(F.col("l_node"))
        place = F.when(F.col("node") == F.col("zn"), "centroid").when(below, "below").when(above, "above").otherwise("beside")
        large = written(large.withColumn("place", place).withColumn("child", child).drop("l_conv", "l_depth", "l_node", "l_parent"), "trie-split")
        inside = F.col("place").isin("centroid", "below")
        sums = large.where(inside).groupBy("comp").agg(F.max("size").alias("n"), *[F.sum(v).alias(f"sum_{v}") for v in values])
        raised = join_counted(large.where(F.col("place").isin("centroid", "above")), written(sums, "trie-sums"), "comp", total)
        raised = raised.withColumns({f"more_{v}": F.col(f"more_{v}") + F.col(f"sum_{v}") for v in values})
        raised = written(raised.drop(*[f"sum_{v}" for v in values]), "trie-raised")
        finished.append(raised.where("place = 'centroid'").select("node", *[F.col(f"more_{v}").alias(v) for v in values]))
        upper = raised.where("place = 'above'").withColumn("weight", F.col("weight") - F.col("zw"))
        lower = large.where("place = 'below'").withColumn("comp", F.col("child").cast(name))
        columns = ["node", "parent", "weight", *values, *[f"more_{v}" for v in values], "comp"]
        state = written(upper.select(*columns).unionByName(lower.select(*columns)).unionByName(large.where("place = 'beside'").select(*columns)), "trie-state")
        total = state.count()
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return written(out, "trie-subtrees")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv): the ids of each node in ascending order, joined by commas.

    Ids are sorted in ranges, where they become pieces of text, and the pieces of a node are hashed one after another as they are read.
    """
    ranges = max(ends.sparkSession.sparkContext.defaultParallelism, -(-ends.count() // ROWS_PER_RANGE))
    rows = ends.select(F.col("node.conv_id").alias("c_conv"), F.col("node.depth").alias("c_depth"), "conv")
    rows = rows.repartitionByRange(ranges, "c_conv", "c_depth", "conv").sortWithinPartitions("c_conv", "c_depth", "conv")

    def pieces(batches):
        for b in batches:
            if b.num_rows:
                a, d, conv = (b.column(c).to_numpy() for c in ("c_conv", "c_depth", "conv"))
                starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(a)], pa.int32()), pc.cast(b.column("conv"), pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(d[starts]), pa.array(conv[starts]), pc.binary_join(lists, ",")], names=["c_conv", "c_depth", "first", "piece"])

    def digest(batches):
        name, h = None, None
        for b in batches:
            out = []
            for a, d, piece in zip(*(b.column(c).to_pylist() for c in ("c_conv", "c_depth", "piece")), strict=True):
                if (a, d) != name:
                    if h:
                        out.append((*name, h.hexdigest()))
                    name, h = (a, d), hashlib.sha256()
                else:
                    h.update(b",")
                h.update(piece.encode())
            yield batch_of(out)
        if h:
            yield batch_of([(*name, h.hexdigest())])

    def batch_of(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["c_conv", "c_depth", "ends_sha256"])

    found = rows.mapInArrow(pieces, "c_conv long, c_depth long, first long, piece string")
    found = found.repartition("c_conv", "c_depth").sortWithinPartitions("c_conv", "c_depth", "first")
    found = found.mapInArrow(digest, "c_conv long, c_depth long, ends_sha256 string")
    return found.select(F.struct(F.col("c_conv").alias("conv_id"), F.col("c_depth").alias("depth")).alias("node"), "ends_sha256")


def report(conversations: DataFrame, base: Column, lead: Column, most: int, task_nodes: int = TASK_NODES) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes = rebuilt(ordered(conversations), base, lead, most)
    nodes, rows = trie(prefixes)
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    sums = subtree_sums(nodes.drop("n_convs", "n_children", "chars"), rows, ["n_leaves", "saved_tokens"], task_nodes)
    ends = ends_digest(rows.where("left = 1").select("node", "conv"))
    out = nodes.select("node", "parent", "n_convs", "n_children").join(sums, "node").join(ends, "node", "left")
    out = out.select(
        "node.conv_id", "node.depth", F.col("parent.conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )
    return out
