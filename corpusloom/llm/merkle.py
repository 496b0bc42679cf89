"""A manifest of a dataset as Merkle trees, one for each group of rows and one over their roots, with a proof for every row.

Leaves are hashes of whole rows.  They are numbered in the order of the groups
and of the ids within by a range sort, and trees are built some levels at a
time in blocks of neighbouring nodes, so that no task has more than a block of
a group.  Every node then holds its siblings on the way to its parent, and
pointer jumping makes the proofs: joining the nodes with themselves by ancestor
doubles how far each has come and puts the two segments together, until every
leaf has come to the root.  Nodes near a root have very many nodes under them;
they are dealt out in the joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, join_few, numbered

BLOCK = 1000  # leaves of a block at most; blocks have as many levels as that allows
TOP = 32  # heights from here on are those of the tree over the groups
SEGMENT = "array<struct<left:binary,right:binary>>"


def field(value: Column | str) -> Column:
    """A value as it goes into a hash: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column | str) -> Column:
    """The hash of a row, as binary."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def fold(digest: Column, proof: Column) -> Column:
    """The root, in hex, that a leaf (binary) and its proof lead to."""
    return F.aggregate(proof, hexed(digest), lambda h, step: F.sha2(F.concat(hexed(step["left"]), h, hexed(step["right"])), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof in hex, end to end."""
    return F.array_join(F.transform(proof, lambda step: hexed(F.concat(step["left"], step["right"]))), "")


def proofs(docs: DataFrame, values: list[str], group: str, id_column: str, fanout: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, leaf, subroot, root (binary), proof and the columns ``keep``, which should be small, for every row.

    A leaf is the hash of the columns ``values``.  In each group the leaves
    ascend by id, null first, and equal ids by leaf; every ``fanout`` neighbouring
    nodes become the hash of their digests in hex until one is left.  Groups ascend bytewise, null first, and what is left of each is
    treated alike.  A proof has the other digests of a node's run, left and
    right of it, for every level up to the root; a node that is alone has none
    on either side, and is hashed nevertheless.  Equal rows are leaves of their
    own.  A single row is its own root.  Other columns, whatever their names,
    aren't looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    passed = F.struct(F.col(id_column).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    own = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("key"), F.col(id_column).alias("id"), leaf(*values).alias("h"), passed.alias("passed"))
    placed = numbered(cut(own, "merkle-leaves"), ["key", "id", "h"], "merkle-sorted")
    trees = cut(placed.groupBy("key").agg(F.min("place").alias("tree"), F.count("*").alias("n")).withColumn("size", F.col("n")), "merkle-trees")
    rows = join_few(placed, trees, ["key"], ["place"]).select(
        "tree", F.col("size").alias("n"), (F.col("place") - F.col("tree")).alias("pos"), (F.col("place") * 64).alias("node"), F.lit(1).cast("long").alias("leaves"), "h", F.struct("tree", "h", "passed").alias("carry")
    )
    nodes, roots = _build(rows, fanout, 0)
    above = numbered(roots, ["tree"], "merkle-subroots")
    total = above.agg(F.count("*")).first()[0]
    above = above.select(F.lit(-1).cast("long").alias("tree"), F.lit(total).cast("long").alias("n"), F.col("place").alias("pos"), "node", "leaves", "h", "carry")
    more, ends = _build(above, fanout, TOP)
    root = ends.first()
    fields = [("id", docs.schema[id_column].dataType.simpleString()), *[(x, "binary") for x in ("leaf", "subroot", "root")], ("proof", SEGMENT), *[(c, docs.schema[c].dataType.simpleString()) for c in keep]]
    if root is None:
        return spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in fields))
    segment = F.array(F.struct("left", "right")).alias("segment")
    links = nodes.unionByName(more).select("node", F.col("parent").alias("ancestor"), segment, "leaves", "carry")
    if total == 1 and root["carry"] is not None:  # one row in all
        links = ends.select("node", F.col("node").alias("ancestor"), F.array().cast(SEGMENT).alias("segment"), "leaves", "carry")
    # leaves learn the root of their group while their segments are short
    subroots = cut(roots.select("tree", F.col("h").alias("subroot"), F.col("leaves").alias("n")), "merkle-roots")
    own = join_few(links.where("carry is not null").withColumn("tree", F.col("carry.tree")), subroots, ["tree"], ["node"]).drop("tree")
    proved = _jumped(own.unionByName(links.where("carry is null").withColumn("subroot", F.lit(None).cast("binary"))), root["node"], fanout)
    out = [F.col("carry.passed.id"), F.col("carry.h"), F.col("subroot"), F.lit(bytes(root["h"])), F.col("segment"), *[F.col(f"carry.passed.k{i}") for i in range(len(keep))]]
    return proved.select(*[c.alias(n) for c, (n, _) in zip(out, fields, strict=True)])


def _jumped(links: DataFrame, root: int, fanout: int) -> DataFrame:
    """carry, subroot and segment of every leaf, once its segment goes up to the root.

    ``links`` has each node but the root with its parent as ancestor.  After a
    round with distance d only nodes of the trees whose height d divides, and
    those of the tree on top, are still jumped from or to.
    """
    links, distance, finished = cut(links, "merkle-links"), 1, []
    height = F.col("node").bitwiseAND(F.lit(63))
    while True:
        arrived = F.col("ancestor") == root
        finished.append(links.where(arrived & F.col("carry").isNotNull()).select("carry", "subroot", "segment"))
        if links.where(~arrived & F.col("carry").isNotNull()).isEmpty():
            return reduce(DataFrame.unionByName, finished)
        used = lambda d: (height % d == 0) | (height >= TOP)
        under = F.least("leaves", F.lit(min(fanout**min(distance, 64), 1 << 62)).cast("long")).alias("n")
        ahead = links.where((height > 0) & used(distance)).select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"), F.col("segment").alias("more"), under)
        waiting = links.where(~arrived & used(2 * distance))
        joined = join_few(waiting, ahead, ["ancestor"], ["node"]).select("node", F.col("next").alias("ancestor"), F.concat("segment", "more").alias("segment"), "leaves", "carry", "subroot")
        links, distance = cut(joined.unionByName(links.where(arrived & (height > 0) & used(2 * distance) & F.col("carry").isNull())), "merkle-links"), 2 * distance


def _build(rows: DataFrame, fanout: int, offset: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of trees but their roots, each with its parent and siblings; and the roots.

    ``rows`` has tree, n (how many rows the tree has), pos (a row's place in it), node, leaves, h and carry, which
    stays with the row.  A node's number is 64 times the place of its first leaf, plus its height, or ``offset`` and its height.
    """
    levels = 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    columns = ["tree", "n", "pos", "node", "leaves", "h", "carry"]
    fields = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns] + ["parent long", "left binary", "right binary"])
    rows, level, made, roots = cut(rows.select(*columns), "merkle-level"), 0, [], []
    while True:
        alive = F.col("n") > fanout**level
        roots.append(rows.where(~alive))
        rows = rows.where(alive)
        if rows.isEmpty():
            break
        dealt = rows.withColumn("block", F.floor(F.col("pos") / fanout**levels)).repartition("tree", "block").sortWithinPartitions("tree", "pos").select(*columns)
        done = cut(dealt.mapInArrow(_blocks(fanout, level, levels, offset), fields), "merkle-level")
        made.append(done.where("parent is not null"))
        rows, level = done.where("parent is null").select(*columns), level + levels
    nothing = [] if made else [rows.sparkSession.createDataFrame([], fields)]
    return reduce(DataFrame.unionByName, made + nothing), reduce(DataFrame.unionByName, roots)


def _blocks(fanout: int, level: int, levels: int, offset: int):
    """Rows come by tree and place; blocks that a batch cuts are held back until they are whole."""

    def above(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        tree, n, pos, node, leaves = (rows.column(c).to_numpy() for c in range(5))
        digests, carry = rows.column(5).to_pylist(), rows.column(6).combine_chunks()
        none = lambda k, kind: pa.nulls(k, kind)
        for j in range(levels + 1):
            ends = np.full(len(n), j == levels) | (n <= fanout ** (level + j))
            if ends.any():
                at = np.flatnonzero(ends)
                yield [*(pa.array(x[at]) for x in (tree, n, pos, node, leaves)), pa.array([digests[i] for i in at], pa.binary()), carry.take(pa.array(at)), none(len(at), pa.int64()), none(len(at), pa.binary()), none(len(at), pa.binary())]
                go = np.flatnonzero(~ends)
                tree, n, pos, node, leaves, carry = *(x[go] for x in (tree, n, pos, node, leaves)), carry.take(pa.array(go))
                digests = [digests[i] for i in go]
            if not len(n):
                return
            run = pos // fanout
            starts = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (run[1:] != run[:-1])])
            stops = np.r_[starts[1:], len(n)]
            parents = (node[starts] >> 6 << 6) + offset + level + j + 1
            left, right, hashed = [], [], []
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                left += [b"".join(digests[a:i]) for i in range(a, b)]
                right += [b"".join(digests[i + 1 : b]) for i in range(a, b)]
                hashed.append(hashlib.sha256(b"".join(digests[a:b]).hex().encode()).digest())
            yield [*map(pa.array, (tree, n, pos, node, leaves)), pa.array(digests, pa.binary()), carry, pa.array(np.repeat(parents, stops - starts)), pa.array(left, pa.binary()), pa.array(right, pa.binary())]
            tree, n, pos, node, leaves, digests, carry = tree[starts], n[starts], run[starts], parents, np.add.reduceat(leaves, starts), hashed, none(len(starts), carry.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [*batch.schema.names, "parent", "left", "right"]
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            tree, block = rows.column(0).to_numpy(), rows.column(2).to_numpy() // fanout**levels
            whole = int(np.flatnonzero((tree != tree[-1]) | (block != block[-1]))[-1]) + 1 if ((tree != tree[-1]) | (block != block[-1])).any() else 0
            held = rows.slice(whole)
            for made in above(rows.slice(0, whole)) if whole else ():
                yield pa.RecordBatch.from_arrays(made, names)
        if held is not None:
            for made in above(held):
                yield pa.RecordBatch.from_arrays(made, names)

    return run
