"""Merkle manifest of a dataset: a tree for each language, and one over their roots; with a proof for each row.

A node of eight children at most is the hash of their digests in order. Nodes are dealt into aligned blocks of
FAN ** LEVELS. A block is traversed by itself, depth first and postorder: a call returns the digest of its subtree, and
on the way back appends the digests beside each child to the proofs of the leaves below it. The roots of the blocks,
one row for each, are the leaves of the next traversal, until one is left for each language. The roots of the
languages make a tree in the same way. Then the proofs go down: a block is traversed together with the one row that
holds the proof of its root, which each of its leaves takes over after its own part.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize, private

FAN = 8
#: Levels of a block: 512 leaves, and at most 3 * 7 siblings for each.
LEVELS = 3
BLOCK = FAN**LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: left and right: for each level from the leaf up, the digests before and after it in its run, joined.
PROOF = "left array<string>, right array<string>, subroot string, root string"


def measured(value: Column) -> Column:
    """- for null, otherwise the number of UTF-8 bytes, a colon and the value."""
    shown = value.cast("string")
    return F.when(shown.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*[measured(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def unwind(leaves: list[str], levels: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The digest of a block with so many levels above its leaves, and each leaf's (left, right) siblings, from the leaf up."""
    proofs: list[list[tuple[str, str]]] = [[] for _ in leaves]

    def visit(first: int, end: int, level: int) -> str:
        if level == 0:
            return leaves[first]
        size = FAN ** (level - 1)
        starts = range(first, end, size)
        below = [visit(at, min(at + size, end), level - 1) for at in starts]
        for i, at in enumerate(starts):
            beside = "".join(below[:i]), "".join(below[i + 1 :])
            for leaf in range(at, min(at + size, end)):
                proofs[leaf].append(beside)
        return digest("".join(below))

    return visit(0, len(leaves), levels), proofs


def numbered(nodes: DataFrame, name: str) -> DataFrame:
    """nodes (tree, ..., key columns in order) with position, gapless from 0 in each tree, and n, the tree's number of nodes.

    Rows are sorted by ranges of the whole order, so a tree of any size is spread over all tasks; what is joined to them
    is the number of nodes that each tree has in each range. The last key is a row's own number, so that even rows that
    are equal otherwise fall into several ranges.
    """
    keys = ["tree", *sorted(c for c in nodes.columns if c.startswith("key"))]
    ordered = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    stored = materialize(ordered.drop(*keys[1:]), name)
    part = F.shiftright("at", 33)
    runs = stored.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    # of one tree there are as many ranges as tasks, at most
    of_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("size").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("tree", "part", "first", F.sum("size").over(of_tree).alias("n"), before.alias("before"))
    joined = stored.withColumn("part", part).join(starts, ["tree", "part"])
    return joined.withColumn("position", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("position") / BLOCK).cast("long"))


def block_leaves(table) -> tuple[list[int], list[str], int]:
    """The order of a block's rows, their digests in that order, and the levels of its traversal."""
    import numpy as np

    order = np.argsort(table.column("position").to_numpy(), kind="stable")
    return order, table.column("node").take(order).to_pylist(), min(LEVELS, depth(table.column("n")[0].as_py()))


def roots_of(nodes: DataFrame) -> DataFrame:
    """(tree, position, n, node): the root of each block of nodes (tree, position, n, node), a node of the next traversal."""

    def run(table):
        import pyarrow as pa

        _, leaves, levels = block_leaves(table)
        root, _ = unwind(leaves, levels)
        n = table.column("n")[0].as_py()
        return pa.table({"tree": table.column("tree")[:1], "position": table.column("block")[:1], "n": pa.array([-(-n // BLOCK)], pa.int64()), "node": pa.array([root])})

    return in_blocks(nodes.select("tree", "position", "n", "node")).groupBy("tree", "block").applyInArrow(run, "tree string, position long, n long, node string")


def proved(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes with PROOF, from the proofs of the roots of their blocks: above (tree, position, PROOF)."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in nodes.schema)}, {PROOF}"
    top = above.select(F.col("tree").alias("tree"), F.col("position").alias("block"), "left", "right", "subroot", "root")

    def run(table, upper):
        import pyarrow as pa

        order, leaves, levels = block_leaves(table)
        _, proofs = unwind(leaves, levels)
        left, right = (upper.column(c)[0].as_py() for c in ("left", "right"))
        strings = pa.list_(pa.string())
        sides = [pa.array([[*(x[side] for x in p), *more] for p in proofs], strings) for side, more in ((0, left), (1, right))]
        rest = [pa.array([upper.column(c)[0].as_py()] * len(leaves), pa.string()) for c in ("subroot", "root")]
        kept = table.drop_columns(["block"]).take(order)
        return pa.Table.from_arrays([*kept.columns, *sides, *rest], [*kept.column_names, "left", "right", "subroot", "root"])

    return in_blocks(nodes).groupBy("tree", "block").cogroup(top.groupBy("tree", "block")).applyInArrow(run, schema)


def climbed(nodes: DataFrame, name: str) -> list[DataFrame]:
    """nodes, and the nodes of each further traversal, until every tree has a single one."""
    rounds = [nodes]
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        nodes = materialize(roots_of(nodes), f"{name}-{len(rounds)}")
        rounds.append(nodes)
    return rounds


def descended(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The proofs of the first of these tables, from those of the last one's nodes (tree, position, PROOF)."""
    for nodes in reversed(rounds[:-1]):
        above = proved(nodes, above)
    return above


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """For each row of docs: doc_id, leaf, tampered_leaf, left, right, subroot, root.

    left and right hold the siblings of each level, from the leaf's run by its language's root up to the root of all;
    folded() recomputes the root from a leaf and them. tampered is a text (a column over docs) to make a second leaf of,
    which takes no part in the tree; null where it is null, or without it.

    Leaves of a language go by doc_id, null first; those that share one by their digest, and equal ones are
    interchangeable: they get the same set of proofs. Languages go by their UTF-8 bytes, null first, and null and ''
    are two. Null fields are hashed as such. Long texts are hashed where they are read, and only digests are shuffled,
    twice: once for the roots, once for the proofs. A block is 512 leaves, however large a language. An empty table
    gives an empty one; further columns are ignored, whatever their names.
    """
    own = private(docs.columns)
    changed = tampered if tampered is not None else F.lit(None).cast("string")
    fields = docs.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in zip(FIELDS, ["long", "string", "string", "long", "string"])], changed.alias(own("changed")))
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "lang"))
    other = F.when(F.col(own("changed")).isNotNull(), leaf_digest(F.col(own("changed"))))
    leaves = fields.select(tree.alias("tree"), F.col("doc_id").alias("key1"), leaf_digest(F.col("text")).alias("node"), other.alias("tampered_leaf"))
    # stored first: ranges are found from the digests, not by hashing all texts once more
    leaves = materialize(leaves.withColumn("key3", F.monotonically_increasing_id()), "manifest-leaves")
    leaves = numbered(leaves.withColumns({"key2": F.col("node"), "doc_id": F.col("key1")}), "manifest-order")
    trees = climbed(leaves, "manifest-tree")
    subroots = trees[-1].select(F.lit("all").alias("tree"), F.col("tree").alias("key1"), F.col("tree").alias("of"), "node")
    tops = climbed(numbered(subroots, "manifest-subroots"), "manifest-top")

    none = F.array().cast("array<string>")
    whole = tops[-1].select("tree", "position", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    if len(tops) > 1:
        of_trees = descended(tops, whole).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("position"), "left", "right", F.col("node").alias("subroot"), "root")
    else:
        of_trees = tops[0].select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("position"), none.alias("left"), none.alias("right"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    of_trees = materialize(of_trees, "manifest-top-proofs")
    if len(trees) > 1:
        found = descended(trees, of_trees)
    else:
        found = leaves.join(of_trees.drop("position"), "tree")
    return found.select("doc_id", F.col("node").alias("leaf"), "tampered_leaf", "left", "right", "subroot", "root")


def proof_digest(left: Column, right: Column) -> Column:
    """The hash of all siblings, level by level, each from left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def folded(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), leaf, lambda node, s: F.sha2(F.concat(s["a"], node, s["b"]), 256))


def verify(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf, where there is one) and verified (folded_root equals root)."""
    made = manifest(docs, tampered)
    fold = folded(F.coalesce("tampered_leaf", "leaf"), F.col("left"), F.col("right"))
    out = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("left"), F.col("right")).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_cased_thirds(doc_id: Column, text: Column) -> Column:
    """The tampering of the check: the text with A-Z in lower case where 3 divides the CRC-32 of the decimal doc_id, otherwise null."""
    import string

    third = F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 0
    return F.when(third, F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
