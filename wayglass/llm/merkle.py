"""A Merkle manifest of a table: a forest with one tree for each value of a column, under one root, and a proof for every row.

A leaf is the digest of a row's columns. In a tree, leaves ascend by id; every `arity` consecutive nodes (the last run may have fewer, even one) become the digest of theirs
until one is left, the subroot. The subroots, ordered by their column (null first, then by UTF-8 bytes), make the root in the same way. Digests are lowercase hex SHA-256
of the concatenated hex of their parts.

The trees are walked by blocks: `arity ** BLOCK_HEIGHT` consecutive leaves are one group, whose recursive postorder returns the digest of each subtree and, while it unwinds,
appends the siblings met at that level to the paths of the leaves inside. As blocks are aligned, each is a whole subtree, so the block roots are the leaves of
another distributed traversal, and so on until every tree is one block. A leaf's path is then the one in its block followed by the path of its block's root. Positions come from a
sort by ranges and counts of each range, so no task sorts or holds a tree.

Defined cases: a null column is '-' in the leaf and a null group a tree of its own, before all others; null ids come first; rows that are equal in group and id ascend by their leaf; equal rows are leaves of their
own, with one digest and a path each; a tree of one leaf has the leaf as its subroot, and a forest of one tree has its subroot as the root; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayglass.llm.shared import fitting, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one block spans: 1,024 leaves with an arity of 2.
BLOCK_HEIGHT = 10
#: Rows of counts and of block paths that are broadcast; beyond it they are shuffled.
BROADCAST_ROWS = 10_000
PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """'-' for null, else the UTF-8 bytes' count, ':' and the value."""
    as_text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def placed(rows: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """A written table of rows with at (0, 1, ... in the tree by order) and n, the tree's number of rows. Equal rows are dealt over ranges by where they were read."""
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*tree, *order, "__tie").sortWithinPartitions(*tree, *order, "__tie")
    run = written(ranged.drop("__tie").withColumn("__row", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("__row", 33).alias("__part")
    counts = run.groupBy(*tree, part).agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    over = Window.partitionBy(*tree)
    before = F.coalesce(F.sum("__n").over(over.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(counts.select(*tree, "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(over).alias("n")), "offsets")
    return run.withColumn("__part", part).join(fitting(offsets, BROADCAST_ROWS), [*tree, "__part"]).withColumn("at", F.col("__row") + F.col("__shift")).drop("__row", "__part", "__shift")


def height_of(n: int, arity: int) -> int:
    height = 0
    while arity**height < n:
        height += 1
    return height


def walk(leaves: list[str], height: int, arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root of a block and, for each leaf, what stands left and right of its node at each level, from the leaves up."""
    paths: list[list[tuple[str, str]]] = [[] for _ in leaves]

    def visit(first: int, height: int) -> str:
        if height == 0:
            return leaves[first]
        step = arity ** (height - 1)
        starts = range(first, min(first + arity * step, len(leaves)), step)
        digests = [visit(start, height - 1) for start in starts]
        for i, start in enumerate(starts):
            beside = "".join(digests[:i]), "".join(digests[i + 1 :])
            for path in paths[start : start + step]:
                path.append(beside)
        return sha256("".join(digests))

    return visit(0, height), paths


def traverse(nodes: DataFrame, arity: int, block_height: int) -> DataFrame:
    """nodes (tree, at, n, digest, ...) with block (its number), path and top, the root of the block."""
    size = arity**block_height

    def block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        top, paths = walk(rows["digest"].to_pylist(), min(block_height, height_of(rows["n"][0].as_py(), arity)), arity)
        paths = pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        return rows.append_column("path", paths).append_column("top", pa.array([top] * len(rows), pa.string()))

    keyed = nodes.withColumn("block", F.floor(F.col("at") / size).cast("long"))
    return keyed.groupBy("tree", "block").applyInArrow(block, T.StructType([*keyed.schema, T.StructField("path", PATH), T.StructField("top", T.StringType())]))


def forest(nodes: DataFrame, arity: int, block_height: int) -> tuple[DataFrame, DataFrame]:
    """Of nodes (tree, at, n, digest, ...): each with its path to the root of its tree, and the trees' roots (tree, root)."""
    size, levels, rest = arity**block_height, [], nodes
    while True:
        levels.append(written(traverse(rest, arity, block_height), "blocks"))
        tops = levels[-1].where(F.col("at") % size == 0)
        rest = tops.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("top").alias("digest"))
        if rest.where("n > 1").isEmpty():
            break
    above = levels[-1]  # from the top level down
    for level in reversed(levels[:-1]):
        upper = fitting(above.select("tree", F.col("at").alias("block"), F.col("path").alias("upper")), BROADCAST_ROWS)
        above = level.join(upper, ["tree", "block"]).withColumn("path", F.concat("path", "upper")).drop("upper")
    return above.select(*nodes.columns, "path"), rest.select("tree", F.col("digest").alias("root"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda digest, beside: F.sha2(F.concat(beside["left"], digest, beside["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda beside: F.concat(beside["left"], beside["right"])), ""), 256)


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", tree_col: str = "lang", arity: int = 2, block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """doc_id, tree (the group), leaf, changed_leaf (the leaf with some columns replaced by `changed`), path (all levels up to the root), subroot and root of each row."""
    # Trees are named so that null ('') comes before every value ('=...').
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))
    other = F.lit(None).cast("string")
    if changed:
        differs = reduce(Column.__or__, [~F.col(c).eqNullSafe(v) for c, v in changed.items()])
        other = F.when(differs, leaf_of([changed.get(c, F.col(c)) for c in columns]))  # the text is read again for these rows only
    own = leaf_of([F.col(c) for c in columns])
    light = written(docs.select(tree.alias("tree"), F.col(id_col).alias("doc_id"), own.alias("digest"), other.alias("changed")), "leaves")  # else the ranges' sample hashes all texts too
    leaves = placed(light, ["tree"], ["doc_id", "digest"])
    rows, subroots = forest(leaves, arity, block_height)
    trees = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), ["tree"], ["name"])
    tops, roots = forest(trees, arity, block_height)
    tops = tops.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("upper")).crossJoin(F.broadcast(roots.select("root")))  # one row
    return rows.join(fitting(written(tops, "trees"), BROADCAST_ROWS), "tree").select(
        "doc_id", F.expr("if(tree = '', null, substring(tree, 2))").alias("tree"), F.col("digest").alias("leaf"), F.coalesce("changed", "digest").alias("changed_leaf"),
        F.concat("path", "upper").alias("path"), "subroot", "root",
    )
