"""Merkle manifest of a dataset, with proofs by checkpoint and recomputation. DataFrame functions only.

A row's leaf is the hash of its fields. Per source, leaves in the order of doc_id form a tree in which every three neighbours
have one parent (the last of a level fewer); the sources' roots form the same kind of tree above. Only every few levels are
stored: a stored row is an aligned subtree with its lowest nodes, at most FAN ** LEVELS of them. The nodes between two stored
levels are computed from those when they are needed, for the root of the subtree as for the siblings in a proof, and are not
kept. So each stored level is a small fraction of the one below, and a proof needs one join for every LEVELS levels.

Nodes are lower-case hexadecimal SHA-256; a parent is the hash of its children's text, one behind the other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import discard, positions, stored

#: The fields of a leaf in order, and children of a node.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
#: A level is stored after so many that are not.
LEVELS = 3
BLOCK = FAN**LEVELS


@dataclass
class Tree:
    """Stored levels of the trees of all groups, lowest first (group columns, position, total, nodes: an array of node and the
    rows' own columns), and their roots (group columns, root, level: the last stored level the group is in)."""

    groups: tuple[str, ...]
    levels: list[DataFrame]
    roots: DataFrame


@dataclass
class Manifest:
    sources: Tree
    top: Tree

    def root(self) -> DataFrame:
        """One row (root); none for a table without rows."""
        return self.top.roots.select("root")

    def discard(self) -> None:
        for tree in (self.sources, self.top):
            for table in (*tree.levels, tree.roots):
                discard(table)


def leaf(fields: Sequence[Column]) -> Column:
    """Hash of a row: its fields as UTF-8 byte count, colon and value, one behind the other; a null is '-'."""
    texts = [value.cast("string") for value in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts)), 256)


def _with_interior(blocks: DataFrame) -> DataFrame:
    """Recomputes the nodes above the stored ones: columns level0, level1 ... up to the subtree's root, and height: all LEVELS
    levels for a subtree below others, else those up to the one node that remains."""
    heights = " ".join(f"WHEN total <= {FAN**levels} THEN {levels}" for levels in range(LEVELS))
    made = blocks.withColumn("height", F.expr(f"CASE {heights} ELSE {LEVELS} END")).withColumn("level0", F.expr("nodes.node"))
    for level in range(1, LEVELS + 1):
        below = f"level{level - 1}"
        parents = f"transform(sequence(0, (size({below}) - 1) div {FAN}), run -> sha2(array_join(slice({below}, int(run * {FAN} + 1), {FAN}), ''), 256))"
        made = made.withColumn(f"level{level}", F.expr(f"CASE WHEN height >= {level} THEN {parents} ELSE {below} END"))
    return made


def build(nodes: DataFrame, groups: Sequence[str], own: Sequence[str] = ()) -> Tree:
    """nodes: group columns, position (0, 1, 2 ... within the group), total (the group's nodes), node, and `own` columns to be
    kept beside them. Stores the levels: one pass for every LEVELS levels of the tallest tree."""
    groups, levels, roots, level = tuple(groups), [], None, 0
    while True:
        block = F.expr(f"position div {BLOCK}")
        each = F.array_sort(F.collect_list(F.struct("position", "node", *(own if level == 0 else ()))))
        blocks = nodes.groupBy(*groups, block.alias("block")).agg(F.max("total").alias("total"), each.alias("nodes"))
        levels.append(blocks := stored(blocks.withColumnRenamed("block", "position"), f"level{level}"))
        top = _with_interior(blocks).select(*groups, "position", "total", F.col(f"level{LEVELS}")[0].alias("node"))
        ended = top.where(F.col("total") <= BLOCK).select(*groups, F.col("node").alias("root"), F.lit(level).alias("level"))
        roots = ended if roots is None else roots.unionByName(ended)
        if blocks.where(F.col("total") > BLOCK).isEmpty():
            return Tree(groups, levels, stored(roots, "roots"))
        total = F.expr(f"(total + {BLOCK - 1}) div {BLOCK}")
        nodes, level = top.where(F.col("total") > BLOCK).withColumn("total", total), level + 1


def _paths_in_block() -> Column:
    """For each stored node of a subtree: the node, and its siblings, one entry for each level: what stands left of the node on
    the way and what stands right of it."""
    steps = []
    for level in range(LEVELS):
        place = f"(at div {FAN**level})"
        left = f"array_join(slice(level{level}, int({place} - {place} % {FAN} + 1), int({place} % {FAN})), '')"
        right = f"array_join(slice(level{level}, int({place} + 2), int({FAN - 1} - {place} % {FAN})), '')"
        steps.append(f"named_struct('left', {left}, 'right', {right})")
    return F.expr(f"transform(nodes, (node, at) -> named_struct('of', node, 'own', slice(array({', '.join(steps)}), 1, height)))")


def paths(tree: Tree, above: DataFrame | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """above: the group columns, path (siblings above the group's root), root (what the paths lead to) and `carried` columns, a
    row for each group; None for a tree without groups, as nothing is above. Returns a row for each lowest node: group columns,
    position, path (an array of left and right siblings, lowest level first), root, node, the tree's own columns, and the
    carried ones.

    Goes down the stored levels; at each, the siblings above a subtree are joined to it, its interior is computed anew, and
    every stored node gets its path."""
    groups, carried, found, heads = tree.groups, ("root", *carried), None, None
    if above is not None:
        heads = tree.roots.drop("root").alias("r").join(above.alias("a"), [F.col(f"r.{g}").eqNullSafe(F.col(f"a.{g}")) for g in groups])
        heads = heads.select(*(f"r.{g}" for g in groups), F.expr("bigint(0)").alias("position"), "path", *carried, "level")
    for level in reversed(range(len(tree.levels))):
        blocks, upper = _with_interior(tree.levels[level]).withColumn("first", F.expr(f"position * {BLOCK}")), found
        inside = ("first", "nodes", "height", *(f"level{k}" for k in range(LEVELS)))
        if heads is not None:
            ended = heads.where(f"level = {level}").drop("level")
            upper = ended if found is None else ended.unionByName(found.select(ended.columns))
        if upper is None:  # the one subtree on top of all
            joined = blocks.select(*inside, F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("above"), F.expr(f"level{LEVELS}[0]").alias("root"))
        else:
            same = [blocks["position"] == upper["position"], *(blocks[g].eqNullSafe(upper[g]) for g in groups)]
            joined = blocks.join(upper, same).select(*(blocks[c] for c in (*groups, *inside)), upper["path"].alias("above"), *(upper[c] for c in carried))
        each = joined.select(*groups, "first", "above", *carried, F.posexplode(_paths_in_block()).alias("at", "entry"))
        fields = [f"entry.of.{c}" for c in tree.levels[level].schema["nodes"].dataType.elementType.names if c != "position"]
        found = each.select(*groups, F.expr("first + at").alias("position"), F.expr("concat(entry.own, above)").alias("path"), *fields, *carried)
    return found


def manifest(docs: DataFrame, claimed_text: Column | None = None) -> Manifest:
    """docs: doc_id, source, lang, n_chars, text; other columns are left aside. Stores the trees of all sources and the tree of
    the sources' roots (ordered by source, null first).

    claimed_text: a text that stands for the row's own, as a copy of the dataset holds it; the leaf with it (null where the
    same) is kept beside the row's leaf, for proofs to be tried on. Leaves ascend by doc_id, null first; rows of one doc_id by
    leaf. A null field is '-', which an empty one is not. An empty table has no root."""
    fields = [F.col(c) for c in FIELDS]
    rows = docs.select("doc_id", "source", leaf(fields).alias("node"), *([leaf([*fields[:-1], claimed_text]).alias("claimed")] if claimed_text is not None else []))
    if claimed_text is not None:
        rows = rows.withColumn("claimed", F.when(F.col("claimed") != F.col("node"), F.col("claimed")))
    rows = stored(rows, "leaves")  # so that texts are read and hashed once
    placed = positions(rows, [F.col("doc_id"), F.col("node")], ("source",), total="total")
    sources = build(placed, ("source",), ["doc_id", *rows.columns[3:]])
    discard(rows)
    discard(placed)
    subroots = positions(sources.roots.select("source", F.col("root").alias("node")), [F.col("source")], (), total="total")
    return Manifest(sources, build(subroots, (), ("source",)))


def proofs(made: Manifest) -> DataFrame:
    """A row for each row of the dataset: doc_id, source, leaf, subroot, root, path, and claimed if the manifest has it."""
    of_sources = paths(made.top).select("source", "path", "root", F.col("node").alias("subroot"))
    return paths(made.sources, of_sources, ("subroot",)).withColumnRenamed("node", "leaf").drop("position")


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, node, lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def audit(docs: DataFrame, claimed_text: Column) -> DataFrame:
    """Holds a copy of a dataset, which differs from it in its texts, against the dataset's root: doc_id, leaf, subroot, root,
    proof_sha256 (the hash of all siblings), folded_root (of the copy's leaf and the dataset's siblings), verified."""
    found = proofs(manifest(docs, claimed_text))
    folded = found.withColumn("folded_root", fold(F.coalesce("claimed", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
