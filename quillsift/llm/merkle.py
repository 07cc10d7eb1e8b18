"""A Merkle manifest of a table: one tree per group, one over the groups, and a proof per row.

Every level joins its nodes to themselves on computed sibling indices: node ``pos`` asks for the slots of its run of
``fanout`` nodes, shifted by 0 to ``fanout - 1``, so a join key is one node and no group of rows is ever larger than a run.
The rows in slot zero then emit the parents. Digests travel as 32 bytes and are hashed as the hex text that they stand for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillsift.operators.ordering import with_position
from quillsift.session import materialise

FANOUT = 8


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value, so that no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    """SHA-256 of the framed values, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[framed(value) for value in values]), 256))


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _join(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, hex_text), "")


def tree_runs(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, pos, n, members): each node with the digests of its run, its own included, from left to right.

    ``nodes`` are (tree, pos, n, digest): places from 0 in trees of ``n`` nodes. A join key is one node, asked for by
    at most ``fanout`` others, and a group holds at most ``fanout`` rows, however large a tree is.
    """
    shift = F.explode(F.array(*[F.lit(k) for k in range(fanout)]))
    start = F.col("_own") - F.col("_own") % fanout
    asked = (
        nodes.select("tree", F.col("pos").alias("_own"), F.col("n"), shift.alias("_shift"))
        .withColumn("pos", start + (F.col("_own") + F.col("_shift")) % fanout)
        .filter(F.col("pos") < F.col("n")).drop("_shift")
    )
    found = asked.join(nodes.select("tree", "pos", "digest"), ["tree", "pos"])
    members = F.sort_array(F.collect_list(F.struct("pos", "digest")))
    return found.groupBy("tree", "_own", "n").agg(members["digest"].alias("members")).withColumnRenamed("_own", "pos")


EMPTY_PATH = "CAST(array() AS array<struct<left: array<binary>, right: array<binary>>>)"


def tree_paths(nodes: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Roots (tree, digest) and paths (tree, pos, path) of all nodes, as given by ``tree_runs``; stage ``nodes`` first.

    A path leads from a node to the root of its tree: at each level the digests on its ``left`` and on its ``right``. It is
    empty for the only node of a tree. Levels are staged, each a ``fanout``-th of the one below; the driver learns their
    number and nothing else.
    """
    levels, runs = [nodes], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs.append(materialise(tree_runs(levels[-1].filter("n > 1"), fanout)))
        parents = runs[-1].filter(F.col("pos") % fanout == 0)
        levels.append(materialise(parents.select(
            "tree", F.expr(f"pos div {fanout}").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
            F.unhex(F.sha2(_join(F.col("members")), 256)).alias("digest"))))
        most = -(-most // fanout)
    ended = [level.filter("n = 1") for level in levels]
    roots = reduce(DataFrame.unionByName, [level.select("tree", "digest") for level in ended])
    ends = [level.select("tree", "pos", F.expr(EMPTY_PATH).alias("path")) for level in ended]
    slot = (F.col("pos") % fanout).cast("int")
    step = F.struct(
        F.slice("members", F.lit(1), slot).alias("left"),
        F.slice("members", slot + 2, F.lit(fanout)).alias("right"))
    paths = ends[-1]
    for members, end in zip(reversed(runs), reversed(ends[:-1])):
        above = paths.select("tree", F.col("pos").alias("_run"), F.col("path").alias("_above"))
        below = members.withColumn("_run", F.expr(f"pos div {fanout}")).join(above, ["tree", "_run"])
        paths = below.select("tree", "pos", F.concat(F.array(step), "_above").alias("path")).unionByName(end)
    return roots, paths


def merkle_proofs(df: DataFrame, leaf: Column, presented: Column, group: str = "lang", order: str = "doc_id",
                  fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``df``: ``order``, its leaf, the roots above it and whether ``presented`` proves to be that leaf.

    ``leaf`` and ``presented`` are 32-byte digests over the columns of ``df``: what the manifest was made of, and what is
    there now. Rows of a group ascend by ``order`` (nulls first, then by leaf); groups ascend as well, null first.
    ``subroot`` is the root of the group, ``root`` that over all groups, ``proof_sha256`` the hash of all siblings up to it,
    ``folded_root`` what ``presented`` gives with these siblings, and ``verified`` says that it is ``root``.

    Null and empty values have leaves of their own, repeated rows one each; a group of one row has that leaf as its root; an
    empty table gives no rows. A text is read once, whatever its length, and only digests move. Other columns are not kept,
    so their names cannot clash.
    """
    rows = materialise(df.select(
        F.col(f"`{order}`").alias("_id"), F.col(f"`{group}`").alias("_group"), leaf.alias("_leaf"), presented.alias("_presented")))
    sizes = materialise(rows.groupBy("_group").agg(F.count(F.lit(1)).alias("n")))
    trees = materialise(with_position(sizes, ["_group"], output="tree").withColumnRenamed("_group", "_name"))
    placed = with_position(rows, ["_id", "_leaf"], ["_group"], "_place")
    leaves = materialise(placed.join(trees, F.col("_group").eqNullSafe(F.col("_name"))).select(
        "tree", (F.col("_place") - 1).alias("pos"), "n", F.col("_leaf").alias("digest"), "_id", "_presented"))
    subroots, paths = tree_paths(leaves.select("tree", "pos", "n", "digest"), fanout)
    top = materialise(subroots.select(
        F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("pos"), F.lit(trees.count()).cast("long").alias("n"),
        "digest", F.col("tree").alias("_tree")))
    roots, top_paths = tree_paths(top.select("tree", "pos", "n", "digest"), fanout)
    above = materialise(top.join(top_paths, ["tree", "pos"]).join(roots.withColumnRenamed("digest", "_root"), "tree").select(
        F.col("_tree").alias("tree"), F.col("digest").alias("_subroot"), "_root", F.col("path").alias("_above")))
    proven = leaves.join(paths, ["tree", "pos"]).join(above, "tree")
    path = F.concat("path", "_above")
    siblings = F.array_join(F.transform(path, lambda s: F.concat(_join(s["left"]), _join(s["right"]))), "")
    folded = F.aggregate(path, hex_text(F.col("_presented")), lambda h, s: F.sha2(
        F.concat(_join(s["left"]), h, _join(s["right"])), 256))
    return proven.select(
        F.col("_id").alias(order), hex_text(F.col("digest")).alias("leaf"), hex_text(F.col("_subroot")).alias("subroot"),
        hex_text(F.col("_root")).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
