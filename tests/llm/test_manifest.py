"""Merkle proofs against a plain recursive tree: nulls, repeated rows, lone leaves, many groups, empty tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillsift.llm.merkle import merkle_proofs, row_digest, tree_runs

DOCS = "doc_id long, lang string, text string, leaf string, n int, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves, fanout):
    """The root and, for each leaf, a list of (left, right) siblings."""
    paths, level, members = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        above, joined = [], []
        for at in range(0, len(level), fanout):
            run = level[at:at + fanout]
            for k in range(len(run)):
                for leaf in members[at + k]:
                    paths[leaf].append((run[:k], run[k + 1:]))
            above.append(h(*run))
            joined.append([leaf for group in members[at:at + fanout] for leaf in group])
        level, members = above, joined
    return level[0], paths


def brute(rows, fanout):
    """(doc_id, leaf, subroot, root, proof, folded root) per row, ``rows`` being (doc_id, lang, text, text now)."""
    first = lambda v: (v is not None, v if v is not None else 0)
    groups, out = {}, []
    for i, lang, text, now in rows:
        groups.setdefault(lang, []).append((i, h(framed(i), framed(text)), h(framed(i), framed(now))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {}
    for name in names:
        groups[name].sort(key=lambda r: (first(r[0]), r[1]))
        built[name] = tree([r[1] for r in groups[name]], fanout)
    root, tops = tree([built[name][0] for name in names], fanout)
    for name, top in zip(names, tops):
        for (i, leaf, now), path in zip(groups[name], built[name][1]):
            folded = now
            for left, right in path + top:
                folded = h(*left, folded, *right)
            out.append((i, leaf, built[name][0], root, h(*[x for a, b in path + top for x in a + b]), folded, folded == root))
    return sorted(out, key=str)


def rows_of(df, fanout):
    proofs = merkle_proofs(df, row_digest(F.col("doc_id"), F.col("text")), row_digest(F.col("doc_id"), F.col("now")), fanout=fanout)
    return sorted((tuple(r) for r in proofs.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_proofs(spark, fanout):
    rng = random.Random(fanout)
    langs = [None, "", "a", "é", "Z", *[f"g{k}" for k in range(12)]]
    rows = [(k, rng.choice(["a", "a", "a", *langs]), rng.choice([None, "", "Ab", "ÀB", "x" * 70_000]), None) for k in range(150)]
    rows = [(i, g, t, t if i % 3 else t and t.lower()) for i, g, t, _ in rows]
    rows += [(None, "a", "n", "n"), (None, None, "n", "m"), (5, "alone", "t", "t"), (7, "a", "Q", "q"), (7, "a", "Q", "q"), (7, "a", "R", "R")]
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], "doc_id long, lang string, text string, now string, leaf string, n int, path string")
    assert rows_of(df, fanout) == brute(rows, fanout)
    assert rows_of(df.limit(0), fanout) == []


def test_a_lone_row_is_its_own_root(spark):
    df = spark.createDataFrame([(1, "a", "t", "t")], "doc_id long, lang string, text string, now string")
    (row,) = rows_of(df, 8)
    assert row[1] == row[2] == row[3] == row[5] == h(framed(1), framed("t")) and row[4] == h() and row[6]


def test_a_node_is_asked_for_by_its_run_only(spark):
    nodes = spark.range(1000).select(F.lit(1).cast("long").alias("tree"), F.col("id").alias("pos"), F.lit(1000).cast("long").alias("n"), F.unhex(F.md5(F.col("id").cast("string"))).alias("digest"))
    sizes = tree_runs(nodes).select("pos", F.size("members").alias("k")).collect()
    assert len(sizes) == 1000 and all(r.k == 8 for r in sizes)
