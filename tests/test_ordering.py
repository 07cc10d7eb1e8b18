"""Ranks, cut-offs and running totals against sorting in Python, with a hot class."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillsift import session
from quillsift.operators import ordering, splits
from quillsift.operators.dataset import balance_classes

ROWS = [(i, 0 if i % 3 else 1 if i % 2 else 2) for i in range(3000)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id int, label int").repartition(5)


def key(i, seed=42):
    return hashlib.md5(f"{i}|{seed}".encode()).hexdigest(), i


def ranks(seed=42):
    classes = defaultdict(list)
    for i, label in ROWS:
        classes[label].append(i)
    return {i: n for ids in classes.values() for n, i in enumerate(sorted(ids, key=lambda x: key(x, seed)), 1)}


def sizes():
    return {label: sum(1 for _, x in ROWS if x == label) for label in (0, 1, 2)}


def test_class_rank(table):
    got = {r.id: r.class_rank for r in ordering.class_rank(table, ["label"], "id").collect()}
    assert got == ranks()


@pytest.mark.parametrize("n", [0, 1, 100, 500, 2000, 5000])
def test_sample_per_class(table, n):
    got = {r.id for r in ordering.sample_per_class(table, n, ["label"], "id").collect()}
    assert got == {i for i, rank in ranks().items() if rank <= n}


def test_balance_and_split_and_folds(table):
    smallest = min(sizes().values())
    balanced = balance_classes(table, "id").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in balanced} == dict.fromkeys((0, 1, 2), smallest)
    tests = {r.id for r in splits.stratified_split(table, "id").filter("is_test").collect()}
    assert tests == {i for i, label in ROWS if ranks()[i] <= round(0.2 * sizes()[label])}
    folds = splits.stratified_folds(table, "id").groupBy("label", "fold").count().collect()
    for label, size in sizes().items():
        counts = [r["count"] for r in folds if r["label"] == label]
        assert len(counts) == 5 and sum(counts) == size and max(counts) - min(counts) <= 1


def test_multi_seed_split(table):
    got = {(r.seed, r.id) for r in splits.multi_seed_split(table, "id", seeds=[1, 2]).filter("is_test").collect()}
    assert got == {
        (seed, i) for seed in (1, 2) for i, label in ROWS if ranks(seed)[i] <= round(0.2 * sizes()[label])
    }


@pytest.mark.parametrize("n", [0, 7, 1500, 5000])
def test_sample_n(table, n):
    got = {r.id for r in ordering.sample_n(table, n, "id").collect()}
    assert got == set(sorted((i for i, _ in ROWS), key=key)[:n])


@pytest.mark.parametrize("n", [3, 40, 2500])
def test_first_rows(table, n):
    assert {r.id for r in ordering.first_n(table, ["id"], n).collect()} == set(range(n))
    got = {r.id for r in ordering.first_n_per_group(table, ["label"], [F.desc("id")], n).collect()}
    assert got == {
        i for label in (0, 1, 2) for i in sorted((i for i, x in ROWS if x == label), reverse=True)[:n]
    }


@pytest.mark.parametrize("n", [0, 1, 4, 9, 100])
def test_first_rows_among_ties_and_copies(spark, n):
    rows = [(None if i % 4 == 0 else i % 2, i // 5, "x" * (i % 3)) for i in range(60)] + [(0, 1, "copy")] * 7
    df = spark.createDataFrame(rows, "g int, k int, t string").repartition(4)
    got = [tuple(r) for r in ordering.first_n_per_group(df, ["g"], ["k", F.desc("t")], n).collect()]
    expected = []
    for g in (None, 0, 1):
        expected += sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], [-ord(c) for c in r[2]] + [0]))[:n]
    by = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(got, key=by) == sorted(expected, key=by)


def test_choosing_the_first_rows_sorts_no_texts(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(ordering, "materialise", lambda df: staged.append(df) or session.materialise(df))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = ordering.first_n_per_group(docs, ["source"], ["lang", F.desc("doc_id")], 3)
    assert first.count() == 3 * docs.select("source").distinct().count()
    assert all("text" not in df.columns for df in staged)
    for df in staged:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Sort" in line and "text#" in line]


@pytest.mark.parametrize("n", [3, 1001, 20000])
def test_null_groups_are_groups(spark, n):
    rows = spark.createDataFrame([(i, None if i % 2 else "q") for i in range(10)], "id int, g string")
    assert ordering.first_n_per_group(rows, ["g"], ["id"], n).count() == 2 * min(n, 5)
    totals = ordering.running_totals(rows.withColumn("v", F.lit(1)), ["id"], {"t": "v"}, ["g"]).collect()
    assert sorted(r.t for r in totals if r.g is None) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("n", [5, 15000])
def test_null_and_repeated_ids_are_refused(spark, n):
    with pytest.raises(Exception, match="null in the id column"):
        ordering.sample_n(spark.createDataFrame([(None,), (1,)], "id int"), n, "id").collect()
    twins = spark.createDataFrame([(1,)] * 40, "id int")
    if n < 40:
        with pytest.raises(Exception, match="not unique"):
            ordering.sample_n(twins, n, "id").collect()
    else:
        assert ordering.sample_n(twins, n, "id").count() == 40


def test_rows_without_label_are_of_no_class(spark):
    rows = spark.createDataFrame([(i, None if i == 150 else i // 100) for i in range(151)], "id int, label int")
    counts = {r["label"]: r["count"] for r in balance_classes(rows, "id").groupBy("label").count().collect()}
    assert counts == {0: 50, 1: 50}
    split = splits.stratified_split(rows, "id").collect()
    assert len(split) == 151 and [r.is_test for r in split if r.label is None] == [None]
    assert [r.fold for r in splits.stratified_folds(rows, "id").collect() if r.label is None] == [None]


def test_running_totals_with_following(table):
    rows = ordering.running_totals(
        table.withColumn("v", F.col("id") * 2), ["id"], {"total": "v"}, ["label"], following=["v"]
    ).collect()
    for label in (0, 1, 2):
        ids = sorted(i for i, x in ROWS if x == label)
        total, expected = 0, {}
        for i, after in zip(ids, [*ids[1:], None]):
            total += 2 * i
            expected[i] = (total, None if after is None else 2 * after)
        assert {r.id: (r.total, r.next_v) for r in rows if r.label == label} == expected


def test_text_ids_grow_and_are_kept(spark):
    df = spark.range(10_050).withColumnRenamed("id", "n")
    ids = {r.n: r.text_id for r in ordering.assign_text_id(df, ["n"]).collect()}
    assert ids[0] == "text_0000" and ids[9999] == "text_9999" and ids[10_049] == "text_10049"
    assert ordering.assign_text_id(df.withColumn("text_id", F.lit("x")), ["n"]).first().text_id == "x"


def test_split_passes_read_only_what_they_need(spark):
    """The wide rows meet only broadcast sides; the counting passes read id and label."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = splits.stratified_split(df, "doc_id", "lang")._jdf.queryExecution().executedPlan().toString()
    reads = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line]
    assert sum("text:string" in read for read in reads) == 1
    wide = [line for line in plan.splitlines() if "text#" in line and "Exchange" in line]
    assert wide == []


def test_rows_are_marked_where_they_lie(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(threshold)
    spark.conf.set(threshold, "100k")  # so that the table is large beside it
    try:
        df = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label")).repartition(7)
        split = splits.stratified_split(df, "doc_id")
        assert "SortMergeJoin" not in split._jdf.queryExecution().executedPlan().toString()
        tasks = split.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(tasks) == 7 and max(row["count"] for row in tasks) < 8000  # two tasks, one per class, before
    finally:
        spark.conf.set(threshold, held)
