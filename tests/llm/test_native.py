"""Exact copies, hosts and repeated lines on hand-written rows: nulls, ties, empties, clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillsift.llm import exact, hosts, lines

DOCS = "doc_id long, text string, keep_id string, host string"


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_exact_copies(spark):
    data = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "x" * 300_000), (7, "a "), (8, "b"), (8, "b"), (None, "n"), (None, "b")]
    df = spark.createDataFrame([(i, t, "k", "h") for i, t in data], DOCS)
    got = exact.exact_duplicates(df).collect()
    assert len(got) == len(data)
    groups = {}
    for i, t in data:
        groups.setdefault(t or "", []).append(i)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        members = groups[text]
        assert r.group_size == len(members) and r.keep_id == max((m for m in members if m is not None), default=None)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(groups)
    assert exact.exact_duplicates(df.limit(0)).count() == 0
    assert exact.exact_duplicates(df, broadcast_bytes=0).filter("kept").count() == len(groups)


def test_only_possible_copies_are_compared(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = df.select(F.unhex(F.sha2("text", 256)).alias("_digest"))
    words = 1 << 12
    rows = rows.withColumns({"_word": exact._word(F.col("_digest"), words), "_mask": exact._mask(F.col("_digest"))})
    tested = rows.join(exact.repeat_filter(rows), "_word", "left")
    assert tested.filter(F.col("_twice").bitwiseAND(F.col("_mask")) == F.col("_mask")).count() < 100


URLS = [
    ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/"),
    ("https://example.net/fr", "example.net", "/fr", "net/"), ("x://notexample.com/de/1", "notexample.com", "/de/1", None),
    ("s://example.com/de/", "example.com", "/de/", "example.com/de/"), ("http://w.org", "w.org", "", None),
    ("http://w.org?a://b.net/", "w.org", "", None), ("http://É.ORG/fr/", "É.org", "/fr/", "org/fr/"), (None, "", "", None),
    ("no scheme", "", "", None), ("a://", "", "", None), ("http://n.net/\n/x", "n.net", "/\n/x", "net/"),
]


def test_urls_and_rules(spark):
    df = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in hosts.judge_urls(df).collect()}
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
    assert got[0].verdict == "allow" and got[1].verdict == "block"
    assert hosts.judge_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in hosts.judge_urls(df.filter("page_id = 4")).collect()} == {"allow"}


def test_sparse_hosts_follow_their_domain(spark):
    bad = [("a.bad.com", True)] * 50 + [("b.bad.com", True)] * 50 + [("c.good.org", False)] * 100 + [("new.bad.com", None), ("new.good.org", None)]
    got = {r.host: r for r in hosts.host_reputation(spark.createDataFrame(bad, "host string, bad boolean")).collect()}
    assert got["new.bad.com"].risk > 0.8 and got["new.good.org"].risk < 0.2
    assert got["a.bad.com"].risk_lower > got["new.bad.com"].risk_lower


def brute_lines(docs, least):
    """Every run of lines with at least ``least`` words whose like comes before; all runs are tried."""
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0]))
    worded = {}
    for i, t in ordered:
        worded[i] = [(p, line, len(line.split())) for p, line in enumerate(t.split("\n")) if line.split()] if t else []
    first, gone = {}, {i: set() for i, _ in docs}
    runs = []
    for i, _ in ordered:
        w = worded[i]
        for a in range(len(w)):
            total = 0
            for b in range(a, len(w)):
                total += w[b][2]
                if total >= least:
                    runs.append((tuple(x[1] for x in w[a:b + 1]), i, a, b))
    for content, i, a, b in runs:
        first.setdefault(content, (i, a))
    for content, i, a, b in runs:
        if first[content] != (i, a):
            gone[i].update(x[0] for x in worded[i][a:b + 1])
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in docs}


def test_repeated_lines(spark):
    line = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    shared = [line(1, 20), line(2, 3), line(3, 30)]
    docs = [
        (1, "\n".join([line(10, 4), *shared, line(11, 5)])), (2, "\n".join([line(12, 9), *shared])), (3, "\n".join(shared[:2])),
        (4, "\n".join([*shared, "", *shared])), (5, None), (6, ""), (7, "\n\n"), (8, line(3, 30)), (9, line(4, 60)), (10, line(4, 60) + "\ntail"),
        (11, "\n".join(["one two"] * 80)), (12, "\n".join([line(10, 4), *shared, line(11, 5)])), (13, " ".join(["long"] * 40_000)),
    ]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n_lines_dropped int, _key int")
    got = {r.doc_id: r for r in lines.drop_repeated_lines(df).collect()}
    assert {i: r.text for i, r in got.items()} == brute_lines(docs, 50)
    assert got[12].text == "" and got[12].n_lines_dropped == 5 and got[1].n_lines_dropped == 0
    assert lines.drop_repeated_lines(df.limit(0)).count() == 0


def test_blank_lines_inside_repeated_passages_stay(spark):
    first, second = (" ".join(f"w{k}x{j}" for j in range(30)) for k in range(2))
    docs = [(1, f"{first}\n\n \t\n{second}"), (2, f"head\n{first}\n\n{second}\ntail"), (3, f"{first}\n{second}")]
    got = {r.doc_id: r for r in lines.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: r.text for i, r in got.items()} == brute_lines(docs, 50)
    assert (got[2].text, got[3].text) == ("head\n\ntail", "") and [got[i].n_lines_dropped for i in (1, 2, 3)] == [0, 2, 2]


def test_only_windows_around_repeated_fingerprints_are_compared(spark, monkeypatch):
    line = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    docs = [(d, "\n".join(line(100 * d + k) for k in range(30))) for d in range(20)] + [(50, line(205) + "\n" + line(206) + "\n" + line(207))]
    compared = []
    monkeypatch.setattr(lines, "materialise", lambda df: compared.append(df.cache()) or compared[-1])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [(r._id, sorted(r._gone)) for r in lines.repeated_lines(df).collect()] == [(50, [0, 1, 2])]
    windows = compared[0]
    fingers = {r._finger for r in windows.filter("_id = 50").collect()}
    got = lines._matched(windows).collect()
    assert got and {r._finger for r in got} == fingers and len(got) < 20 < windows.count() / 20


def test_rows_that_are_repeated_are_one_document(spark):
    text = " ".join(f"w{j}" for j in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = rows_of(lines.drop_repeated_lines(df), "doc_id", "text")
    assert got == sorted([(1, ""), (1, ""), (None, text)], key=str)


@pytest.mark.parametrize("module", [exact, hosts, lines])
def test_native_modules_have_no_python_rows(module):
    source = open(module.__file__).read()
    assert not any(word in source for word in ("udf(", "InPandas", "InArrow", ".rdd", "collect()"))
