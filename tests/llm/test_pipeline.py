"""Each stage of the pipeline on odd rows: nulls, empty, very long, tied and repeated ones, clashing columns, no rows at all."""

from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillsift.session import materialise

PASSAGE = "\n".join(" ".join(f"passage{i}x{k}" for k in range(6)) for i in range(12))
ITEM = " ".join(f"exam{i}" for i in range(14))
STORY = " ".join(f"story{i}" for i in range(60))
ROWS = [
    (1, f"The first one begins here.\n{PASSAGE}\nAnd this is how it ends."), (2, f"Another start of its own.\n{PASSAGE}\nAnother end."),
    (3, STORY), (4, STORY.replace("story59", "changed")), (5, "The same words twice over, as rows."), (5, "The same words twice over, as rows."),
    (5, "An id that is shared by another text."), (6, None), (7, ""), (8, " ".join(f"long{i % 9973}" for i in range(40_000))),
    (9, "Only three words."), (10, f"It was asked: {ITEM.upper()}! Nobody knew."), (11, " \n\t\n "), (None, "No id, but some words of its own."),
]
CUT = {2: "Another start of its own.\nAnother end.", 10: "It was asked: ! Nobody knew."}
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, n_words long, hit_spans string, "
          "text_key string, n_lines_dropped long, site_rate double, _id long, _row string")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, None if i == 9 else "en", None if i == 3 else "hot", len(t or ""), "k", 1, "h", "t", 2, 0.5, 3, "r") for i, t in ROWS]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 5, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def expected(name):
    """What each stage makes of ROWS, by hand."""
    kept = [(i, t) for i, t in ROWS if name != "quality" or (t or "").strip()]
    if name == "near_dedup":
        return Counter((i, t) for i, t in kept if i != 4)
    # With the passage and the item gone, nothing else may change.
    cut = {"line_dedup": 2, "decontamination": 10}.get(name, -1)
    return Counter((i, CUT[i] if i == cut else t) for i, t in kept)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_on_odd_rows(spark, tables, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    made = materialise(stage(spark, docs, tables))
    assert made.columns == docs.columns
    assert texts(made) == expected(name)
    if name in ("line_dedup", "decontamination"):
        assert all(r.n_chars == len(r.text) for r in made.select("n_chars", "text").collect() if r.text is not None)
    empty = stage(spark, docs.limit(0), tables)
    assert empty.columns == docs.columns and empty.count() == 0


def test_packing_on_odd_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    whole = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    want = Counter((i, len(whole.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in ROWS)
    got = corpus_pipeline.packing(spark, docs, tables).collect()
    ends = Counter((r.doc_id, r.doc_tokens) for r in got if r.start + r.length == r.doc_tokens)
    assert ends == want and sum(r.length for r in got) == sum(n * times for (_, n), times in want.items())
    assert corpus_pipeline.packing(spark, docs.limit(0), tables).count() == 0


def test_whole_run_on_odd_rows(spark, tables):
    whole = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    want = Counter()
    for (i, t), times in expected("quality").items():
        if i != 4:
            want[i, len(whole.encode(CUT.get(i, t), add_special_tokens=False).ids) + 1] += times
    got = corpus_pipeline.run(spark, tables).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start + r.length == r.doc_tokens) == want
