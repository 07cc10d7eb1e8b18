"""TF-IDF with sublinear term counts and smoothed idf, and its truncated SVD."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillsift.functions.tokens import term_words
from quillsift.session import materialise

# Vocabulary limits.
MAX_FEATURES, MIN_DF, MAX_DF, MAX_N = 1000, 2, 0.95, 2


# Words that n-grams are limited to, at most; where more are frequent enough, all n-grams are counted.
WORDS_OF_TERMS = 20_000
# Words taken apart at a time inside a task.
SLICE_WORDS = 1 << 18


def _slices(words: pa.ListArray) -> Iterator[pa.ListArray]:
    """Documents one after the other, some of them at a time, with about ``SLICE_WORDS`` words in all."""
    ends = np.cumsum(pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(words):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_WORDS, side="right")))
        yield words.slice(at, stop - at)
        at = stop


def _occurrences(words: pa.ListArray, max_n: int, among: pa.Array | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For words and each width of n-grams: the different terms, and number of the term and document of each occurrence.

    With ``among`` only terms of these words occur.
    """
    sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    document, left = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())
    coded = words.flatten().dictionary_encode()
    singles, single = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    listed = np.ones(len(single), dtype=bool) if among is None else pc.is_in(singles, among).to_numpy(zero_copy_only=False)[single]
    terms, start = singles, np.flatnonzero(listed)
    number = single[start]
    yield terms, number, document[start]
    for width in range(2, max_n + 1):
        kept = left[start] >= width
        kept[kept] = listed[start[kept] + width - 1]
        start = start[kept]
        pairs, number = np.unique(number[kept] * max(1, len(singles)) + single[start + width - 1], return_inverse=True)
        first, second = np.divmod(pairs, max(1, len(singles)))
        terms = pc.binary_join_element_wise(terms.take(pa.array(first)), singles.take(pa.array(second)), " ")
        yield terms, number, document[start]


def tfidf_vocabulary(df: DataFrame, text: str = "normalized_text", max_features: int = MAX_FEATURES,
                     min_df: int = MIN_DF, max_df: float = MAX_DF, max_n: int = MAX_N) -> DataFrame:
    """(term, tf, df, n_docs) of the ``max_features`` most frequent terms, ties by term.

    Terms are counted as numbers, some documents at a time, where these lie. One shuffle by term, after partial sums, then
    yields both the number of occurrences and the number of documents. Words are counted first and staged. No term occurs more often, or
    in more documents, than any of its words: so where the words alone fill the vocabulary, longer terms are counted only
    if each of their words is as frequent as the last of it. ``df`` is read three times: stage it first.
    """
    words = df.select(term_words(F.col(text)))

    def counted(widths: range, among: pa.Array | None = None) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (part for batch in batches for part in _slices(batch.column(0))):
                for width, (terms, number, document) in enumerate(_occurrences(part, widths.stop - 1, among), 1):
                    if width in widths:
                        once = np.unique(number * len(part) + document) // len(part)
                        yield pa.RecordBatch.from_arrays(
                            [terms, pa.array(np.bincount(number, minlength=len(terms))), pa.array(np.bincount(once, minlength=len(terms)))],
                            names=["term", "tf", "df"])

        marked = words.mapInArrow(task, "term string, tf long, df long")
        return marked.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))

    n_docs = df.count()
    fits = (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.lit(n_docs))
    counts = materialise(counted(range(1, 2)))
    if max_n > 1:
        least = counts.filter(fits).orderBy(F.desc("tf")).limit(max_features).agg(F.count("tf").alias("n"), F.min("tf").alias("tf")).first()
        among = None
        if least["n"] == max_features:
            frequent = counts.filter((F.col("tf") >= least["tf"]) & (F.col("df") >= min_df)).select("term").limit(WORDS_OF_TERMS + 1).collect()
            among = pa.array([row["term"] for row in frequent], pa.string()) if len(frequent) <= WORDS_OF_TERMS else None
        counts = counts.unionByName(counted(range(2, max_n + 1), among))
    return (
        counts.withColumn("n_docs", F.lit(n_docs).cast("long"))
        .filter(fits)
        .orderBy(F.desc("tf"), "term").limit(max_features)
    )


_CUT = "\u0001"


def _constants(values: Sequence, kind: str) -> Column:
    """An array as one constant of the plan."""
    return F.split(F.lit(_CUT.join(map(str, values))), _CUT).cast(f"array<{kind}>")


def tfidf_vectors(df: DataFrame, vocabulary: DataFrame, text: str = "normalized_text", max_n: int = MAX_N,
                  output: str = "tfidf") -> tuple[DataFrame, list[str]]:
    """Adds the non-zero weights (1 + ln tf) * idf of unit length, as ``indices`` and ``values``; returns the terms in their order.

    The vocabulary is at most ``max_features`` rows and goes to the driver; the documents are weighted where they lie, with
    no shuffle and nothing as wide as the vocabulary in a row. A text without known terms has no indices.
    """
    rows = sorted(vocabulary.collect(), key=lambda row: row["term"])
    if not rows:
        raise ValueError("no term is frequent enough for the vocabulary")
    names = [row["term"] for row in rows]
    idf = np.array([math.log((1 + row["n_docs"]) / (1 + row["df"])) + 1 for row in rows])

    def weights(part: pa.ListArray) -> pa.StructArray:
        known = pa.array(names, pa.string())
        found = [np.zeros(0, dtype=np.int64)]
        for terms, number, document in _occurrences(part, max_n):
            place = pc.index_in(terms, known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[number]
            found.append((document * len(names) + place)[place >= 0])
        cells, count = np.unique(np.concatenate(found), return_counts=True)
        document, place = np.divmod(cells, len(names))
        raw = (1.0 + np.log(count)) * idf[place]
        raw /= np.sqrt(np.bincount(document, raw * raw, len(part)))[document]
        offsets = pa.array(np.searchsorted(document, np.arange(len(part) + 1)).astype(np.int32))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(raw))],
            names=["indices", "values"])

    @F.arrow_udf("indices array<int>, values array<double>")
    def unit(words: pa.Array) -> pa.Array:
        return pa.concat_arrays([weights(words.slice(0, 0)), *[weights(part) for part in _slices(words)]])

    return df.withColumn(output, unit(term_words(F.col(text)))), names


def tfidf_entries(vectors: DataFrame, *keep: str, column: str = "tfidf") -> DataFrame:
    """(keep, index, weight): one row per non-zero weight."""
    pairs = F.explode(F.arrays_zip(F.col(f"{column}.indices").alias("index"), F.col(f"{column}.values").alias("weight")))
    return vectors.select(*keep, pairs.alias("_pair")).select(*keep, "_pair.index", "_pair.weight")


def tfidf_weights(vectors: DataFrame, names: list[str], id_column: str = "text_id",
                  column: str = "tfidf") -> DataFrame:
    """The long form (id, term, weight) of the non-zero entries."""
    return tfidf_entries(vectors, id_column, column=column).select(
        id_column, F.get(_constants(names, "string"), F.col("index")).alias("term"), "weight")


# Fixed value: number of components.
N_COMPONENTS = 100
# Documents multiplied at a time inside a task.
PANEL = 512


def _panels(column: pa.StructArray, width: int) -> Iterator[np.ndarray]:
    """The weights of a batch, some hundred documents at a time, as matrices."""
    indices, values = column.field("indices"), column.field("values")
    for at in range(0, len(column), PANEL):
        index, value = indices.slice(at, PANEL), values.slice(at, PANEL)
        sizes = pc.list_value_length(index).fill_null(0).to_numpy(zero_copy_only=False)
        panel = np.zeros((len(index), width))
        panel[np.repeat(np.arange(len(index)), sizes), index.flatten().to_numpy(zero_copy_only=False)] = value.flatten().to_numpy(zero_copy_only=False)
        yield panel


def gram_matrix(vectors: DataFrame, width: int, column: str = "tfidf") -> np.ndarray:
    """The sum of the outer products of all documents: one matrix per partition, merged in a tree on the executors.

    Its size depends on the vocabulary only (8 MB for 1000 terms).
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for panel in _panels(batch.column(0), width):
                total += panel.T @ panel
        yield pa.RecordBatch.from_pydict({"gram": pa.array([total.tobytes()], pa.binary())})

    parts = vectors.select(column).mapInArrow(task, "gram binary").rdd.map(lambda row: np.frombuffer(row["gram"]))
    total = parts.treeAggregate(np.zeros(width * width), lambda a, b: a + b, lambda a, b: a + b)
    return total.reshape(width, width)


def svd_reduce(vectors: DataFrame, width: int, n_components: int = N_COMPONENTS, column: str = "tfidf",
               output: str = "svd", learn: DataFrame | None = None, also: dict[str, str] | None = None) -> tuple[DataFrame, np.ndarray]:
    """Adds U*S of the uncentred truncated SVD as an array; returns V (columns are components).

    ``width`` is the number of terms. The eigenvectors of the Gram matrix are found on the driver; Spark's own SVD would pass
    over the rows hundreds of times at this width. Signs are fixed so that each component's largest loading is positive. The
    projection is a matrix product per some hundred documents. ``vectors`` is read twice: stage it first.
    The components come from the rows of ``learn`` (``vectors`` by default). ``also`` names further columns of weights, which
    are brought to the same components: weights are narrow, so join or move them rather than their many coordinates.
    """
    _, eigenvectors = np.linalg.eigh(gram_matrix(vectors if learn is None else learn, width, column))
    basis = eigenvectors[:, ::-1][:, :n_components]
    peaks = basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])]
    basis = np.ascontiguousarray(basis * np.where(peaks < 0, -1.0, 1.0))
    outputs = {column: output, **(also or {})}
    others = [name for name in vectors.columns if name not in outputs.values()]
    places = [others.index(name) for name in outputs]
    shared = vectors.sparkSession.sparkContext.broadcast(basis)  # vocabulary x components

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, PANEL) for at in range(0, batch.num_rows, PANEL)):
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * shared.value.shape[1])
                added = [pa.ListArray.from_arrays(offsets, pa.array((panel @ shared.value).ravel()))
                         for place in places for panel in _panels(part.column(place), width)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*others, *outputs.values()])

    rows = vectors.select(*[F.col(f"`{name}`") for name in others])
    arrays = [T.StructField(name, T.ArrayType(T.DoubleType())) for name in outputs.values()]
    return rows.mapInArrow(task, T.StructType([*rows.schema.fields, *arrays])), basis


def svd_explained_variance(reduced: DataFrame, original: str = "tfidf", output: str = "svd") -> DataFrame:
    """The variance of the weights, that of the components, and the share that these keep; all columns added up.

    ``reduced`` is read once: a partition yields its number of rows, and the sum and the sum of squares of each column.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = 0, {"weight": np.zeros((2, 0)), "component": np.zeros((2, 0))}

        def add(kind: str, place: np.ndarray, value: np.ndarray) -> None:
            more = np.array([np.bincount(place, value), np.bincount(place, value * value)])
            wide = np.zeros((2, max(sums[kind].shape[1], more.shape[1])))
            for held in (sums[kind], more):
                wide[:, :held.shape[1]] += held
            sums[kind] = wide

        for part in (batch.slice(at, PANEL) for batch in batches for at in range(0, batch.num_rows, PANEL)):
            rows += part.num_rows
            weights, coordinates = part.column(0), part.column(1)
            add("weight", weights.field("indices").flatten().to_numpy(), weights.field("values").flatten().to_numpy())
            sizes = pc.list_value_length(coordinates).fill_null(0).to_numpy(zero_copy_only=False)
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            add("component", np.arange(len(first)) - first, coordinates.flatten().to_numpy())
        kinds = ["rows", *np.repeat([*sums], [held.shape[1] for held in sums.values()])]
        places = np.concatenate([[0], *[np.arange(held.shape[1]) for held in sums.values()]])
        both = np.concatenate([[[rows], [0.0]], *sums.values()], axis=1)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.string()), "place": pa.array(places, pa.int32()), "s": both[0], "q": both[1]})

    parts = reduced.select(original, output).mapInArrow(task, "kind string, place int, s double, q double")
    columns = parts.groupBy("kind", "place").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    # One row per column of the weights and of the components, and the one with the number of rows.
    held = columns.groupBy().pivot("kind", ["rows", "weight", "component"]).agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s")).alias("ss"))

    def variance(kind: str) -> Column:
        return F.try_divide(F.col(f"{kind}_q") - F.try_divide(F.col(f"{kind}_ss"), F.col("rows_s")), F.col("rows_s") - 1)

    both = held.select(variance("weight").alias("total_variance"), variance("component").alias("kept_variance"))
    return both.withColumn("explained_variance", F.try_divide("kept_variance", "total_variance"))
