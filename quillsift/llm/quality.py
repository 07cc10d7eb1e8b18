"""Quality filter: what a document looks like, weighed against what its site is like.

A logistic classifier on text-shape features, fitted on labelled documents, gives each document evidence (a log
likelihood ratio). Outcomes (the label, or the classifier's probability) are summed per host and per path by
grouped aggregation; path rates are shrunk towards their host's and hosts' towards the whole by beta priors whose strength
is estimated from the spread of the rates. The posterior of a document is its site's rate, to which the document itself
adds nothing at any level, updated by its evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillsift.llm.hosts import shrunk_rates
from quillsift.llm.rows import text_key
from quillsift.llm.encoding import texts_of
from quillsift.session import materialise

# The classifier is fitted on about this many labelled documents at most, drawn by a hash of the id.
TRAIN_ROWS = 20_000
# What the classifier's probability counts for in a site's rate, where a label counts for one.
GUESS = 0.25
THRESHOLD = 0.5
# A document's evidence is bounded, so that one odd text cannot outweigh everything.
MAX_EVIDENCE = 12.0
SYMBOLS = b"!|*$%&#@~^<>{}[]\\=+_"
FEATURES = ("log_words", "mean_word", "upper", "digit", "symbol", "stop", "comma", "same_next", "distinct_words",
            "distinct_lines", "words_per_line", "longest_word", "bang", "pipe", "case_words")


def text_features(text: str) -> list[float]:
    """Shape of a text, from its bytes and words; all features finite, zeros for a text without words."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    share = lambda k: log1p(100.0 * float(k) / n)
    lines = data.split(b"\n")
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    return [
        log1p(n), len(data) / n, upper / max(1, upper + lower), share(counts[48:58].sum()),
        share(sum(int(counts[b]) for b in SYMBOLS)), share(counts[46]), share(counts[44]),
        sum(map(eq, words, words[1:])) / n, log1p(len(set(words))) / log1p(n),
        len(set(lines)) / len(lines), log1p(n / len(lines)), log1p(max(map(len, words))), share(counts[33]), share(counts[124]),
        share(upper),
    ]


def document_features(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                      keep: dict[str, str] | None = None) -> DataFrame:
    """``doc_id``, the columns of ``keep`` (output: input), ``text_key`` and ``features``, null for a text without words."""
    keep = keep or {}
    chosen = df.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"),
                       *[F.col(f"`{column}`").cast("string").alias(name) for name, column in keep.items()],
                       text_key(F.col(f"`{text_column}`")).alias("text_key"), F.col(f"`{text_column}`").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(text) if text and text.encode().split() else None for text in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "features"])

    fields = ", ".join(["doc_id long", *[f"{name} string" for name in keep], "text_key long", "features array<double>"])
    return chosen.mapInArrow(task, fields)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights on the raw features, intercept last, by Newton steps on standardised ones."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - float(raw @ mean))


def hierarchical_quality(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                         host_column: str = "source", path_column: str = "lang", label_column: str = "quality",
                         train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, text_key, evidence, site_rate, quality, kept``.

    ``labels`` has the id and a 0/1 label; null and repeated labels are dropped (of several for one id the largest
    counts). A text without words has quality 0 and is not kept. A null host or path is a site of its own.
    Without labels of both kinds there is no evidence and every other document is kept. Repeated rows are
    each scored. Other columns are not read. The number of labelled documents used to fit is bounded, one row for each id; all
    documents enter the site rates, with weight ``GUESS`` where they have no label.
    """
    rows = materialise(document_features(df, id_column, text_column, {"_host": host_column, "_path": path_column}))
    marks = (
        labels.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{label_column}`").cast("int").alias("_label"))
        .filter("doc_id is not null and _label in (0, 1)").groupBy("doc_id").agg(F.max("_label").alias("_label"))
    )
    most = (1 << 63) - 1
    drawn = marks.filter(F.xxhash64("doc_id").bitwiseAND(F.lit(most)) <= min(most, train_rows * most // max(1, marks.count())))
    # Of rows that share an id one teaches, so that the bound holds for rows as well.
    train = rows.filter("features is not null").join(drawn, "doc_id").groupBy("doc_id", "_label").agg(
        F.max("features").alias("features")).select("features", "_label").toPandas()
    weights, base = np.zeros(len(FEATURES) + 1), 0.0
    low, high = np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
    if train["_label"].nunique() == 2:
        x, y = np.array(train["features"].tolist()), train["_label"].to_numpy(dtype=float)
        weights, low, high = fit_logistic(x, y), x.min(axis=0), x.max(axis=0)
        base = float(np.log(y.mean() / (1 - y.mean())))
    # Beyond what training has seen, a feature counts as its nearest seen value.
    score = F.lit(float(weights[-1]))
    for i, weight in enumerate(weights[:-1]):
        seen = F.least(F.greatest(F.col("features")[i], F.lit(float(low[i]))), F.lit(float(high[i])))
        score = score + seen * float(weight)
    score = F.when(F.col("features").isNotNull(), score)
    # The bounds would stand in for a null.
    evidence = F.when(score.isNotNull(), F.least(F.greatest(score - base, F.lit(-MAX_EVIDENCE)), F.lit(MAX_EVIDENCE)))
    probability = 1 / (1 + F.exp(-(F.col("evidence") + base)))
    scored = rows.withColumn("evidence", evidence).join(marks, "doc_id", "left").withColumns({
        "_host": F.coalesce("_host", F.lit("\0")), "_path": F.coalesce("_path", F.lit("\0")),
        "_good": F.coalesce(F.col("_label").cast("double"), probability) if weights.any() else F.lit(None).cast("double"),
        "_weight": F.when(F.col("_label").isNotNull(), F.lit(1.0)).otherwise(F.lit(GUESS)),
    }).drop("features", "_label")
    mine, weight = F.coalesce(F.col("_weight") * F.col("_good"), F.lit(0.0)), F.when(F.col("_good").isNotNull(), F.col("_weight")).otherwise(F.lit(0.0))
    scored = materialise(scored.withColumns({"_good": mine, "_weight": weight}))
    # Rates of sites: _bad holds what is counted, here good documents.
    paths = materialise(scored.groupBy("_host", "_path").agg(F.sum("_weight").alias("_n"), F.sum("_good").alias("_bad")))
    up = [F.sum("_n").alias("_n"), F.sum("_bad").alias("_bad")]
    hosts = paths.groupBy("_host").agg(*up).withColumn("_all", F.lit(0))
    counted, good = paths.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("_n", "_bad")]).first()
    whole = hosts.groupBy("_all").agg(*up).withColumn("_mean", (F.col("_bad") + 1) / (F.col("_n") + 2))
    hosts = shrunk_rates(hosts, whole, "_all")
    paths = shrunk_rates(paths, hosts, "_host")
    above = hosts.select("_host", F.col("_n").alias("_host_n"), F.col("_bad").alias("_host_good"), F.col("_strength").alias("_host_strength"))
    joined = scored.join(paths.select("_host", "_path", "_n", F.col("_bad").alias("_all_good"), "_strength").join(above, "_host"), ["_host", "_path"])

    def without(prior, strength, total, n):
        """A rate shrunk towards ``prior``, less what the document itself adds."""
        return (strength * prior + total - F.col("_good")) / (strength + n - F.col("_weight"))

    rate = without(F.lit(0.5), F.lit(2.0), F.lit(float(good)), F.lit(float(counted)))
    rate = without(rate, F.col("_host_strength"), F.col("_host_good"), F.col("_host_n"))
    rate = without(rate, F.col("_strength"), F.col("_all_good"), F.col("_n"))
    rate = F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    quality = F.when(F.col("evidence").isNull(), F.lit(0.0)).otherwise(
        1 / (1 + F.exp(-(F.log(F.col("site_rate") / (1 - F.col("site_rate"))) + F.col("evidence")))))
    out = joined.withColumn("site_rate", rate).withColumn("quality", quality)
    return out.select("doc_id", "text_key", "evidence", "site_rate", "quality", (F.col("quality") >= threshold).alias("kept"))
