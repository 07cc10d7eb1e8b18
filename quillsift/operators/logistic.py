"""Logistic regression by Newton's method: some ten passes over the rows for any number of models.

The objective is the sum of the log losses plus half the squared coefficients over C, the intercept left out, on the
features in their own units. Unscaled features make that ill-conditioned for gradient steps (433 passes over the 4,708
turns of the largest tables); Newton steps do not mind. They are taken in standardised space, where the penalty of a
feature is divided by its variance, and mapped back.

A pass adds up loss, gradient and second derivatives of all models at once, so the seeds of a stability report or the folds
of a cross-validation share it. Partitions yield one small block per model, merged in a tree on the executors.
With an absolute penalty a step goes to the least value of the second-order model plus that penalty (proximal Newton).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

# Steps at most, and the gain still to come, as a share of the objective, at which to stop.
MAX_STEPS = 100
ENOUGH = 1e-13
ENOUGH_SPARSE = 1e-11


@dataclass
class Fit:
    coefficients: np.ndarray
    intercept: float
    steps: int


def _derivatives(block: np.ndarray, label: np.ndarray, used: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loss, gradient and second derivatives, one after the other, over the rows that are ``used``."""
    block, label = block[used], label[used]
    margin = block @ weights
    chance = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
    loss = np.logaddexp(0.0, margin).sum() - margin[label].sum()
    inner = (block * (chance * (1.0 - chance))[:, None]).T @ block
    return np.concatenate([[loss], block.T @ (chance - label), inner.ravel()])


def _sparse_step(inner: np.ndarray, gradient: np.ndarray, at: np.ndarray, absolute: np.ndarray) -> np.ndarray:
    """The step to the least value of the second-order model plus the absolute penalty: by coordinates until signs are
    settled, then solved for those that are not zero."""
    to, slope = at.copy(), gradient.copy()
    free = absolute == 0
    for sweep in range(400):
        moved = 0.0
        for j in np.flatnonzero(np.diag(inner) > 0):
            bend = inner[j, j]
            aim = to[j] - slope[j] / bend
            new = np.sign(aim) * max(abs(aim) - absolute[j] / bend, 0.0)
            if new != to[j]:
                slope += inner[:, j] * (new - to[j])
                moved = max(moved, abs(new - to[j]) * np.sqrt(bend))
                to[j] = new
        if moved == 0.0:
            break
        if sweep % 10 == 9:
            sign = np.sign(to)
            active = (free | (to != 0)) & (np.diag(inner) > 0)
            step = np.where(active, 0.0, to - at)
            wanted = -(gradient + absolute * sign + inner @ step)[active]
            step[active] = np.linalg.lstsq(inner[np.ix_(active, active)], wanted, rcond=1e-14)[0]
            left = gradient + inner @ step
            if np.all(free | ~active | (np.sign(at + step) == sign)) and np.all(active | (np.abs(left) <= absolute * (1 + 1e-9) + 1e-12)):
                return step
    return to - at


def fit_logistic(df: DataFrame, columns: Sequence[str], uses: Sequence[Column], c: float = 1.0, label: str = "label",
                 max_steps: int = MAX_STEPS, points: Sequence[tuple[int, float, float]] | None = None) -> list[Fit]:
    """A fit for each of ``uses``, which says which rows it learns from. Rows without a label teach nothing; the label is 0 or 1.

    ``points`` asks for other fits instead: (number of the use, weight of the absolute coefficients, weight of half the squared ones).
    ``df`` is read once per step: stage it first. Features must be numbers. A constant feature has coefficient 0.
    """
    points = points or [(k, 0.0, 1.0 / c) for k in range(len(uses))]
    width, models, masks = len(columns), len(points), len(uses)
    rows = df.filter(F.col(label).isNotNull()).select(
        *[F.col(f"`{name}`").cast("double").alias(f"c{i}") for i, name in enumerate(columns)], (F.col(label) == 1).alias("_label"),
        *[F.coalesce(use, F.lit(False)).alias(f"u{k}") for k, use in enumerate(uses)])
    stats = rows.agg(*[F.avg(f"c{i}") for i in range(width)], *[F.stddev_pop(f"c{i}") for i in range(width)]).first()
    mean = np.array([v or 0.0 for v in stats[:width]])
    spread = np.array([v or 0.0 for v in stats[width:]])
    varies = spread > 0
    spread = np.where(varies, spread, 1.0)
    squared = [np.append(l2 / spread ** 2, 0.0) for _, _, l2 in points]
    absolute = [np.append(l1 / spread, 0.0) for _, l1, _ in points]

    def totals(weights: list[np.ndarray], wanted: list[int]) -> list[np.ndarray]:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((models, 1 + (width + 1) + (width + 1) ** 2))
            for batch in batches:
                block = np.column_stack([*[col.to_numpy(zero_copy_only=False) for col in batch.columns[:width]], np.ones(batch.num_rows)])
                block[:, :width] = np.where(varies, (block[:, :width] - mean) / spread, 0.0)
                truth = batch.column(width).to_numpy(zero_copy_only=False).astype(bool)
                used = [batch.column(width + 1 + k).to_numpy(zero_copy_only=False).astype(bool) for k in range(masks)]
                for k in wanted:
                    sums[k] += _derivatives(block, truth, used[points[k][0]], weights[k])
            yield pa.RecordBatch.from_pydict({"place": np.arange(sums.size), "value": sums.ravel()})

        added = rows.mapInArrow(task, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        sums = np.zeros(models * (1 + (width + 1) + (width + 1) ** 2))
        sums[added.column("place").to_numpy()] = added.column("value").to_numpy()
        return list(sums.reshape(models, -1))

    held = [np.zeros(width + 1) for _ in range(models)]
    best, step = [np.inf] * models, [np.zeros(width + 1) for _ in range(models)]
    done, steps = [False] * models, [0] * models
    tried = held
    for _ in range(max_steps):
        for k, sums in enumerate(totals(tried, [k for k in range(models) if not done[k]])):
            if done[k]:
                continue
            steps[k] += 1
            penalty = squared[k]
            value = sums[0] + 0.5 * (penalty * tried[k] ** 2).sum() + absolute[k] @ np.abs(tried[k])
            if value > best[k] * (1 + 1e-12):
                step[k] = step[k] / 2  # too far: half of the way
            else:
                held[k], best[k] = tried[k], value
                gradient = sums[1:width + 2] + penalty * tried[k]
                inner = sums[width + 2:].reshape(width + 1, width + 1) + np.diag(penalty)
                # A feature that is constant among the rows used has no second derivative of its own.
                if absolute[k].any():
                    step[k] = _sparse_step(inner, gradient, held[k], absolute[k])
                    gain = -(gradient @ step[k]) - absolute[k] @ (np.abs(held[k] + step[k]) - np.abs(held[k]))
                    done[k] = gain <= ENOUGH_SPARSE * (1 + abs(value))
                    continue
                step[k] = -np.linalg.lstsq(inner, gradient, rcond=1e-14)[0]
                done[k] = -(gradient @ step[k]) <= ENOUGH * (1 + abs(value))
        if all(done):
            break
        tried = [held[k] if done[k] else held[k] + step[k] for k in range(models)]
    fits = []
    for weights, n in zip(held, steps):
        coefficients = np.where(varies, weights[:width] / spread, 0.0)
        fits.append(Fit(coefficients, float(weights[width] - coefficients @ mean), n))
    return fits


def fold_counts(df: DataFrame, columns: Sequence[str], fits: Sequence[Fit], folds: Sequence[int], fold: str, label: str = "label") -> np.ndarray:
    """(true positives, predicted, real) of each fit over the rows of its fold, all from one pass."""
    width = len(columns)
    weights, intercepts = np.array([fit.coefficients for fit in fits]).T, np.array([fit.intercept for fit in fits])
    rows = df.select(*[F.col(f"`{name}`").cast("double").alias(f"c{i}") for i, name in enumerate(columns)], (F.col(label) == 1).alias("_label"),
                     F.col(fold).cast("long").alias("_fold"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(fits), 3), dtype=np.int64)
        for batch in batches:
            block = np.column_stack([col.to_numpy(zero_copy_only=False) for col in batch.columns[:width]])
            truth, part = (batch.column(width + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            truth = truth.astype(bool)[:, None]
            said = block @ weights + intercepts > 0
            mine = part[:, None] == np.array(folds)
            sums += np.array([(said & truth & mine).sum(axis=0), (said & mine).sum(axis=0), (truth & mine).sum(axis=0)]).T
        yield pa.RecordBatch.from_pydict({"place": np.arange(sums.size), "n": sums.ravel()})

    added = rows.mapInArrow(task, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(3 * len(fits), dtype=np.int64)
    counts[added.column("place").to_numpy()] = added.column("n").to_numpy()
    return counts.reshape(-1, 3)


def score_column(fit: Fit, columns: Sequence[str]) -> Column:
    """The probability of class 1 as an expression."""
    margin = sum((F.col(f"`{name}`") * F.lit(float(w)) for name, w in zip(columns, fit.coefficients)), F.lit(fit.intercept))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def as_ml_model(fit: Fit, spark):
    """The fit as a ``pyspark.ml`` model, which pipelines can hold, save and load."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.common import _py2java

    jvm = spark.sparkContext._jvm
    coefficients = _py2java(spark.sparkContext, Vectors.dense(fit.coefficients))
    model = jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        jvm.org.apache.spark.ml.util.Identifiable.randomUID("logreg"), coefficients, float(fit.intercept))
    return LogisticRegressionModel(model)
