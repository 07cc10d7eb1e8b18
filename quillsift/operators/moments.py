"""Sums over pairs of columns with gaps, as one matrix per partition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SUMS = ["n", "sum_x", "sum_y", "sum_xx", "sum_yy", "sum_xy"]


class _Moments:
    """Five sums of outer products over blocks of rows, and the range of each column under each mask."""

    def __init__(self, width: int):
        self.rows, self.first, self.square, self.cross = (np.zeros((width, width)) for _ in range(4))
        self.low, self.high = np.full((width, width), np.inf), np.full((width, width), -np.inf)

    def add(self, block: np.ndarray) -> None:
        """``block`` has a row per observation; NaN is a gap."""
        known = ~np.isnan(block)
        mask, values = known.astype(np.float64), np.where(known, block, 0.0)
        self.rows += mask.T @ mask
        self.first += values.T @ mask  # [x, y]: the sum of x where y is known
        self.square += (values * values).T @ mask
        self.cross += values.T @ values
        # Columns often share their gaps, so there are few different masks.
        masks, which = np.unique(known, axis=1, return_inverse=True)
        for k in range(masks.shape[1]):
            rows = block[masks[:, k]]
            if len(rows):
                same = np.flatnonzero(which.ravel() == k)
                self.low[:, same] = np.minimum(self.low[:, same], np.fmin.reduce(rows, axis=0, initial=np.inf)[:, None])
                self.high[:, same] = np.maximum(self.high[:, same], np.fmax.reduce(rows, axis=0, initial=-np.inf)[:, None])


def pair_moments(df: DataFrame, features: Sequence[str], shifts: Sequence[float]) -> DataFrame:
    """(x, y, n, sums, ranges) for every pair of positions x <= y of ``features``, over the rows where both are known.

    Values are taken less ``shifts`` (about the means), so that squares do not swallow the spread. A partition yields one row per
    pair, whatever its size; the pairs are then added up apart from each other, so nothing grows with the table in one task.
    """
    width = len(features)
    upper = [(x, y) for x in range(width) for y in range(x, width)]
    at = np.array([x * width + y for x, y in upper]), np.array([y * width + x for x, y in upper])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = _Moments(width)
        for batch in batches:
            block = np.column_stack([column.to_numpy(zero_copy_only=False).astype(np.float64) for column in batch.columns])
            moments.add(block - np.asarray(shifts))
        forth, back = at
        columns = {
            "x": np.array([x for x, _ in upper]), "y": np.array([y for _, y in upper]), "n": moments.rows.ravel()[forth],
            "sum_x": moments.first.ravel()[forth], "sum_y": moments.first.ravel()[back], "sum_xx": moments.square.ravel()[forth],
            "sum_yy": moments.square.ravel()[back], "sum_xy": moments.cross.ravel()[forth],
            "low_x": moments.low.ravel()[forth], "high_x": moments.high.ravel()[forth],
            "low_y": moments.low.ravel()[back], "high_y": moments.high.ravel()[back],
        }
        yield pa.RecordBatch.from_pydict(columns)

    rows = df.select(*[F.col(f"`{name}`").cast("double").alias(f"c{i}") for i, name in enumerate(features)])
    schema = "x long, y long, " + ", ".join(f"{name} double" for name in [*SUMS, "low_x", "high_x", "low_y", "high_y"])
    return rows.mapInArrow(task, schema).groupBy("x", "y").agg(
        *[F.sum(name).alias(name) for name in SUMS],
        *[F.min(f"low_{side}").alias(f"low_{side}") for side in "xy"], *[F.max(f"high_{side}").alias(f"high_{side}") for side in "xy"])
