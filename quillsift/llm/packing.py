"""Packing of documents into fixed windows by non-negative least squares on the length histogram.

Each task packs its own documents, a unit of at most ``unit_ids`` ids at a time, so nothing is
shuffled and memory is bounded. Per unit:

1. A document longer than the window is cut into full windows and a remainder.
2. Remainder lengths are counted in classes of ``grain`` ids (rounded up). All combinations of at
   most ``depth`` classes that fill the window are the columns of a non-negative least-squares
   problem whose right side is that histogram; its solution says how often to repeat each one.
3. The counts are rounded down and filled with documents, most frequent combination first.
4. What is left over is packed greedily: laid end to end and cut at the window's bounds.

Only step 4 cuts remainders, and only the last sequence of a unit is partly empty; the rest of the
padding is what rounding to classes costs, at most ``depth * (grain - 1)`` ids in a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quillsift.llm.encoding import encoder, ids_of

WINDOW = 2048
GRAIN = 8
DEPTH = 3
UNIT_IDS = 16 << 20
# Sequence numbers of a task start here times its partition number.
TASK_SEQUENCES = 1 << 33

PIECE_SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)


@lru_cache(maxsize=4)
def combinations(classes: int, depth: int) -> np.ndarray:
    """Every combination of up to ``depth`` classes (1 to ``classes``) that sums to ``classes``: one per
    row, ascending, zeros in front."""
    found: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], left: int) -> None:
        lowest = parts[-1] if parts else 1
        if left >= lowest:
            found.append((0,) * (depth - len(parts) - 1) + parts + (left,))
        if len(parts) + 2 <= depth:
            for part in range(lowest, left // 2 + 1):
                extend((*parts, part), left - part)

    extend((), classes)
    return np.unique(np.array(found, dtype=np.int64), axis=0)


def nnls(columns: np.ndarray, members: np.ndarray, target: np.ndarray, tolerance: float = 1e-3) -> np.ndarray:
    """Lawson-Hanson's active-set method: the non-negative x that brings ``columns @ x`` closest to ``target``.

    Several columns that share no row (``members`` lists the rows of each) may enter at once, while that
    lowers the residual.
    """
    n = columns.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    residual, entering = target.copy(), 32
    limit = tolerance * max(1.0, float(target.max(initial=0)))
    for _ in range(3 * columns.shape[0]):
        gradient = columns.T @ residual
        gradient[active] = -np.inf
        used = np.zeros(columns.shape[0], dtype=bool)
        entered = 0
        for column in np.argsort(-gradient)[:8 * entering]:
            if gradient[column] <= limit or entered == entering:
                break
            if not used[members[column]].any():
                rows = members[column]
                used[rows[rows > 0]] = True
                active[column] = True
                entered += 1
        if not entered:
            break
        before, kept = float(residual @ residual), (x.copy(), active.copy())
        while active.any():
            chosen = np.flatnonzero(active)
            part = columns[:, chosen]
            try:
                solved = np.linalg.solve(part.T @ part, part.T @ target)
            except np.linalg.LinAlgError:
                solved = np.linalg.lstsq(part, target, rcond=None)[0]
            low = solved <= 0
            if not low.any():
                x[:] = 0
                x[chosen] = solved
                break
            now = x[chosen]
            step = float(np.min(now[low] / np.maximum(now[low] - solved[low], 1e-300)))
            x[chosen] = now + step * (solved - now)
            out = chosen[low & (x[chosen] <= 1e-9)]
            active[out] = False
            x[out] = 0
        residual = target - columns @ x
        if float(residual @ residual) >= before * (1 - 1e-9):
            if entering == 1:
                x, active = kept[0], x > 0
                break
            entering = 1
    return x


def plan(lengths: np.ndarray, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> dict[str, np.ndarray]:
    """Pieces (document, start, length, sequence, offset) that pack documents of these lengths.

    Equal lengths are taken in the order given. Documents of length zero get no piece.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    full, rest = lengths // window, lengths % window
    out: list[tuple[np.ndarray, ...]] = []
    n = int(full.sum())
    doc = np.repeat(np.arange(len(lengths)), full)
    number = np.arange(n) - np.repeat(np.cumsum(full) - full, full)
    out.append((doc, number * window, np.full(n, window), np.arange(n), np.zeros(n, dtype=np.int64)))

    left = np.flatnonzero(rest)
    if len(left):
        classes = -(-window // grain)
        kind = -(-rest[left] // grain)
        if window % grain:
            kind = np.minimum(kind, classes)
        order = left[np.argsort(kind, kind="stable")]
        histogram = np.bincount(kind, minlength=classes + 1)
        first = np.concatenate([[0], np.cumsum(histogram)])[:-1]
        free = histogram.copy()
        free[0] = 0
        shapes = combinations(classes, depth)
        # A class that only rounding makes fit is handled by the greedy step.
        shapes = shapes if window % grain == 0 else shapes[:0]
        usable = shapes[((histogram[shapes] > 0) | (shapes == 0)).all(axis=1)] if len(shapes) else shapes
        if len(usable):
            matrix = np.zeros((classes + 1, len(usable)))
            for member in range(depth):
                np.add.at(matrix, (usable[:, member], np.arange(len(usable))), 1.0)
            matrix[0] = 0
            # Half a document more or less changes no rounded count.
            counts = np.floor(nnls(matrix, usable, free.astype(float), 0.5 / max(1, int(free.max()))) + 1e-6).astype(np.int64)
            for shape in np.argsort(-counts, kind="stable"):
                if not counts[shape]:
                    break
                members = usable[shape][usable[shape] > 0]
                kinds, times = np.unique(members, return_counts=True)
                copies = int(min(counts[shape], (free[kinds] // times).min()))
                filled = np.zeros(copies, dtype=np.int64)
                for member in members:
                    docs = order[first[member]:first[member] + copies]
                    first[member] += copies
                    free[member] -= copies
                    out.append((docs, full[docs] * window, rest[docs], n + np.arange(copies), filled))
                    filled = filled + rest[docs]
                n += copies
        kept = [order[first[k]:first[k] + free[k]] for k in range(1, classes + 1) if free[k]]
        docs = np.sort(np.concatenate(kept)) if kept else left[:0]
        ends = np.cumsum(rest[docs])
        starts = ends - rest[docs]
        head, tail = starts // window, (ends - 1) // window  # a remainder is shorter than a window
        cut = np.where(head == tail, rest[docs], (head + 1) * window - starts)
        out.append((docs, full[docs] * window, cut, n + head, starts - head * window))
        over = head != tail
        out.append((docs[over], full[docs][over] * window + cut[over], rest[docs][over] - cut[over], n + tail[over],
                    np.zeros(int(over.sum()), dtype=np.int64)))
    names = ("document", "start", "length", "sequence", "offset")
    return {name: np.concatenate([part[i] for part in out]).astype(np.int64) for i, name in enumerate(names)}


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, grain: int = GRAIN,
                   depth: int = DEPTH, unit_ids: int = UNIT_IDS, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    Every id of every document, its end id included, lies in exactly one piece; offsets are gapless
    within a sequence. ``ids`` are little-endian unsigned 32-bit. A null or empty text is its end id
    alone; rows that share an id are packed each for itself; an empty table gives no piece. Other
    columns are not read. Where a sequence lies depends on how the table is split, not on retries.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(docs: list, parts: list[bytes], base: int) -> tuple[Iterator[pa.RecordBatch], int]:
        lengths = np.array([len(p) // 4 for p in parts], dtype=np.int64)
        made = plan(lengths, window, grain, depth)
        order = np.argsort(made["document"], kind="stable")
        made = {name: values[order] for name, values in made.items()}
        ids = np.array([-1 if d is None else d for d in docs], dtype=np.int64)
        null = np.array([d is None for d in docs])

        def batches() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(order), 4096):
                of = slice(at, at + 4096)
                doc, start, length = (made[name][of] for name in ("document", "start", "length"))
                data = [parts[d][4 * s:4 * (s + n)] for d, s, n in zip(doc, start, length)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[doc], mask=null[doc]), pa.array(start), pa.array(length), pa.array(lengths[doc]),
                    pa.array(base + made["sequence"][of]), pa.array(made["offset"][of]), pa.array(data, pa.binary()),
                ], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        return batches(), base + int(made["sequence"].max(initial=-1)) + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        base, docs, parts, held = TaskContext.get().partitionId() * TASK_SEQUENCES, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                docs.append(doc.as_py())
                parts.append(encode.encode(text.as_py()) + end)
                held += len(parts[-1]) // 4
                if held >= unit_ids:
                    made, base = pieces(docs, parts, base)
                    yield from made
                    docs, parts, held = [], [], 0
        if docs:
            yield from pieces(docs, parts, base)[0]
        encode.rest()

    chosen = df.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`"))
    return chosen.mapInArrow(task, PIECE_SCHEMA)
