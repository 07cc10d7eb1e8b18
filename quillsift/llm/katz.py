"""Katz back-off language model over all documents, and the score of each of them.

Bigrams back off to unigrams, unigrams to one unknown word; Good-Turing discounts free the mass, and back-off weights are exactly
normalised: for each context the freed mass over what the lower order gives to words not seen there.

    P(w | v) = d(c(vw)) c(vw) / c(v)             where vw was seen in training
             = a(v) P(w)                         where only v was;  a(v) = freed(v) / (1 - sum of P(seen words))
             = P(w)                              where v was not
    P(w)     = d(c(w)) c(w) / N, or the freed mass of all words for the unknown one

Counts above K lose a fixed tenth, so that every context keeps something to give.

How it is computed. Texts are read once and staged in chunks, as numbers of the chunk's different words. Each chunk asks the
partitions of the word table once for each of its words, and gets back a number that is the same everywhere and the word's
training count. It then asks the partitions of the pair table once for each of its different pairs, under these numbers, and gets
back their counts, and what a context has freed where a pair was not seen in training. Scores are added up where the chunk lies. So
what moves are a chunk's different words and pairs, not occurrences, and its body twice, whatever the number of partitions.
A pair lies with its context, so that the context's mass is summed there; pairs of contexts with a large share of all
tokens (a bounded list) are spread by the pair, and their sums are added up over partitions.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quillsift.llm.minhash import STEP, Groups, _mixed, word_hashes
from quillsift.session import materialise

K = 5
TAIL = 0.1
# Tokens of a chunk, and of a partition of the pair table, about.
CHUNK_TOKENS = 4 << 20
PART_TOKENS = 2_000_000
# Contexts with a larger share of all training tokens than this, at least, are spread: at most 1 / SHARE.
SHARE = 1 / 20_000
END = np.uint64(0x5CA1AB1E00000002)

BODY, WORDS, PAIRS, FREED, STATS = range(5)
CHUNK_SCHEMA = "chunk long, tokens long, learned long, starts long, words binary, body binary"
ASK_SCHEMA = "part long, chunk long, payload binary"
TOLD_SCHEMA = "chunk long, part long, kind int, payload binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 up, as planes of as many bytes as the largest needs: upper planes are mostly zeros."""
    head, planes = [], []
    for values in arrays:
        width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
        head += [len(values), width]
        planes.append(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return zstandard.compress(np.array(head, dtype="<u4").tobytes() + b"".join(planes), 1)


def _unpack(data: bytes, arrays: int) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    at, out = 8 * arrays, []
    for size, width in np.frombuffer(data, "<u4", 2 * arrays).reshape(-1, 2).astype(int):
        wide = np.zeros((size, 8), dtype=np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size).T
        out.append(wide.view("<i8").reshape(-1))
        at += size * width
    return out


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(name, pa.int64())) for c, name in zip(zip(*rows), names)], names=names)


def _grow(rows: Iterator[tuple], schema: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in schema.split(", ")]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most:
            yield _batch(held, names)
            held, size = [], 0
    if held:
        yield _batch(held, names)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each partition, ascending."""
    order = np.argsort(part, kind="stable")
    bounds = np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1))
    for start, stop in zip(bounds, [*bounds[1:], len(order)]):
        yield int(part[order[start]]), order[start:stop]


def _part_of(items: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(_mixed(items * STEP)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)


def _chunk(number: int, docs: list, hashes: list[np.ndarray], train: list[bool]) -> pa.RecordBatch:
    """Words by falling number of occurrences, so that frequent ones have small numbers; a document ends with the end."""
    sizes, learns = np.array([len(h) + 1 for h in hashes]), np.array(train, dtype=bool)
    end = np.array([END])
    flat = np.concatenate([part for h in hashes for part in (h, end)])
    hashes.clear()  # the chunk is what memory is spent on
    words, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    del flat
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    place = rank[place]
    learned = np.bincount(place[np.repeat(learns, sizes)], minlength=len(words))
    body = zstandard.compress(pickle.dumps((docs, learns, sizes), protocol=5), 1)
    body = len(body).to_bytes(8, "little") + body + _pack(place)
    row = [number, len(place), int(learned.sum()), int(learns.sum()), _pack(words[order], learned), body]
    names = [field.split()[0] for field in CHUNK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in row], names=names)


def _chunks(batches: Iterator[pa.RecordBatch], chunk_tokens: int) -> Iterator[pa.RecordBatch]:
    docs, hashes, train, held = [], [], [], 0
    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        for doc, text, flag in zip(*(batch.column(i) for i in range(3))):
            docs.append(doc.as_py())
            hashes.append(word_hashes(text.as_py()))
            train.append(bool(flag.as_py()))
            held += len(hashes[-1]) + 1
            if held >= chunk_tokens:
                yield _chunk(number, docs, hashes, train)
                docs, hashes, train, held, number = [], [], [], 0, number + 1
    if docs:
        yield _chunk(number, docs, hashes, train)


def _ask_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for chunk, payload in zip(*(batch.column(i).to_pylist() for i in range(2))):
                words, learned = _unpack(payload, 2)
                for part, mine in _by_part(_part_of(words.view(np.uint64), parts)):
                    yield part, chunk, _pack(np.diff(mine, prepend=0), words[mine].view(np.uint64), learned[mine])

    return _grow(rows(), ASK_SCHEMA)


def _histogram(counts: np.ndarray) -> np.ndarray:
    """Types counted 1 to K + 1 times, and all counted at all."""
    return np.array([*[(counts == r).sum() for r in range(1, K + 2)], (counts > 0).sum()], dtype=np.int64)


def _slices(sizes: list[int]) -> Iterator[slice]:
    ends = np.cumsum(sizes)
    return (slice(end - size, end) for size, end in zip(sizes, ends))


def _tell_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """A number from 1 up and the training count of each word asked for; small numbers are those of frequent words."""
    def rows() -> Iterator[tuple]:
        for group in Groups(batches, 1):
            part = group.column("part")[0].as_py()
            cells = [_unpack(payload, 3) for payload in group.column("payload").to_pylist()]
            words, place = np.unique(np.concatenate([c[1] for c in cells]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([c[2] for c in cells]), len(words)).astype(np.int64)
            rank = np.empty(len(words), dtype=np.int64)
            rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
            number, count = (1 + part + parts * rank)[place], counts[place]
            for chunk, cell, mine in zip(group.column("chunk").to_pylist(), cells, _slices([len(c[0]) for c in cells])):
                yield chunk, part, WORDS, _pack(cell[0], number[mine], count[mine])
            yield -1, part, STATS, _pack(_histogram(counts))

    return _grow(rows(), TOLD_SCHEMA)


class Numbered:
    """A chunk whose words have their numbers and counts, from its body and what the word table told.

    ``v`` and ``w`` are the context and the word of each different pair, ``pair`` the pair of each token. The start of a text
    is the context after the last word, with the number 0.
    """

    def __init__(self, group: pa.Table, starts: int):
        rows = list(zip(*(group.column(name).to_pylist() for name in ("kind", "part", "payload"))))
        body = next(payload for kind, _, payload in rows if kind == BODY)
        cut = 8 + int.from_bytes(body[:8], "little")
        self.docs, self.train, self.sizes = pickle.loads(zstandard.decompress(body[8:cut]))
        (word,) = _unpack(body[cut:], 1)
        told = [_unpack(payload, 3) for kind, _, payload in rows if kind == WORDS]
        self.pair_cells = {part: payload for kind, part, payload in rows if kind == PAIRS}
        words = sum(len(cell[0]) for cell in told)
        self.number, self.count = np.zeros(words + 1, dtype=np.int64), np.zeros(words + 1, dtype=np.int64)
        for steps, number, count in told:
            at = np.cumsum(steps)
            self.number[at], self.count[at] = number, count
        self.count[words] = starts
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[np.cumsum(self.sizes) - self.sizes] = words
        pairs, self.pair = np.unique(context * (words + 1) + word, return_inverse=True)
        self.v, self.w = np.divmod(pairs, words + 1)
        self.word, self.start = word, words

    def cells(self, parts: int, heavy_from: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The pairs for each partition of the pair table, and which of them have a heavy context. A context that training lacks has none."""
        asked = np.flatnonzero(self.count[self.v] > 0)
        v, w = self.v[asked], self.w[asked]
        heavy = (self.count[v] >= heavy_from) | (v == self.start)
        route = self.number[v].astype(np.uint64) * STEP
        route = np.where(heavy, _mixed(route) + self.number[w].astype(np.uint64), route)
        for part, mine in _by_part(_part_of(route, parts)):
            yield part, asked[mine], heavy[mine]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and how long it is."""
    first = np.flatnonzero(np.diff(values, prepend=-1))
    return first, np.diff(first, append=len(values))


def _ask_pairs(batches: Iterator[pa.RecordBatch], parts: int, starts: int, heavy_from: float) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for group in Groups(batches, 1):
            chunk = group.column("chunk")[0].as_py()
            mine = Numbered(group, starts)
            learned = np.bincount(mine.pair[mine.train[mine.doc]], minlength=len(mine.v))
            for part, pairs, heavy in mine.cells(parts, heavy_from):
                first, size = _runs(mine.v[pairs])
                words, place = np.unique(mine.w[pairs], return_inverse=True)
                yield part, chunk, _pack(mine.number[mine.v[pairs[first]]], size, heavy[first], mine.number[words], mine.count[words], place, learned[pairs])

    return _grow(rows(), ASK_SCHEMA)


def _less(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Counts after the discount."""
    return np.where(counts <= K, factors[np.minimum(counts, K)] * counts, counts - TAIL)


def _tell_pairs(batches: Iterator[pa.RecordBatch], words: np.ndarray, tokens: int) -> Iterator[pa.RecordBatch]:
    """Counts of pairs; for light contexts of pairs that were not seen: pair types by count (1 to K, more) and what the lower order
    gives to the words seen there. For heavy contexts the part of these that lies here."""
    def rows() -> Iterator[tuple]:
        for group in Groups(batches, 1):
            part = group.column("part")[0].as_py()
            cells = [_unpack(payload, 7) for payload in group.column("payload").to_pylist()]
            contexts, v = np.unique(np.concatenate([np.repeat(c[0], c[1]) for c in cells]), return_inverse=True)
            heavy = np.zeros(len(contexts), dtype=bool)
            heavy[v] = np.concatenate([np.repeat(c[2], c[1]) for c in cells]) > 0
            different, w = np.unique(np.concatenate([c[3][c[5]] for c in cells]), return_inverse=True)
            below = np.zeros(len(different), dtype=np.int64)
            below[w] = np.concatenate([c[4][c[5]] for c in cells])
            learned = np.concatenate([c[6] for c in cells])
            sizes = [(len(c[0]), len(c[5])) for c in cells]
            runs = [c[1] for c in cells]
            del cells
            pairs, pair = np.unique(v * len(different) + w, return_inverse=True)
            counts = np.bincount(pair, learned, len(pairs)).astype(np.int64)
            yield -1, part, STATS, _pack(_histogram(counts))

            seen = np.flatnonzero(counts)
            of, on = np.divmod(pairs[seen], len(different))
            table = [np.bincount(of[counts[seen] == r], minlength=len(contexts)) for r in range(1, K + 1)]
            table.append(np.bincount(of[counts[seen] > K], minlength=len(contexts)))
            given = np.bincount(of, _less(below[on], words) / max(1, tokens), len(contexts))
            if heavy.any():
                yield -1, part, FREED, _pack(contexts[heavy], *[row[heavy] for row in table], given[heavy].view(np.uint64))
            count = counts[pair]
            for chunk, mine, run in zip(group.column("chunk").to_pylist(), _slices([n for _, n in sizes]), runs):
                own = v[mine][np.cumsum(run) - run]
                lacks = np.add.reduceat(count[mine] == 0, np.cumsum(run) - run) > 0
                need = own[lacks & ~heavy[own]]
                yield chunk, part, PAIRS, _pack(count[mine], *[row[need] for row in table], given[need].view(np.uint64))

    return _grow(rows(), TOLD_SCHEMA)


def _spread_freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            v, *table, given = _unpack(payload, K + 3)
            yield pa.RecordBatch.from_arrays([pa.array(v), *map(pa.array, table), pa.array(given.view(np.float64))],
                                             names=["v", *[f"t{k}" for k in range(K + 1)], "given"])


def discounts(histogram: np.ndarray) -> np.ndarray:
    """Katz's Good-Turing factors for counts 0 (unused) to K, from the numbers of types counted 1 to K + 1 times.

    Where the estimate is no proper discount, the factor takes half a count.
    """
    n = histogram.astype(float)
    factor = 1 - 0.5 / np.maximum(np.arange(K + 1), 1)
    if n[0] > 0:
        tail = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            if n[r - 1] > 0 and tail < 1:
                estimate = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail)
                if 0 < estimate < 1:
                    factor[r] = estimate
    return factor


def _weight(table: np.ndarray, given: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Log of c(v) a(v)."""
    r = np.arange(1, K + 1)
    left = (r * (1 - pairs[1:])) @ table[:K] + table[K] * TAIL
    return np.log10(left / np.maximum(1 - given, 1e-300))


SCORE_SCHEMA = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _finish(batches: Iterator[pa.RecordBatch], parts: int, starts: int, heavy_from: float, pairs: np.ndarray, words: np.ndarray, unknown: float,
            tokens: int, types: int, heavy_weights) -> Iterator[pa.RecordBatch]:
    heavies, weights = heavy_weights.value
    for group in Groups(batches, 1):
        mine = Numbered(group, starts)
        low = np.where(mine.count > 0, _less(mine.count, words) / max(1, tokens), unknown)
        value = np.log10(low)[mine.w]
        for part, asked, heavy in mine.cells(parts, heavy_from):
            count, *table, given = _unpack(mine.pair_cells[part], K + 3)
            v = mine.v[asked]
            of = np.log10(mine.count[v])
            seen = count > 0
            value[asked[seen]] = np.log10(_less(count[seen], pairs)) - of[seen]
            # The contexts that were told are those of unseen pairs, in their order.
            far = np.flatnonzero(~seen & ~heavy)
            if len(far):
                first, size = _runs(v[far])
                value[asked[far]] += np.repeat(_weight(np.array(table), given.view(np.float64), pairs), size) - of[far]
            far = np.flatnonzero(~seen & heavy)
            if len(far):
                value[asked[far]] += weights[np.searchsorted(heavies, mine.number[v[far]])] - of[far]
        docs = len(mine.docs)
        known = np.bincount(mine.doc, mine.count[mine.word] > 0, docs).astype(np.int64)
        base = np.bincount(mine.doc, np.log10(mine.count + 1.0)[mine.word], docs) - mine.sizes * np.log10(tokens + types + 1)
        score = np.bincount(mine.doc, value[mine.pair], docs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(mine.docs, pa.int64()), pa.array(mine.train), pa.array(mine.sizes), pa.array(known), pa.array(base), pa.array(score)],
            names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])


def _types(told: DataFrame) -> np.ndarray:
    """The sum of the histograms of all partitions: one short row of each."""
    total = np.zeros(K + 2, dtype=np.int64)
    for row in told.filter(F.col("kind") == STATS).select("payload").toLocalIterator():
        total += _unpack(row["payload"], 1)[0]
    return total


def score_documents(df: DataFrame, train_column: str, id_column: str = "doc_id", text_column: str = "text",
                    chunk_tokens: int = CHUNK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row per input row: ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from rows whose ``train_column`` is true (null: not). A text is its words, A-Z lower-cased and
    separated by ASCII white space, then one end; a null or empty text is the end alone. ``base_score`` is the
    add-one unigram log10 probability. Repeated rows each count. Without training rows every score is
    that of unknown words, 0. Other columns are not read. ``df`` is read once.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`"), F.col(f"`{train_column}`"))
    chunks = materialise(docs.mapInArrow(partial(_chunks, chunk_tokens=chunk_tokens), CHUNK_SCHEMA))
    tokens, learned, starts = (n or 0 for n in chunks.agg(F.sum("tokens"), F.sum("learned"), F.sum("starts")).first())
    parts = max(1, -(-tokens // part_tokens), int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = lambda table, key: table.repartition(parts, key).sortWithinPartitions(key)

    # Different words are far fewer than tokens.
    word_parts = -(-parts // 4)
    asked = chunks.select("chunk", "words").mapInArrow(partial(_ask_words, parts=word_parts), ASK_SCHEMA)
    told = materialise(by(asked, "part").mapInArrow(partial(_tell_words, parts=word_parts), TOLD_SCHEMA))
    word_types = _types(told)
    words, types = discounts(word_types), int(word_types[-1])
    freed = float((word_types[:K] * np.arange(1, K + 1) * (1 - words[1:])).sum() + TAIL * (types - word_types[:K].sum()))
    unknown = freed / learned if learned else 1.0

    body = chunks.select("chunk", F.lit(-1).cast("long").alias("part"), F.lit(BODY).alias("kind"), F.col("body").alias("payload"))
    numbered = body.unionByName(told.filter(F.col("kind") == WORDS))
    heavy_from = max(1.0, max(SHARE, 0.25 / parts) * learned)
    asked = by(numbered, "chunk").mapInArrow(partial(_ask_pairs, parts=parts, starts=starts, heavy_from=heavy_from), ASK_SCHEMA)
    answers = materialise(by(asked, "part").mapInArrow(partial(_tell_pairs, words=words, tokens=learned), TOLD_SCHEMA))
    pairs = discounts(_types(answers))

    # At most 1 / SHARE contexts, and the start; each was seen in training, so each has freed something.
    schema = "v long, " + ", ".join(f"t{k} long" for k in range(K + 1)) + ", given double"
    freed_rows = answers.filter(F.col("kind") == FREED).select("payload").mapInArrow(_spread_freed, schema)
    sums = freed_rows.groupBy("v").agg(*[F.sum(name).alias(name) for name in freed_rows.columns[1:]]).collect()
    table = np.array(sorted(tuple(row) for row in sums), dtype=float).reshape(-1, K + 3).T
    heavy_weights = spark.sparkContext.broadcast((table[0].astype(np.int64), _weight(table[1:-1], table[-1], pairs)))

    ready = numbered.unionByName(answers.filter(F.col("kind") == PAIRS))
    scored = by(ready, "chunk").mapInArrow(
        partial(_finish, parts=parts, starts=starts, heavy_from=heavy_from, pairs=pairs, words=words, unknown=unknown, tokens=learned, types=types,
                heavy_weights=heavy_weights), SCORE_SCHEMA)
    return scored.withColumn("train_tokens", F.lit(learned).cast("long"))
