"""Benchmark decontamination with an FM-index per shard of documents.

Each task turns its documents, a shard of at most ``shard_words`` words at a time, into one sequence of
word numbers with a separator between documents, sorts its suffixes, and keeps what an FM-index keeps: the
Burrows-Wheeler transform in a wavelet matrix, and every ``sample``-th suffix position. All test phrases are
then searched backwards at once, each step two vectorised ranks; occurrences are located by walking
back to a sampled position, and the spans they cover are merged per document.

Only words that occur in some phrase get a number. A stretch without enough of them in a row to
hold the shortest phrase can hold none, and stands in the sequence as one separator.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quillsift.session import materialise

WINDOW = 10
SHARD_WORDS = 4 << 20
SAMPLE = 8
# What one part of the benchmark may take of every task: WORD_BYTES for a word, and the word itself. A larger benchmark is
# searched part by part.
PART_BYTES = 64 << 20
WORD_BYTES = 128

# Every byte that is no word byte becomes a space; A-Z become a-z.
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in set(_SEPARATORS) else b for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: digits, a-z and whatever is not ASCII."""
    return (text or "").encode().translate(TABLE).split()


class Wavelet:
    """A wavelet matrix: rank of a symbol before a position in one step per bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        now = symbols
        for bit in range(bits - 1, -1, -1):
            ones = (now >> bit) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(ones, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(now) - int(self.levels[-1][-1]))
            now = np.concatenate([now[ones == 0], now[ones == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``position``."""
        start, end = np.zeros_like(position), position.copy()
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> bit) & 1).astype(bool)
            count, zeros = self.levels[level], self.zeros[level]
            low, high = count[start], count[end]
            start = np.where(one, zeros + low, start - low)
            end = np.where(one, zeros + high, end - high)
        return end - start

    def access(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol, start, at = np.zeros_like(position), np.zeros_like(position), position.copy()
        for level in range(self.bits):
            count, zeros = self.levels[level], self.zeros[level]
            one = (count[at + 1] - count[at]).astype(bool)
            low, high = count[start], count[at]
            start = np.where(one, zeros + low, start - low)
            at = np.where(one, zeros + high, at - high)
            symbol = (symbol << 1) | one
        return symbol, at - start


class FMIndex:
    """Over symbols 1 to ``largest``, 0 separating."""

    def __init__(self, symbols: np.ndarray, largest: int, sample: int = SAMPLE):
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        n = len(text)
        # Separators differ from one another and sort before all symbols, in text order. So suffixes differ as soon
        # as the longer of two stretches has been read, and doubling ends there.
        gaps = text == 0
        rank = np.where(gaps, np.cumsum(gaps) - 1, text + int(gaps.sum()))
        order, reach = np.argsort(rank, kind="stable"), 1
        while True:
            ranked = rank[order]
            changed = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = changed
            if changed[-1] == n - 1:
                break
            after = np.zeros(n, dtype=np.int64)
            after[:n - reach] = rank[reach:] + 1
            rank = rank * (n + 1) + after
            order = np.argsort(rank, kind="stable")
            reach *= 2
        self.n = n
        before = text[order - 1]  # the symbol before each suffix; before the first one stands the last
        self.wavelet = Wavelet(before, max(1, int(largest).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        # Only sampled positions are kept, by their place in suffix order. A stretch's first position is always
        # sampled, so that no walk back meets a separator.
        self.sampled = (order % sample == 0) | (before == 0)
        self.before_sampled = np.concatenate([[0], np.cumsum(self.sampled)])
        self.values = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of all phrases (rows, right-aligned) by backward search."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for back in range(phrases.shape[1]):
            live = np.flatnonzero((back < lengths) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - back]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of places in suffix order: back one symbol at a time to a sampled one."""
        out, steps = np.empty(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        at, waiting = places.copy(), np.arange(len(places))
        while len(waiting):
            here = self.sampled[at[waiting]]
            done = waiting[here]
            out[done] = self.values[self.before_sampled[at[done]]] + steps[done]
            waiting = waiting[~here]
            symbol, rank = self.wavelet.access(at[waiting])
            at[waiting] = self.first[symbol] + rank
            steps[waiting] += 1
        return out


class Phrases:
    """The windows of benchmark items, each different one once, and the items that have it."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], int] = {}
        pairs: set[tuple[int, int]] = set()
        self.items: list = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(word, len(self.vocabulary) + 1) for word in words]
            if ids:
                self.items.append(item)
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                phrase = tuple(ids[at:at + window])
                pairs.add((found.setdefault(phrase, len(found)), len(self.items) - 1))
        self.lengths = np.array([len(p) for p in found], dtype=np.int64)
        self.symbols = np.array([(0,) * (window - len(p)) + p for p in found], dtype=np.int64).reshape(-1, window)
        owned = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.owner_starts = np.searchsorted(owned[:, 0], np.arange(len(found) + 1))
        self.owners = owned[:, 1]
        self.shortest = int(self.lengths.min(initial=window))


def parts_of(items: Iterable[tuple[object, str | None]], window: int = WINDOW, part_bytes: int = PART_BYTES) -> Iterator[Phrases]:
    """The benchmark in parts of at most about ``part_bytes``; at least one, which may be empty.

    A longer item is cut so that each of its windows lies in one piece. One window always fits.
    """
    most = max(window, part_bytes // WORD_BYTES)
    held, size, made = [], 0, False
    for item, text in items:
        words = words_of(text)
        for start in range(0, max(1, len(words) - window + 1), most - window + 1):
            piece = words[start:start + most]
            more = len(piece) * WORD_BYTES + sum(map(len, piece))
            if held and size + more > part_bytes:
                yield Phrases(held, window)
                held, size, made = [], 0, True
            held.append((item, piece))
            size += more
    if held or not made:
        yield Phrases(held, window)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_phrases(shard: np.ndarray, phrases: Phrases, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(positions, phrase numbers) of all occurrences in a shard of word numbers, 0 for other words and bounds."""
    inside = np.concatenate([[0], (shard > 0).astype(np.int8), [0]])
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = ends - starts >= phrases.shortest
    starts, ends = starts[long], ends[long]
    none = np.zeros(0, dtype=np.int64)
    if not len(starts) or not len(phrases.lengths):
        return none, none
    # Stretches one after the other, a separator after each.
    sizes = ends - starts + 1
    offsets = np.cumsum(sizes) - sizes
    origin = np.repeat(starts - offsets, sizes) + np.arange(int(sizes.sum()))
    symbols = shard[np.minimum(origin, len(shard) - 1)].astype(np.int64)
    symbols[offsets + sizes - 1] = 0
    index = FMIndex(symbols, len(phrases.vocabulary), sample)
    low, high = index.search(phrases.symbols, phrases.lengths)
    counts = high - low
    phrase = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + low[phrase]
    return origin[index.locate(places)], phrase


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its words in the given [start, end) spans and what stands between them."""
    data = text.encode()
    # Upper-case letters are word bytes too, once lower-cased.
    bounds = [m.span() for m in WORD.finditer(data.translate(TABLE))]
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:bounds[start][0]])
        at = bounds[end - 1][1]
    return b"".join([*kept, data[at:]]).decode()


HIT_FIELDS = {
    "n_words": T.LongType(),
    "hit_spans": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
    "item_ids": T.ArrayType(T.LongType()),
}
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_contamination(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
                       sample: int = SAMPLE, text_column: str = "text", item_column: str = "item_id",
                       item_text: str = "text", cut: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``df`` with ``n_words``, ``hit_spans`` (word positions, merged, end exclusive) and
    ``item_ids`` (items with a window in the text, ascending).

    An item of fewer than ``window`` words, but not none, is one window. A null or empty text has no words and no
    hit; repeated rows are each reported; an empty table or benchmark gives no hits. Input columns
    of the output's names are replaced, all others kept. With ``cut`` the text loses its hit spans.

    The benchmark is the stated set of queries: it is read to the driver in parts of at most ``part_bytes``, and each part
    is searched in every shard. Documents are not shuffled; where there is more than one part, they are written and
    read again between parts, each of which adds its spans and items.
    """
    items = benchmark.select(F.col(f"`{item_column}`").cast("long"), F.col(f"`{item_text}`"))
    search = partial(_search, window=window, shard_words=shard_words, sample=sample, text_column=text_column)
    df = df.drop(*[c for c in df.columns if c in HIT_FIELDS])
    part, more = None, False
    for following in parts_of(map(tuple, items.toLocalIterator()), window, part_bytes):
        if part is not None:
            df, more = materialise(search(df, part, more=more)), True
        part = following
    return search(df, part, more=more, cut=cut)


def _search(df: DataFrame, part: Phrases, window: int, shard_words: int, sample: int, text_column: str, more: bool,
            cut: bool = False) -> DataFrame:
    """What one part of the benchmark finds; with ``more``, added to what the columns hold from the parts before."""
    shared = df.sparkSession.sparkContext.broadcast(part)
    fields = [field for field in df.schema.fields if field.name not in HIT_FIELDS]
    keep = [df.columns.index(field.name) for field in fields]
    before = [df.columns.index(name) for name in HIT_FIELDS][1:] if more else None
    place = df.columns.index(text_column)

    def finish(held: list, words: list[np.ndarray], phrases: Phrases) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        gap = np.zeros(1, dtype=np.int32)
        shard = np.concatenate(list(chain.from_iterable((w, gap) for w in words)) or [gap])
        positions, found = find_phrases(shard, phrases, sample)
        change = np.bincount(positions, minlength=len(shard) + 1)[:len(shard) + 1]
        change = change - np.bincount(positions + phrases.lengths[found], minlength=len(shard) + 1)[:len(shard) + 1]
        covered = np.concatenate([[0], (np.cumsum(change)[:len(shard)] > 0).astype(np.int8), [0]])
        edges = np.diff(covered)
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        doc = np.searchsorted(starts, begins, side="right") - 1
        first = np.searchsorted(doc, np.arange(len(words) + 1))
        # Which items: each (document, phrase) once, then its owners.
        pairs = np.unique((np.searchsorted(starts, positions, side="right") - 1) * max(1, len(phrases.lengths)) + found)
        in_doc, phrase = np.divmod(pairs, max(1, len(phrases.lengths)))
        counts = phrases.owner_starts[phrase + 1] - phrases.owner_starts[phrase]
        owner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        owner = phrases.owners[owner + np.repeat(phrases.owner_starts[phrase], counts)]
        owned = np.unique(np.repeat(in_doc, counts) * max(1, len(phrases.items)) + owner)
        of_doc, owner = np.divmod(owned, max(1, len(phrases.items)))
        from_, at = np.searchsorted(of_doc, np.arange(len(words) + 1)), 0
        for batch in held:
            spans, ids, texts = [], [], []
            for i in range(at, at + batch.num_rows):
                mine = slice(first[i], first[i + 1])
                spans.append([(int(a - starts[i]), int(b - starts[i])) for a, b in zip(begins[mine], ends[mine])])
                ids.append(sorted({phrases.items[o] for o in owner[from_[i]:from_[i + 1]]}, key=lambda x: (x is not None, x)))
                if before:
                    old = batch.column(before[0])[i - at].as_py()
                    spans[-1] = merged([*spans[-1], *((span["start"], span["end"]) for span in old)])
                    ids[-1] = sorted({*ids[-1], *batch.column(before[1])[i - at].as_py()}, key=lambda x: (x is not None, x))
                if cut:
                    text = batch.column(place)[i - at].as_py()
                    texts.append(cut_words(text, spans[-1]) if spans[-1] else text)
            columns = list(batch.columns)
            if cut:
                columns[place] = pa.array(texts, batch.schema.field(place).type)
            rows = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPAN_TYPE)
            yield pa.RecordBatch.from_arrays(
                [*(columns[c] for c in keep), pa.array(sizes[at:at + batch.num_rows]), rows, pa.array(ids, pa.list_(pa.int64()))],
                names=[*(field.name for field in fields), *HIT_FIELDS])
            at += batch.num_rows

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        held, words, total = [], [], 0
        for batch in batches:
            for text in batch.column(place):
                found = words_of(text.as_py())
                words.append(np.fromiter(map(phrases.vocabulary.get, found, repeat(0)), np.int32, len(found)))
                total += len(found)
            held.append(batch)
            if total >= shard_words:
                yield from finish(held, words, phrases)
                held, words, total = [], [], 0
        if held:
            yield from finish(held, words, phrases)

    schema = T.StructType([*fields, *[T.StructField(name, kind) for name, kind in HIT_FIELDS.items()]])
    return df.mapInArrow(task, schema)
