"""Language by prediction by partial matching: the language whose byte contexts give a text the shortest code.

Training counts windows of ``order`` + 1 bytes per language, one table for all orders: shorter contexts are sums over longer
ones, so every byte that follows a context also follows the shorter ones. A language's context tree keeps a window while its
count is at least a fixed share of all training bytes; hence trees have at most 1 / ``SHARE`` windows of each length at any
size of the input, and all counts are over whole texts.

A byte costs its logarithm under escape method C with exclusion: in a context that has seen ``t`` bytes, ``d`` of them
different, a byte seen ``c`` times has probability ``c / (t + d)``, and ``d / (t + d)`` goes to the next shorter context, where
bytes of the longer one no longer count. Below the empty context the bytes never seen are equally likely. The probabilities
of all 256 bytes add up to one in every context. Statistics are frozen: scoring does not change them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quillsift.session import materialise

# Bytes of context; which share of all training bytes a window must make up; bytes of text handled at a time; costs kept ready.
ORDER = 3
SHARE = 2.0 ** -20
PIECE = 1 << 20
READY = 1 << 22
UNKNOWN = "und"


def windows(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` + 1 bytes at every place of ``data`` as one number; before the ``starts`` of texts lie zeros."""
    found = data.astype(np.uint64)
    for back in range(1, order + 1):
        if len(data) > back:
            found[back:] |= data[:-back].astype(np.uint64) << np.uint64(8 * back)
    ends = np.append(starts[1:], len(data))
    for place in range(order):
        at = (starts + place)[starts + place < ends]
        found[at] &= np.uint64((1 << 8 * (place + 1)) - 1)
    return found


def text_pieces(column: pa.Array, order: int, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, windows) of all bytes of a column of texts, some ``size`` bytes at a time; nulls have none."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    begins, ends = offsets[:-1], offsets[1:]
    at = int(offsets[0])
    while at < offsets[-1]:
        to = min(at + size, int(offsets[-1]))
        # A piece may start inside a text: its context is read again, but not counted.
        row = int(np.searchsorted(ends, at, side="right"))
        lead = min(order, at - int(begins[row]))
        last = int(np.searchsorted(begins, to, side="left"))
        part = data[at - lead:to]
        inner = np.arange(row, last)
        inner = inner[ends[inner] > begins[inner]]
        starts = np.maximum(begins[inner], at - lead) - (at - lead)
        rows = np.repeat(inner, np.diff(np.append(starts, len(part))))
        yield rows[lead:], windows(part, starts, order)[lead:]
        at = to


def window_counts(df: DataFrame, order: int) -> DataFrame:
    """(lang, window, n) over all texts of ``df(lang, text)``; each piece of a task sends its different windows once."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary
            by_lang = np.argsort(codes, kind="stable")
            for code, name in enumerate(names):
                mine = pa.array(by_lang[codes[by_lang] == code])
                for _, found in text_pieces(batch.column(1).take(mine), order, 8 * PIECE):
                    different, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(name, len(different)), pa.array(different.view(np.int64)), pa.array(n)],
                        names=["lang", "window", "n"])

    counted = df.select("lang", "text").mapInArrow(task, "lang string, window long, n long")
    return counted.groupBy("lang", "window").agg(F.sum("n").alias("n"))


class Tree:
    """The context trees of all languages, as sorted arrays.

    ``tables[k]`` has the windows of ``k`` context bytes and one byte: (language << 8 * (order + 1)) + window, and their counts.
    """

    def __init__(self, langs: Sequence[str], order: int, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.order = list(langs), order
        self.shift = np.uint64(8 * (order + 1))
        self.keys, self.counts = [t[0] for t in tables], [t[1].astype(np.float64) for t in tables]
        self.contexts, self.total, self.different, self.shorter = [], [], [], []
        for k, (keys, counts) in enumerate(zip(self.keys, self.counts)):
            lang, window = keys >> self.shift, keys & np.uint64((1 << int(self.shift)) - 1)
            # The context is the window without its last byte.
            context, first = np.unique(lang << self.shift | window >> np.uint64(8), return_index=True)
            self.contexts.append(context)
            self.total.append(np.add.reduceat(counts, first) if len(first) else counts)
            self.different.append(np.diff(np.append(first, len(keys))).astype(np.float64))
            # What the bytes of this context count in the next shorter one: they are excluded there.
            if k:
                short = lang << self.shift | window & np.uint64((1 << 8 * k) - 1)
                inner = self.counts[k - 1][np.searchsorted(self.keys[k - 1], short)]
                self.shorter.append(np.add.reduceat(inner, first) if len(first) else inner)
            else:
                self.shorter.append(np.zeros(len(context)))

    def cost(self, code: int, found: np.ndarray) -> np.ndarray:
        """Bits that language ``code`` needs for the last byte of each window after those before it."""
        base = np.uint64(code) << self.shift
        bits, open_ = np.zeros(len(found)), np.arange(len(found))
        excluded, excluded_kinds = np.zeros(len(found)), np.zeros(len(found))
        for k in range(self.order, -1, -1):
            window = found[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            contexts = self.contexts[k]
            if len(contexts):
                context = base | window >> np.uint64(8)
                at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                known = contexts[at] == context
                kinds = self.different[k][at] - excluded_kinds[open_]
                # A context that has seen all 256 bytes has none to escape to.
                escape = np.where(self.different[k][at] < 256, kinds, 0.0)
                weight = np.log2(np.maximum(self.total[k][at] - excluded[open_] + escape, 1.0))
                key = base | window
                place = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
                seen = known & (self.keys[k][place] == key)
                # Where the longer context has all bytes of this one, nothing is left here and escaping is free.
                bits[open_] += np.where(seen, weight - np.log2(self.counts[k][place]),
                                        np.where(known & (kinds > 0), weight - np.log2(np.maximum(kinds, 1.0)), 0.0))
                excluded[open_] = np.where(known, self.shorter[k][at], excluded[open_])
                excluded_kinds[open_] = np.where(known, self.different[k][at], excluded_kinds[open_])
                open_ = open_[~seen]
        bits[open_] += np.log2(np.maximum(256 - excluded_kinds[open_], 1))
        return bits

    def costs(self, found: np.ndarray) -> np.ndarray:
        """Bits per window (rows) and language (columns)."""
        return np.stack([self.cost(code, found) for code in range(len(self.langs))], axis=1) if self.langs else np.zeros((len(found), 0))


class Costs:
    """Costs of the most frequent windows, found by hash; those of others are worked out from the tree when met.

    ``READY`` numbers at most are kept, so that many languages take no more memory than a few.
    """

    def __init__(self, tree: Tree, ready: int = READY):
        self.tree = tree
        known, back = np.unique(tree.keys[-1] & np.uint64((1 << int(tree.shift)) - 1), return_inverse=True)
        often = np.argsort(-np.bincount(back, tree.counts[-1], len(known)), kind="stable")
        self.known = np.sort(known[often[:ready // max(1, len(tree.langs))]])
        self.bits = tree.costs(self.known)
        size = max(16, int(len(self.known) * 4 - 1).bit_length())
        self.down = np.uint64(64 - size)
        self.table = np.full(1 << size, -1, np.int32)
        waiting, probe = np.arange(len(self.known), dtype=np.int32), self._slot(self.known)
        while len(waiting):
            free = self.table[probe] < 0
            self.table[probe[free]] = waiting[free]
            lost = self.table[probe] != waiting
            waiting, probe = waiting[lost], (probe[lost] + 1) & (len(self.table) - 1)

    def _slot(self, found: np.ndarray) -> np.ndarray:
        return (found * np.uint64(0x9E3779B97F4A7C15) >> self.down).astype(np.int64)

    def of(self, found: np.ndarray) -> np.ndarray:
        place = np.full(len(found), -1, np.int32)
        open_, probe = np.arange(len(found)), self._slot(found)
        while len(open_):
            held = self.table[probe]
            hit = (held >= 0) & (self.known[held] == found[open_]) if len(self.known) else np.zeros(len(open_), bool)
            place[open_[hit]] = held[hit]
            on = ~hit & (held >= 0)
            open_, probe = open_[on], (probe[on] + 1) & (len(self.table) - 1)
        bits = self.bits[place] if len(self.known) else np.zeros((len(found), len(self.tree.langs)))
        new = np.flatnonzero(place < 0)
        if len(new):
            rare, back = np.unique(found[new], return_inverse=True)
            bits[new] = self.tree.costs(rare)[back]
        return bits


def learn_tree(df: DataFrame, order: int = ORDER, share: float = SHARE) -> Tree:
    """The context trees of ``df(lang, text)``; rows without a language or a text teach nothing.

    The driver reads at most 1 / ``share`` windows of each length, whatever the size and number of languages.
    """
    if not 1 <= order <= 5:
        raise ValueError(f"contexts have 1 to 5 bytes, not {order}")
    counts = materialise(window_counts(df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()), order))
    least = max(1, int(np.ceil((counts.agg(F.sum("n")).first()[0] or 0) * share)))
    tables = []
    for k in range(order + 1):
        shorter = F.col("window").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("window")
        summed = counts.select("lang", shorter, "n").groupBy("lang", "window").agg(F.sum("n").alias("n"))
        tables.append(summed.filter(F.col("n") >= least).toArrow().combine_chunks())
    langs = sorted(set(tables[0].column("lang").to_pylist()), key=str.encode)
    if len(langs) >= 1 << 16:
        raise ValueError("more than 65,535 languages")
    code = {lang: k for k, lang in enumerate(langs)}
    packed = []
    for t in tables:
        lang = np.array([code[v] for v in t.column("lang").to_pylist()], np.uint64)
        keys = lang << np.uint64(8 * (order + 1)) | t.column("window").to_numpy().astype(np.uint64)
        by_key = np.argsort(keys)
        packed.append((keys[by_key], t.column("n").to_numpy()[by_key]))
    return Tree(langs, order, packed)


def predict_language(df: DataFrame, tree: Tree, text_column: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``lang_pred`` and ``score``; input columns of these names are replaced.

    ``score`` is the probability of the predicted language when all are as likely before the text is read: code lengths of
    whole texts, however long, turned into shares. A tie goes to the first language in byte order. A null text and one
    without a letter (empty, for instance) are ``und`` with score 0, as is every text when nothing was learned. Repeated
    rows each have a result; an empty table gives no rows. Rows are judged where they lie.
    """
    shared = df.sparkSession.sparkContext.broadcast(Costs(tree))
    kept = [name for name in (df.columns if keep is None else keep) if name not in ("lang_pred", "score")]
    order = tree.order
    text = F.col(f"`{text_column}`")
    rows = df.select(*[F.col(f"`{name}`") for name in kept], F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letter"), text.alias("_text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = shared.value
        langs = costs.tree.langs
        for batch in batches:
            length, texts = np.zeros((len(langs), batch.num_rows)), batch.column(len(kept) + 1)
            for row, found in text_pieces(texts, order):
                bits = costs.of(found)
                first, last = int(row[0]), int(row[-1]) + 1
                for code in range(len(langs)):
                    length[code, first:last] += np.bincount(row - first, bits[:, code], last - first)
            spoken = batch.column(len(kept)).to_numpy(zero_copy_only=False).astype(bool) & bool(langs)
            best = length.argmin(axis=0) if langs else np.zeros(batch.num_rows, int)
            share = 1.0 / np.exp2(length.min(axis=0, initial=np.inf) - length).sum(axis=0) if langs else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array([langs[k] if s else UNKNOWN for k, s in zip(best, spoken)], pa.string()),
                 pa.array(np.where(spoken, share, 0.0))], names=[*kept, "lang_pred", "score"])

    fields = [T.StructField(field.name, field.dataType) for field in rows.schema.fields[:len(kept)]]
    return rows.mapInArrow(task, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify_languages(df: DataFrame, train: str, text_column: str = "text", lang_column: str = "lang",
                       keep: Sequence[str] | None = None, order: int = ORDER, share: float = SHARE) -> DataFrame:
    """``predict_language`` for all rows of ``df``, learned from those whose boolean column ``train`` is true."""
    lessons = df.filter(F.col(f"`{train}`")).select(F.col(f"`{lang_column}`").alias("lang"), F.col(f"`{text_column}`").alias("text"))
    return predict_language(df, learn_tree(lessons, order, share), text_column, keep)
