"""Phrases whose words occur together far more often than apart, per language.

Words and phrases of up to ``MOST_WORDS`` words are counted in two passes over whole texts.

The first pass finds what can be frequent. Phrases are hashed to 64 bits; hash ranges are partitions, and each has a
Misra-Gries summary: counters for the hashes met, from all of which the same number is taken, and those at zero dropped, when
there are more than its capacity. Partial counts of any number of tasks merge into it in any order. A phrase loses no
more than the sum of these numbers, which stays below the threshold as long as the capacity exceeds mass / threshold; the
partition keeps all hashes whose counter plus that sum reaches the threshold, so no frequent phrase is missed. (A summary
that would lose more grows instead.) A hash that reaches the threshold inside one task needs no counter.

The second pass counts the phrases exactly, as words and not as hashes. What the first pass dropped is filtered out where it
lies, by a Bloom filter of fixed size over the survivors; what the filter lets through by chance is counted like the rest and
falls to the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quillsift.operators.ordering import with_position
from quillsift.session import materialise

MOST_WORDS = 4
LEAST = 30
# What ends a piece of text, and the score of a phrase that never comes apart.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
SCALE = 2_000_000
# Words handled at a time; bytes of text per hash partition; bits of the filter.
CHUNK_WORDS = 1 << 19
PARTITION_BYTES = 8 << 20
FILTER_BITS = 1 << 27
LONGEST_SLICE = 4 << 20
# Bytes sent per hash: 40 bits tell the some millions of a partition apart.
HASH_BYTES = 5
HASH_BITS = np.uint64(8 * HASH_BYTES)

_MARK = b"."
_TABLE = bytes.maketrans(BREAKS, _MARK * len(BREAKS))


class _Numbers(dict):
    """Numbers words as they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_MARK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Chunk:
    """Some million consecutive words of one language: numbered words, zeros between pieces.

    The first ``lead`` words end the chunk before; they are context only.
    """

    def __init__(self, words: list[bytes], ids: np.ndarray, lead: int):
        self.words, self.ids, self.lead = words, ids, lead

    def hashes(self, lang: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, last places, hashes) of all phrases of k words that end behind the lead."""
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        of_word = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        own = of_word[self.ids]
        place = np.arange(len(self.ids))
        place = place[(self.ids != 0) & (place >= self.lead)]
        found = own[place]
        for k in range(1, MOST_WORDS + 1):
            yield k, place, _mixed(found)
            place, found = place[place >= k], found[place >= k]
            whole = self.ids[place - k] != 0
            place = place[whole]
            found = (found[whole] * np.uint64(0x9E3779B97F4A7C15) ^ found[whole] >> np.uint64(29)) + own[place - k]

    def counted(self, k: int, place: np.ndarray, found: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The different phrases of k words that end at ``place``, and how often each does.

        Rows are grouped by hash and the words compared: should two phrases share a hash, they are grouped by words.
        """
        order = np.argsort(found, kind="stable")
        rows = self.ids[place[order][:, None] + np.arange(1 - k, 1)]
        found = found[order]
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, int)
        sizes = np.diff(np.append(first, len(found)))
        if (rows != np.repeat(rows[first], sizes, axis=0)).any():
            distinct, sizes = np.unique(rows, axis=0, return_counts=True)
        else:
            distinct = rows[first]
        return [b" ".join([self.words[w] for w in row]) for row in distinct.tolist()], sizes


def _mixed(found: np.ndarray) -> np.ndarray:
    found = (found ^ found >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    found = (found ^ found >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return found ^ found >> np.uint64(31)


def _slices(data: bytes, size: int = LONGEST_SLICE) -> Iterator[bytes]:
    """A text in slices that end behind a blank or break; a single word is never cut."""
    at = 0
    while len(data) - at > size:
        cut = max(data.rfind(b" ", at, at + size), data.rfind(_MARK, at, at + size), data.rfind(b"\t", at, at + size)) + 1
        if cut <= at:
            ends = [e for e in (data.find(c, at + size) for c in (b" ", _MARK, b"\t")) if e >= 0]
            cut = min(ends) + 1 if ends else len(data)
        yield data[at:cut]
        at = cut
    yield data[at:]


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_WORDS) -> Iterator[tuple[str, Chunk]]:
    """(lang, chunk) of all words of batches of (lang, text), in order, ``size`` words or a slice more at a time.

    A text longer than a chunk goes on in the next one, which is led by its last words.
    """
    held: dict[str, tuple[_Numbers, list[np.ndarray], int]] = {}
    total = 0

    def closed(lang: str, going_on: bool) -> tuple[Chunk, list[bytes]]:
        numbers, parts, lead = held.pop(lang)
        words, ids = list(numbers), np.concatenate(parts)
        tail = [words[i] for i in ids[max(0, len(ids) - MOST_WORDS + 1):]] if going_on else []
        return Chunk(words, ids, lead), tail

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = (text.as_py() or "").encode().lower().translate(_TABLE)
            for part in _slices(data):
                if lang not in held:
                    held[lang] = (_Numbers(), [], 0)
                numbers, parts, _ = held[lang]
                found = part.replace(_MARK, b" . ").split()
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                total += len(found)
                if total >= size:
                    # All languages are closed, so that what is held stays bounded; only this text goes on.
                    for name in list(held):
                        chunk, tail = closed(name, name == lang)
                        yield name, chunk
                        if tail:
                            fresh = _Numbers()
                            held[name] = (fresh, [np.fromiter(map(fresh.__getitem__, tail), np.int32, len(tail))], len(tail))
                    total = 0
            if lang in held:
                held[lang][1].append(np.zeros(1, np.int32))
    for name in list(held):
        yield name, closed(name, False)[0]


def _keys(found: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each hash, from its upper bits, over its lower ``HASH_BITS`` bits."""
    span = np.uint64((1 << 64) // parts if parts > 1 else (1 << 64) - 1)
    part = np.minimum(found // span, np.uint64(parts - 1))
    return part << HASH_BITS | found & np.uint64((1 << int(HASH_BITS)) - 1)


def _packed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def _unpacked(data: bytes, part: int) -> np.ndarray:
    wide = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return wide.view("<u8").ravel().astype(np.uint64) | np.uint64(part) << HASH_BITS


class Summary:
    """A Misra-Gries summary of hashes that merges batches of partial counts."""

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least, self.lost = capacity, least, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held > self.capacity:
            self._settle()

    def _settle(self) -> None:
        if not self.waiting:
            return
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.held = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.keys) > self.capacity:
            # The largest count beyond the capacity goes off every counter; a loss that could hide a frequent phrase does not.
            off = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            off = min(off, self.least - 1 - self.lost)
            stay = self.counts > off
            self.keys, self.counts, self.lost = self.keys[stay], self.counts[stay] - off, self.lost + off

    def survivors(self) -> np.ndarray:
        self._settle()
        return self.keys[self.counts + self.lost >= self.least]


def hash_partitions(texts: DataFrame, partition_bytes: int = PARTITION_BYTES, least: int = LEAST) -> tuple[int, int]:
    """The number of hash partitions for ``texts(lang, text)``, and a capacity beyond the mass of each over ``least``.

    n bytes have at most n / 2 words, hence ``MOST_WORDS`` * n / 2 words and phrases.
    """
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(1, -(-size // partition_bytes))
    return parts, -(-size // parts) * MOST_WORDS // 2 // least + 1


def surviving_hashes(texts: DataFrame, parts: int, capacity: int, least: int = LEAST, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(survivor): keys of all words and phrases that occur ``least`` times in ``texts(lang, text)``, and a few others.

    Tasks send, per chunk and hash partition, one packed list of hashes. Each partition is a task
    of its own, a stream of these lists of which only the summary stays.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, chunk in chunks(batches, chunk_words):
            keys, n = np.unique(_keys(np.concatenate([found for _, _, found in chunk.hashes(lang)]), parts), return_counts=True)
            part = (keys >> HASH_BITS).astype(np.int64)
            edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
            columns = [[], [], [], [], []]
            for a, b in zip(edges, np.append(edges[1:], len(part))):
                some, times = keys[a:b], n[a:b]
                sure, once = times >= least, times == 1
                more = ~sure & ~once
                row = int(part[a]), _packed(some[once]), _packed(some[more]), times[more].astype(np.uint32).tobytes(), _packed(some[sure])
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["part", "once", "more", "counts", "sure"])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, summary, sure = None, None, None

        def result() -> pa.RecordBatch:
            kept = np.unique(np.concatenate([summary.survivors(), sure]))
            return pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64))], names=["survivor"])

        for batch in batches:
            for part, once, more, counts, certain in zip(*batch.columns):
                if part.as_py() != at:
                    if at is not None:
                        yield result()
                    at, summary, sure = part.as_py(), Summary(capacity, least), np.zeros(0, np.uint64)
                if len(certain.as_py()):
                    sure = np.unique(np.concatenate([sure, _unpacked(certain.as_py(), at)]))
                keys = _unpacked(once.as_py(), at)
                summary.merge(keys, np.ones(len(keys), np.int64))
                summary.merge(_unpacked(more.as_py(), at), np.frombuffer(counts.as_py(), np.uint32).astype(np.int64))
        if at is not None:
            yield result()

    sent = texts.mapInArrow(send, "part long, once binary, more binary, counts binary, sure binary")
    return sent.repartitionById(parts, F.col("part").cast("int")).mapInArrow(summarise, "survivor long")


def _bits(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    first, second = _mixed(keys), _mixed(keys ^ np.uint64(0x5851F42D4C957F2D))
    return first & np.uint64(bits - 1), second & np.uint64(bits - 1)


def survivor_filter(survivors: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of ``bits`` bits (a power of two), as words of 32; two bits per survivor.

    Bits of a word are joined before they are read, so the driver gets at most ``bits`` / 32 rows, whatever the survivors' number.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.left_shift(1, at & 31))], names=["word", "mask"])

    words = survivors.mapInArrow(task, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bitmap = np.zeros(max(1, bits // 32), np.uint32)
    bitmap[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return bitmap


def count_phrases(texts: DataFrame, least: int = LEAST, partition_bytes: int = PARTITION_BYTES, filter_bits: int = FILTER_BITS,
                  chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(lang, k, phrase, f): exact counts of words and phrases that occur ``least`` times, and per language one row with
    k = 0 and its number of words."""
    parts, capacity = hash_partitions(texts, partition_bytes, least)
    bitmap = texts.sparkSession.sparkContext.broadcast(
        survivor_filter(surviving_hashes(texts, parts, capacity, least, chunk_words), filter_bits))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        for lang, chunk in chunks(batches, chunk_words):
            for k, place, found in chunk.hashes(lang):
                kept = np.ones(len(found), bool)
                for at in _bits(_keys(found, parts), filter_bits):
                    kept &= (held[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & 1).astype(bool)
                phrases, sizes = chunk.counted(k, place[kept], found[kept])
                if k == 1:
                    yield _counts(lang, 0, [b""], np.array([len(place)]))
                yield _counts(lang, k, phrases, sizes)

    counted = texts.mapInArrow(task, "lang string, k int, phrase string, f long")
    return counted.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("k") == 0))


def _counts(lang: str, k: int, phrases: list[bytes], sizes: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(k, pa.int32()), n),
         pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64())], names=["lang", "k", "phrase", "f"])


def _part(words: Column, start: int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, F.lit(start) if isinstance(start, int) else start, length), " ")


def phrase_scores(counts: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, score): the lowest-scoring cut of each phrase of two words and more; ties to the first.

    ``floor(SCALE * a / (l + r))`` is an integer division of decimals, since the product can pass 64 bits. Both parts of a
    frequent phrase are frequent, hence in ``counts``.
    """
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = counts.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), words.alias("_words"), cut)
    cuts = cuts.select("lang", "k", "phrase", "a", "cut", _part(F.col("_words"), 1, F.col("cut")).alias("_left"),
                       _part(F.col("_words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_right"))
    parts = counts.filter("k > 0").select("lang", "phrase", "f")
    left, right = (parts.toDF("lang", f"_{side}", name) for side, name in (("left", "l"), ("right", "r")))
    scored = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"])
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    lowest = scored.withColumn("score", score).groupBy("lang", "k", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_m"))
    return lowest.select("lang", "k", "phrase", "a", F.col("_m.l").alias("l"), F.col("_m.r").alias("r"), F.col("_m.score").alias("score"))


def drop_parts(scored: DataFrame, percent: int = 80) -> DataFrame:
    """Without the phrases of which ``percent`` per cent or more of the occurrences lie in one longer phrase of ``scored``."""
    words, size = F.split("phrase", " "), F.col("k")
    start = F.explode(F.sequence(F.lit(1), size - F.col("_size") + 1)).alias("_start")
    longer = scored.filter("k > 2").select("lang", "k", "a", words.alias("_words"), F.explode(F.sequence(F.lit(2), size - 1)).alias("_size"))
    inside = longer.select("lang", "a", "_words", "_size", start).select(
        "lang", "a", _part(F.col("_words"), F.col("_start"), F.col("_size")).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    part = F.coalesce(F.col("_most") * 100 >= F.col("a") * percent, F.lit(False))
    return scored.join(most, ["lang", "phrase"], "left").filter(~part).drop("_most")


def mine_phrases(df: DataFrame, top: int = 2000, least: int = LEAST, text_column: str = "text", lang_column: str = "lang",
                 partition_bytes: int = PARTITION_BYTES, filter_bits: int = FILTER_BITS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A-Z are lower-cased; breaks end pieces, blanks and tabs end words. Phrases of two to four words that occur ``least`` times,
    overlaps included, score twice their count as a share of their parts' counts, at the cut where that is least. Ranks go by
    score, count (both descending) and phrase (by bytes). A null language is ``und``. Null and empty texts have no words, a
    repeated row counts again, a text of any length is read whole; an empty table, or one without frequent phrases, gives no
    rows. Only the named columns are read, so others cannot clash.
    """
    texts = df.select(F.coalesce(F.col(f"`{lang_column}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_column}`").alias("text"))
    counts = materialise(count_phrases(texts, least, partition_bytes, filter_bits, chunk_words))
    kept = drop_parts(materialise(phrase_scores(counts)))
    # One balanced sort gives the ranks, so no language is sorted in one task.
    ranked = with_position(kept, [F.desc("score"), F.desc("a"), "phrase"], ["lang"], "rank").filter(F.col("rank") <= top)
    totals = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
