"""Token files: ids at fixed width in the fewest bits the vocabulary needs, in ascending document order.

The file format is a Parquet folder (so any store that Spark writes will hold it) with one row per
block of whole documents:

    shard, block      place of the block; blocks ascend within a shard, shards by first document
    start             ids before the block within its shard
    n_ids, width      ids in the block, bits per id
    doc_ids, ends     its documents and, for each, the end of its ids within the block
    payload           the ids: 64 at a time in ``width`` little-endian 64-bit words

The id at position p of a block is bits ``(p % 64) * width`` onwards of word group ``p // 64``, so
blocks unpack with a few vectorised shifts and any id is found by arithmetic. A block closes at the
first document end past ``block_ids``; no document crosses blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillsift.llm.encoding import encoder, ids_of

BLOCK_IDS = 1 << 16
LANES = 64

BLOCK_SCHEMA = (
    "shard int, block int, start long, n_ids long, width int, doc_ids array<long>, ends array<long>, payload binary"
)
DOC_SCHEMA = "shard int, doc_id long, start_in_shard long, n_tokens long, ids binary"


def width_for(vocabulary: int) -> int:
    """Bits for ids 0 to ``vocabulary - 1``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Fixed-width bit packing of unsigned ids below ``2 ** width``."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    lanes = np.zeros((-(-len(ids) // LANES), LANES), dtype=np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    lanes = np.ascontiguousarray(lanes.T)
    words = np.zeros((width, lanes.shape[1]), dtype=np.uint64)
    for lane in range(LANES):
        word, shift = divmod(lane * width, 64)
        words[word] |= lanes[lane] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()


def unpack(payload: bytes, width: int, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    words = np.ascontiguousarray(np.frombuffer(payload, dtype="<u8").reshape(-1, width).T)
    lanes = np.empty((LANES, words.shape[1]), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for lane in range(LANES):
        word, shift = divmod(lane * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[word + 1] << np.uint64(64 - shift))
        lanes[lane] = value & mask
    return np.ascontiguousarray(lanes.T).reshape(-1)[:n]


def id_at(payload: bytes, width: int, position: int) -> int:
    """One id of a block, reading at most two words."""
    group, lane = divmod(position, LANES)
    word, shift = divmod(lane * width, 64)
    at = (group * width + word) * 8
    value = int.from_bytes(payload[at:at + 16], "little") >> shift
    return value & ((1 << width) - 1)


def _block(shard: int, number: int, start: int, width: int, docs: list, parts: list[bytes]) -> pa.RecordBatch:
    lengths = np.array([len(p) // 4 for p in parts], dtype=np.int64)
    ids = ids_of(b"".join(parts))
    return pa.RecordBatch.from_arrays([
        pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()),
        pa.array([len(ids)], pa.int64()), pa.array([width], pa.int32()), pa.array([docs], pa.list_(pa.int64())),
        pa.array([np.cumsum(lengths)], pa.list_(pa.int64())), pa.array([pack(ids, width)], pa.binary()),
    ], names=["shard", "block", "start", "n_ids", "width", "doc_ids", "ends", "payload"])


def write_token_file(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_column: str = "doc_id",
                     text_column: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the blocks in ascending id order.

    A null text is empty: its document is the end id alone. Null ids come first; rows that share an id
    all stay, in the order of a hash of their texts. An empty table gives a file without blocks. Other
    columns are not read. Documents are range-partitioned by (id, hash), each partition is one shard.
    """
    chosen = df.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = chosen.repartitionByRange(*keys).sortWithinPartitions(*keys)
    end = np.array([end_id], dtype="<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width, shard = width_for(max(encode.vocabulary, end_id + 1)), TaskContext.get().partitionId()
        docs, parts, held, start, number = [], [], 0, 0, 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                parts.append(encode.encode(text.as_py()) + end)
                docs.append(doc.as_py())
                held += len(parts[-1]) // 4
                if held >= block_ids:
                    yield _block(shard, number, start, width, docs, parts)
                    docs, parts, held, start, number = [], [], 0, start + held, number + 1
        if docs:
            yield _block(shard, number, start, width, docs, parts)
        encode.rest()

    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids``.

    ``ids`` are little-endian unsigned 32-bit. Blocks are read in parallel; where a shard starts follows
    from the number of ids of each shard before it: one row per shard, so no more than the partitions that
    wrote the file, and these rows go to every task.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_ids")).select(
        "shard", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, start, n, width, docs, ends, payload = (batch.column(i)[row].as_py() for i in range(7))
                ids = unpack(payload, width, n).astype("<u4", copy=False)
                ends = np.array(ends, dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(start + starts),
                    pa.array(ends - starts), pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ], names=["shard", "doc_id", "start_in_shard", "n_tokens", "ids"])

    read = blocks.select("shard", "start", "n_ids", "width", "doc_ids", "ends", "payload")
    return read.mapInArrow(documents, DOC_SCHEMA).join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("_base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids")
