"""Exact de-duplication behind a Bloom filter, with DataFrame functions only.

Pass one reads every text once and keeps a digest per row. From the digests a blocked Bloom filter
is built that records which bits at least two different inserts have set: a digest with one bit
that nobody else has set cannot have a copy. Pass two tests every digest. Only those that may be
repeated are shuffled to be compared in full; the others pass straight through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillsift.session import materialise

# Bits of the filter per row, and bits set per row inside one 64-bit word.
BITS_PER_ROW = 32
BITS_SET = 3
# The filter is broadcast up to this size and joined by shuffle beyond it; results are the same.
BROADCAST_BYTES = 64 << 20
BYTES_PER_WORD = 64


def _word(digest: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(words))


def _mask(digest: Column) -> Column:
    """A 64-bit word with up to BITS_SET bits set, from six hash bits each."""
    h = F.xxhash64(digest, F.lit("mask"))
    mask = F.lit(0).cast("long")
    for i in range(BITS_SET):
        six = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), six))
    return mask


def repeat_filter(rows: DataFrame) -> DataFrame:
    """(_word, _twice): the bits that at least two inserts have set, for words that have any.

    ``rows`` has ``_word`` and ``_mask``. Copies of one text meet in the first aggregate, on the map
    side already; the list of the second holds different masks of one word only, at most C(64, 3)
    and on average ``64 / BITS_PER_ROW``.
    """
    masks = rows.groupBy("_word", "_mask").agg((F.count(F.lit(1)) > 1).alias("_many"))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("once"), zero.alias("twice"))
    step = lambda acc, x: F.struct(
        acc["once"].bitwiseOR(x["_mask"]).alias("once"),
        acc["twice"].bitwiseOR(acc["once"].bitwiseAND(x["_mask"]))
        .bitwiseOR(F.when(x["_many"], x["_mask"]).otherwise(zero)).alias("twice"),
    )
    seen = masks.groupBy("_word").agg(F.collect_list(F.struct("_mask", "_many")).alias("_masks"))
    twice = F.aggregate("_masks", start, step)["twice"]
    return seen.select("_word", twice.alias("_twice")).filter(F.col("_twice") != 0)


def exact_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     normalise=lambda text: text, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when ``normalise(text)`` is; a null text counts as empty. Of equal texts the row
    with the largest id stays; of rows that share that id too, exactly one (any: they are alike).
    A null id is smaller than any other. An empty table gives an empty result. Extra columns are
    not read, so their names cannot clash.
    """
    text = F.coalesce(normalise(F.col(f"`{text_column}`")), F.lit(""))
    rows = materialise(df.select(
        F.col(f"`{id_column}`").alias("_id"), F.unhex(F.sha2(text, 256)).alias("_digest"),
        F.monotonically_increasing_id().alias("_row"),
    ))
    words = 1 << max(0, (rows.count() * BITS_PER_ROW // 64)).bit_length()
    rows = rows.withColumns({"_word": _word(F.col("_digest"), words), "_mask": _mask(F.col("_digest"))})
    twice = materialise(repeat_filter(rows))
    small = twice.count() * BYTES_PER_WORD <= broadcast_bytes
    tested = rows.join(F.broadcast(twice) if small else twice, "_word", "left").withColumn(
        "_maybe", F.coalesce(F.col("_twice").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)))
    # Kept as a table: it is grouped, and joined to its groups.
    maybe = materialise(tested.filter("_maybe").select("_id", "_digest", "_row"))
    groups = (
        maybe.groupBy("_digest")
        .agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    compared = maybe.join(groups, "_digest", "left").select(
        F.col("_id"), F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_keep._row"), F.lit(True)).alias("kept"), "_digest",
    )
    passed = tested.filter("not _maybe").select(
        "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "_digest",
    )
    return passed.unionByName(compared).select(
        F.col("_id").alias(id_column), "keep_id", "group_size", "kept",
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
