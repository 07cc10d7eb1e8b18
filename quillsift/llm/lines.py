"""Line de-duplication by winnowing, with DataFrame functions only.

A passage is a run of lines of one document with at least ``min_words`` words together. A line is deleted
when it lies in a passage that the same or an earlier document has word for word before it.

1. Every line with words gets a hash, its position, and the words before it in its document.
2. Winnowing: a window is the fewest lines from one on that hold ``min_words`` words; its smallest line hash
   is its fingerprint, which lies where that line does. Equal passages have equal windows, so every passage
   that occurs twice shares the fingerprints of all windows inside it.
3. Fingerprints are joined to their places. A window whose fingerprint lies at one place only has no copy and
   is dropped.
4. Matches are extended both ways: around each fingerprint that repeats, the windows that begin and those
   that end at each line are compared by the hash of all their lines. The first place of each is found by
   aggregation, so no pairs of copies are formed; later places are marked.
5. A line with words is deleted when a marked window covers it. Windows that begin at each line of a repeated run,
   and those that end at each, together cover the run to both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillsift.llm.rows import document_key
from quillsift.session import materialise

MIN_WORDS = 50
BLANKS = r"[\x09-\x0D\x20]+"
WORDED = r"[^\x09-\x0D\x20]"


def line_table(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per line with words: document (``_key``, ``_id``), ``_pos``, ``_hash``, ``_words`` and the words
    before its start and up to its end."""
    text = F.col(f"`{text_column}`")
    docs = df.select(F.col(f"`{id_column}`").alias("_id"), text.alias("_text")).filter("_text is not null")
    docs = docs.withColumn("_key", document_key(F.col("_id"), F.col("_text")))
    words = F.size(F.filter(F.split("_line", BLANKS), lambda w: w != ""))
    lines = docs.select("_key", "_id", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line")).select(
        "_key", "_id", "_pos", F.xxhash64("_line").alias("_hash"), words.cast("long").alias("_words"),
    ).filter("_words > 0").dropDuplicates(["_key", "_id", "_pos"])
    upto = Window.partitionBy("_key", "_id").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_end", F.sum("_words").over(upto)).withColumn("_start", F.col("_end") - F.col("_words"))


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """One row per window, beginning or ending at a line: ``_from``, ``_to``, ``_finger``, ``_at``, ``_content``.

    The fingerprint lies at ``_at``, its smallest line, the first of equal ones."""
    doc = Window.partitionBy("_key", "_id")
    # Word counts before each line grow strictly, so a range of them is a run of lines.
    ahead = doc.orderBy("_start").rangeBetween(0, min_words - 1)
    back = doc.orderBy("_end").rangeBetween(-(min_words - 1), 0)

    def side(over, first: Column, last: Column) -> Column:
        hashes = F.collect_list("_hash").over(over)
        return F.struct(first.alias("_from"), last.alias("_to"), F.sum("_words").over(over).alias("_total"),
                        F.min(F.struct("_hash", "_pos")).over(over).alias("_least"),
                        F.struct(F.xxhash64(hashes).alias("a"), F.xxhash64(F.lit("b"), hashes).alias("b")).alias("_content"))

    sides = lines.select(
        "_key", "_id",
        F.array(side(ahead, F.col("_pos"), F.max("_pos").over(ahead)),
                side(back, F.min("_pos").over(back), F.col("_pos"))).alias("_sides"))
    return sides.select("_key", "_id", F.explode("_sides").alias("_w")).select("_key", "_id", "_w.*").filter(
        F.col("_total") >= min_words).select(
        "_key", "_id", "_from", "_to", F.col("_least")["_hash"].alias("_finger"), F.col("_least")["_pos"].alias("_at"), "_content")


def _matched(windows: DataFrame) -> DataFrame:
    """The windows whose fingerprint lies at two places or more; neighbours that share a smallest line share its place."""
    at = F.struct("_id", "_key", "_at")
    fingers = windows.groupBy("_finger").agg(F.min(at).alias("_low"), F.max(at).alias("_high")).filter(
        F.col("_low") != F.col("_high")).select("_finger")
    return windows.join(fingers, "_finger", "left_semi")


def repeated_lines(df: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """(``_key``, ``_id``, ``_gone``): per document with repeats, the positions inside repeated passages.
    Lines without words there are not deleted."""
    windows = materialise(_windows(line_table(df, id_column, text_column), min_words))
    place = F.struct(F.col("_id"), F.col("_key"), F.col("_from"))
    matched = _matched(windows)
    first = matched.groupBy("_content").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter(
        F.col("_first") != F.col("_last"))
    marked = matched.join(first, "_content").filter(place != F.col("_first")).select("_key", "_id", "_from", "_to")
    covered = marked.distinct().select("_key", "_id", F.explode(F.sequence("_from", "_to")).alias("_pos"))
    return covered.groupBy("_key", "_id").agg(F.collect_set("_pos").alias("_gone"))


def drop_repeated_lines(df: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id",
                        text_column: str = "text") -> DataFrame:
    """The rows of ``df`` with repeated passages cut from their texts, ``n_lines_dropped`` added.

    Earlier means a smaller id (null first), for texts that share an id a smaller hash, then a smaller position.
    Rows equal in id and text are one document and keep the same lines. Lines are compared as they are,
    white space included; lines without words take part in no passage and stay. Null and empty texts are unchanged, an
    empty table stays empty; a column named like the output's is replaced, all others are kept.
    """
    df = df.drop("n_lines_dropped")
    gone = repeated_lines(df, min_words, id_column, text_column)
    text, ident = F.col(f"`{text_column}`"), F.col(f"`{id_column}`")
    # The rows travel as one column, so no name of theirs meets one of these.
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                      document_key(ident, text).alias("_k"), ident.alias("_i"))
    joined = keyed.join(gone, (F.col("_k") == F.col("_key")) & F.col("_i").eqNullSafe(F.col("_id")), "left")
    whole = F.col("_row")[text_column]
    parts = F.split(whole, "\n")
    kept = F.filter(F.transform(parts, lambda line, i: F.when(~(F.array_contains("_gone", i) & line.rlike(WORDED)), line)),
                    lambda line: line.isNotNull())
    cut = F.when(F.col("_gone").isNull(), whole).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size(parts) - F.size(kept)).cast("long")
    return joined.select(*[cut.alias(c) if c == text_column else F.col("_row")[c].alias(c) for c in df.columns],
                         dropped.alias("n_lines_dropped"))
