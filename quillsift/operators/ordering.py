"""Ranks, samples and running totals that never put a whole class or table in one task.

Two tools:

* Hash order. A seeded md5 of a unique id gives a random but repeatable order. Its first hex
  digits split any class, however large, into thousands of equal buckets. Counts per bucket are
  small, and from them follow exact ranks and exact cut-offs.
* Sorted order. A global sort is staged once with its partition numbers; totals per partition
  then turn per-partition running sums into global ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillsift.session import materialise

# 16^3 = 4096 buckets per class.
BUCKET_DIGITS = 3


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null groups meet too, with the key columns of ``left``."""
    renamed = right.withColumnsRenamed({key: f"_of_{key}" for key in keys})
    same = [F.col(f"`{key}`").eqNullSafe(F.col(f"`_of_{key}`")) for key in keys]
    return left.join(renamed, reduce(Column.__and__, same)).drop(*[f"_of_{key}" for key in keys])


def hash_order(id_column: str, seed: int | Column = 42) -> Column:
    """A repeatable pseudo-random sort key; equal in Spark and other SQL engines."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", F.col(id_column).cast("string"), seed.cast("string")))


def _with_hash(df: DataFrame, id_column: str, seed: int | Column) -> DataFrame:
    ident = F.when(F.col(id_column).isNull(), F.raise_error(F.lit(f"null in the id column {id_column}")).cast(
        df.schema[id_column].dataType)).otherwise(F.col(id_column))
    return df.withColumn(id_column, ident).withColumn("_h", hash_order(id_column, seed)).withColumn(
        "_bucket", F.substring("_h", 1, BUCKET_DIGITS)
    )


def _bucket_offsets(hashed: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Per (stratum, bucket): rows in it, rows before it, rows in the whole stratum."""
    stratum = Window.partitionBy(*strata)
    counts = hashed.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    running = F.sum("_rows").over(stratum.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumns({
        "_before": running - F.col("_rows"),
        "_stratum_rows": F.sum("_rows").over(stratum),
    })


def class_rank(df: DataFrame, strata: Sequence[str], id_column: str, seed: int | Column = 42,
               output: str = "class_rank") -> DataFrame:
    """1-based rank within each stratum in hash order.

    Equals row_number() over (partition by stratum order by hash, id). The join and the window
    share one shuffle on (stratum, bucket), so the offsets need no broadcast. A row with a null in ``strata``
    belongs to none and has no rank. A null id is an error.
    """
    hashed = _with_hash(df, id_column, seed)
    offsets = _bucket_offsets(hashed, strata).select(*strata, "_bucket", "_before", "_stratum_rows")
    bucket = Window.partitionBy(*strata, "_bucket").orderBy("_h", id_column)
    return (
        hashed.join(offsets, [*strata, "_bucket"], "left")
        .withColumn(output, F.col("_before") + F.row_number().over(bucket))
        .drop("_h", "_bucket", "_before", "_stratum_rows")
        .select(*df.columns, output)
    )


def class_targets(share: float) -> Column:
    """The number of rows that ``share`` of a stratum stands for, for ``flag_first``."""
    return F.round(F.lit(share) * F.col("_stratum_rows")).cast("long")


def hash_limits(df: DataFrame, strata: Sequence[str], id_column: str, target: Column,
                seed: int | Column = 42) -> DataFrame:
    """Where the first ``target`` rows of each stratum in hash order end: one row per stratum.

    ``target`` may use ``_stratum_rows`` (rows in the stratum) and ``_smallest`` (rows in the
    smallest stratum). One small aggregate finds the bucket in which the cut falls; only that
    bucket, a 4096th of the stratum, is sorted to find the exact cut. Reads strata and id only.
    Rows with a null in ``strata`` belong to none. A null id is an error, and so are two equal ids of which
    only one would fit.
    """
    hashed = _with_hash(df.select(*strata, id_column).dropna(subset=list(strata)), id_column, seed)
    offsets = _bucket_offsets(hashed, strata)
    offsets = offsets.withColumn("_smallest", F.min("_stratum_rows").over(Window.partitionBy(F.lit(0))))
    offsets = offsets.withColumn("_target", target)
    cut_bucket = offsets.filter(
        (F.col("_target") > F.col("_before")) & (F.col("_target") <= F.col("_before") + F.col("_rows"))
    ).select(*strata, "_bucket", (F.col("_target") - F.col("_before")).alias("_need"))
    # A target beyond the whole stratum needs no cut; zero or less takes nothing.
    whole = offsets.groupBy(*strata).agg(F.max(F.col("_target") > F.col("_stratum_rows")).alias("_whole"))
    in_bucket = Window.partitionBy(*strata, "_bucket").orderBy("_h", id_column)
    torn = F.lead(id_column).over(in_bucket) == F.col(id_column)
    cut = (
        hashed.join(cut_bucket, [*strata, "_bucket"])
        .withColumns({"_n": F.row_number().over(in_bucket), "_torn": torn})
        .filter(F.col("_n") == F.col("_need"))
        .withColumn("_h", F.when(F.col("_torn"), F.raise_error(F.lit(f"the id column {id_column} is not unique")).cast("string"))
                    .otherwise(F.col("_h")))
        .select(*strata, F.col("_h").alias("_cut_h"), F.col(id_column).alias("_cut_id"))
    )
    return whole.join(cut, list(strata), "left")


def within_limits(df: DataFrame, limits: DataFrame, strata: Sequence[str], id_column: str,
                  seed: int | Column = 42, output: str = "chosen") -> DataFrame:
    """Marks the rows up to the limits of ``hash_limits``; rows without a stratum get a null.

    There is one row of limits per stratum. Stage them: where they are few, their size is then known beforehand and each row is
    marked where it lies. Else all rows are dealt out by stratum, so that two classes keep two tasks busy.
    """
    h = hash_order(id_column, seed)
    upto_cut = (h < F.col("_cut_h")) | ((h == F.col("_cut_h")) & (F.col(id_column) <= F.col("_cut_id")))
    return (
        df.join(limits, list(strata), "left")
        .withColumn(output, F.col("_whole") | F.coalesce(upto_cut, F.lit(False)))
        .select(*df.columns, output)
    )


def flag_first(df: DataFrame, strata: Sequence[str], id_column: str, target: Column,
               seed: int | Column = 42, output: str = "chosen") -> DataFrame:
    """Marks the first ``target`` rows of each stratum in hash order, moving no data rows.

    ``df`` is read three times, twice for strata and id only. Stage it first when it is
    expensive. The limits, a row per stratum, are staged at once.
    """
    limits = materialise(hash_limits(df, strata, id_column, target, seed))
    return within_limits(df, limits, strata, id_column, seed, output)


def sample_per_class(df: DataFrame, n: int, strata: Sequence[str], id_column: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows of each stratum (all of a smaller one), repeatable."""
    chosen = flag_first(df, strata, id_column, F.lit(n).cast("long"), seed, "_chosen")
    return chosen.filter("_chosen").drop("_chosen")


def sample_n(df: DataFrame, n: int, id_column: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all of a smaller table), repeatable. Ids must be unique and not null."""
    whole = df.withColumn("_all", F.lit(0))
    return sample_per_class(whole, n, ["_all"], id_column, seed).drop("_all")


def running_totals(df: DataFrame, order: Sequence[str | Column], totals: dict[str, str],
                   groups: Sequence[str] = (), following: Sequence[str] = ()) -> DataFrame:
    """Cumulative sums over a whole table in sorted order, optionally per group.

    ``order`` must be unique within a group. ``totals`` maps output name to the column summed;
    each of the ``following`` columns (without nulls) is added as ``next_<column>`` from the
    next row, null on the last.
    The sort balances partitions by sampling, so no group or value range can overload a task.
    It is staged because partition numbers must not change between the two passes over it.
    """
    staged = materialise(
        df.sort(*groups, *order).withColumns({
            "_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id(),
        })
    )
    keys = ["_part", *groups]
    per_part = staged.groupBy(*keys).agg(
        *[F.sum(column).alias(f"_sum_{name}") for name, column in totals.items()],
        *[F.min_by(column, "_seq").alias(f"_first_{column}") for column in following],
    )
    # Rows per group here: the partitions it spans. A large table of groups stays distributed.
    parts = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("_part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    edges = per_part.select(
        *keys,
        *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in totals],
        *[F.lead(f"_first_{column}").over(parts).alias(f"_after_{column}") for column in following],
    )
    rows = Window.partitionBy(*keys).orderBy("_seq")
    upto = rows.rowsBetween(Window.unboundedPreceding, 0)
    return join_null_safe(staged, edges, keys).select(
        *df.columns,
        *[(F.col(f"_before_{name}") + F.sum(column).over(upto)).alias(name) for name, column in totals.items()],
        *[
            F.coalesce(F.lead(column).over(rows), F.col(f"_after_{column}")).alias(f"next_{column}")
            for column in following
        ],
    )


def _placed(df: DataFrame, order: Sequence[str | Column], groups: Sequence[str], keep: Sequence[str], output: str) -> DataFrame:
    """``with_position`` with the columns ``keep`` only; no others but those of the order are moved or staged."""
    staged = materialise(df.sort(*groups, *order).select(
        *[F.col(f"`{name}`") for name in dict.fromkeys([*groups, *keep])],
        F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")))
    keys = ["_part", *groups]
    parts = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("_part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first")).select(
        *keys, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    return join_null_safe(staged, offsets, keys).select(
        *[F.col(f"`{name}`") for name in keep], (F.col("_seq") + F.col("_offset")).alias(output))


def with_position(df: DataFrame, order: Sequence[str | Column], groups: Sequence[str] = (),
                  output: str = "position") -> DataFrame:
    """1-based position of each row in sorted order, dense, per group when groups are given.

    The sorted rows are staged once. A row's place in its partition is part of its sequence number, so
    it only lacks what lies before: rows of its group in earlier partitions, less those of other groups
    ahead in its own. Those offsets are one row per partition and group; rows are not sorted again. A null group is a group.
    """
    return _placed(df, order, groups, df.columns, output)


def first_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of the table in sort order, as a set: sort the result where order matters."""
    return first_n_per_group(df, [], order, n)


def first_n_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in sort order; a null group is a group.

    Rows are chosen by 16 bytes that stand for them: only these, the groups and the order are sorted and staged, in one
    balanced sort, so no group, however large, and no n puts its rows in one task. The chosen ones are then picked out of
    ``df``, whose other columns are not moved for any other row as long as the chosen ones are few enough to be broadcast (as
    adaptive execution decides). Of rows that are equal in every column, as many are kept as fall among the first ``n``.
    """
    columns = [F.col(f"`{name}`") for name in df.columns]
    mark = {"_row": F.xxhash64(*columns), "_row2": F.xxhash64(F.lit("other seed"), *columns)}
    places = _placed(df.withColumns(mark), order, groups, [*mark], "_place")
    chosen = materialise(places.groupBy(*mark).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum((F.col("_place") <= n).cast("long")).alias("_kept")).filter("_kept > 0"))
    marked = df.withColumns(mark)
    first = marked.join(chosen.filter("_kept = _rows"), [*mark], "left_semi").select(*columns)
    torn = chosen.filter("_kept < _rows")
    if torn.isEmpty():
        return first
    # Equal rows of which only some are among the first: one of them, as often as needed.
    equal = marked.join(torn, [*mark]).groupBy(*columns, "_kept").agg(F.count(F.lit(1)).alias("_n"))
    return first.unionByName(equal.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_kept")))).select(*columns))


def shuffle_rows(df: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """The whole table in a repeatable random order."""
    return df.withColumn("_h", hash_order(id_column, seed)).orderBy("_h", id_column).drop("_h")


def assign_text_id(df: DataFrame, order: Sequence[str | Column], prefix: str = "text",
                   output: str = "text_id") -> DataFrame:
    """``prefix_0000``, ``prefix_0001``, ... in row order, unless the table has ids already."""
    if output in df.columns:
        return df
    numbered = with_position(df, order, output="_position")
    return numbered.withColumn(
        output, F.format_string(f"{prefix}_%04d", F.col("_position") - F.lit(1))
    ).drop("_position")
