"""Global order without a single task: ranks, running sums and previous rows over range partitions.

A table is dealt out by ranges of its order and stored with the number of its range.
Within ranges a window does the work; what spans ranges is one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.sources.scratch import stored


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``_range``: rows of a lower range come before all rows of a higher one."""
    return stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with inclusive running sums in ``order``, which must tell all rows apart."""
    rows = ranged(df.select("*", *(c.alias(f"_{k}") for k, c in sums.items())), *order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range").agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in sums))
    bases = totals.select("_range", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in sums))  # a row per range
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(bases), "_range")
    return out.select(*df.columns, *((F.col(f"_base_{k}") + F.sum(f"_{k}").over(within)).alias(k) for k in sums))


def with_ordinal(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """``df`` with the 0-based place of each row; ``order`` must tell all rows apart."""
    return running_sums(df, [*order], {name: F.lit(1).cast("long")}).withColumn(name, (F.col(name) - 1).cast("long"))


def with_previous(df: DataFrame, order: list[str], column: str, name: str = "previous") -> DataFrame:
    """``df`` with ``column`` of the row before; null in the first row."""
    rows = ranged(df, *order)
    last = rows.groupBy("_range").agg(F.max_by(column, F.struct(*order)).alias("_last"))
    across = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_last"))  # a row per range
    within = Window.partitionBy("_range").orderBy(*order)
    out = rows.join(F.broadcast(across), "_range")
    return out.select(*df.columns, F.when(F.row_number().over(within) == 1, F.col("_last")).otherwise(F.lag(column).over(within)).alias(name))


def lower_bounds(words: DataFrame, probes: DataFrame, name: str = "idx") -> DataFrame:
    """``probe`` and how many of the distinct ``word`` are smaller: one pass over both, no range join.

    Words and probes are put in one order, a probe before an equal word, and the words
    before each probe are counted as a running sum.
    """
    both = words.select(F.col("word").alias("text"), F.lit(1).alias("is_word")).distinct().unionByName(probes.select(F.col("probe").alias("text"), F.lit(0).alias("is_word")).distinct())
    counted = running_sums(both, ["text", "is_word"], {name: F.col("is_word").cast("long")})
    return counted.where("is_word = 0").select(F.col("text").alias("probe"), F.col(name).cast("long"))


def bit_ranks(df: DataFrame, order: list[str], bit: Column) -> DataFrame:
    """``df`` with ``rank1`` and ``rank0``: set and unset bits up to and with each row."""
    one = F.when(bit, 1).otherwise(0).cast("long")
    return running_sums(df, order, {"rank1": one, "rank0": 1 - one})


def select_bits(df: DataFrame, order: list[str], bit: Column) -> DataFrame:
    """``df``'s rows with a set bit and ``k``, their number from 0: where the k-th set bit stands."""
    return with_ordinal(df.where(bit), *order, name="k")


def runs_of_ones(df: DataFrame, order: str, bit: Column) -> DataFrame:
    """``start``, ``len``: each longest run of set bits. The unset bits before a bit tell its run."""
    ranked = bit_ranks(df, [order], bit).where(bit)
    return ranked.groupBy("rank0").agg(F.min(order).alias("start"), F.count("*").alias("len")).drop("rank0")


def split_ranges(rows: DataFrame, order: list[str], size: Column, parts: int) -> DataFrame:
    """``part``, ``offset``, ``length``: rows in order, cut into ``parts`` ranges of about equal size at their borders."""
    placed = running_sums(rows.withColumn("_size", size), order, {"_end": F.col("_size")})
    total = rows.agg(F.greatest(F.sum(size), F.lit(1)).alias("_total"))
    begin = F.col("_end") - F.col("_size")
    part = F.floor(begin * parts / F.col("_total")).cast("long")
    return placed.join(F.broadcast(total)).groupBy(part.alias("part")).agg(F.min(begin).alias("offset"), F.sum("_size").alias("length"))  # total: a single row
