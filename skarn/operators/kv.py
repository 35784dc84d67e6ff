"""Key to value tables: single and multiple values, keys inside texts, several columns, operation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.dictionary import prefixes_of


def multi_values(kv: DataFrame) -> DataFrame:
    """``key``, ``vals``: all distinct values of each key, in order, joined by commas."""
    return kv.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("value")), ",").alias("vals"))


def unique_violations(kv: DataFrame) -> DataFrame:
    """``key``, ``n``: keys with more than one distinct value."""
    return kv.groupBy("key").agg(F.count_distinct("value").alias("n")).where("n > 1")


def unique_values(kv: DataFrame, keys: DataFrame, strict: bool = False) -> DataFrame:
    """``key``, ``value`` of the keys asked for; a key with several values is null, or with ``strict`` an error."""
    found = kv.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"))
    several = F.raise_error(F.concat(F.lit("several values: "), F.col("key").cast("string"))) if strict else F.lit(None)
    return keys.join(found.select("key", F.when(F.col("n") == 1, F.col("value")).otherwise(several.cast(kv.schema["value"].dataType)).alias("value")), "key", "left")


def match_keys(kv: DataFrame, texts: DataFrame, column: str, longest: bool = False) -> DataFrame:
    """``column``, ``matched``, ``value``: values of every key that is a prefix of the text, or of the longest such key."""
    hits = prefixes_of(texts, column, "key", 1).join(kv, "key")
    if longest:
        best = hits.groupBy(column).agg(F.max("len").alias("len"))
        hits = hits.join(best, [column, "len"], "left_semi")
    return hits.select(column, F.col("len").cast("long").alias("matched"), "value").distinct()


def columns_to_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key``, ``value``, ``col``: one row per value column, numbered from 1."""
    values = F.array(*(F.col(c).cast("string") for c in columns))
    return df.select(F.col(key).cast("string").alias("key"), F.posexplode(values).alias("col", "value")).select("key", "value", (F.col("col") + 1).cast("int").alias("col"))


def compact_log(log: DataFrame) -> DataFrame:
    """``key``, ``seq``, ``val`` left after an operation log ``seq, op, key, val``.

    ``set`` puts a value, ``del`` takes the key away, ``add`` puts a value only if the key
    is absent. What counts is what follows the last ``del``: the last ``set``, or without
    one the first ``add``. One aggregate by key settles most keys, and a hot key is combined
    before it moves; only ``add`` rows of keys with a ``del`` and no later ``set`` are read again.
    """
    entry = F.struct("seq", "val")
    at = lambda op: F.when(F.col("op") == op, F.col("seq"))
    by_key = log.groupBy("key").agg(F.max(at("del")).alias("gone"), F.max_by(entry, at("set")).alias("last_set"), F.min_by(entry, at("add")).alias("first_add"))
    live_set = F.col("last_set").isNotNull() & (F.col("gone").isNull() | (F.col("last_set.seq") > F.col("gone")))
    settled = by_key.where(live_set | F.col("gone").isNull()).select("key", F.when(live_set, F.col("last_set")).otherwise(F.col("first_add")).alias("e"))
    open_keys = by_key.where(~live_set & F.col("gone").isNotNull()).select("key", "gone")
    later = log.where("op = 'add'").join(open_keys, "key").where("seq > gone").groupBy("key").agg(F.min_by(entry, "seq").alias("e"))
    return settled.unionByName(later).select("key", "e.seq", "e.val")
