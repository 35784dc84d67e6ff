"""Ordered dictionaries: distinct words with their lexicographic ordinal, and lookups in them.

Order is byte order (Spark's binary collation). A dictionary is a table ``word``, ``id``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.scalar import common_prefix_length
from skarn.operators.ordered import lower_bounds, with_ordinal, with_previous


def word_set(df: DataFrame, column: str) -> DataFrame:
    """Distinct values as ``word``; nulls are no words, the empty string is one."""
    return df.select(F.col(column).alias("word")).where("word is not null").distinct()


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """``word``, ``id``: every distinct word and its 0-based place in byte order."""
    return with_ordinal(word_set(df, column), "word")


def nth_words(d: DataFrame, wanted: Column) -> DataFrame:
    """Words whose ordinal satisfies ``wanted``."""
    return d.where(wanted).select("id", "word")


def rank(d: DataFrame, probes: DataFrame) -> DataFrame:
    """``probe``, ``id``: the ordinal of each probe, -1 if it is no word."""
    return probes.join(d.withColumnRenamed("word", "probe"), "probe", "left").select("probe", F.coalesce("id", F.lit(-1)).cast("long").alias("id"))


def lower_bound(d: DataFrame, probes: DataFrame) -> DataFrame:
    """``probe``, ``idx``: the ordinal of the first word not smaller than it."""
    return lower_bounds(d, probes)


def word_range(words: DataFrame, low: str, high: str) -> DataFrame:
    """Words with low <= word < high; both bounds reach the scan."""
    return words.where((F.col("word") >= low) & (F.col("word") < high))


def suffixes(words: DataFrame, prefix: str) -> DataFrame:
    """What follows ``prefix`` in words that start with it."""
    return words.where(F.col("word").startswith(prefix)).select(F.substring("word", len(prefix) + 1, 2**31 - 1).alias("suffix"))


def prefixes_of(df: DataFrame, column: str, name: str = "prefix", least: int = 0) -> DataFrame:
    """``df`` once for every prefix of ``column`` from ``least`` characters on, with ``name`` and ``len``."""
    n = F.char_length(column)
    lengths = F.when(n >= least, F.sequence(F.lit(least), n)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("len", F.explode(lengths)).withColumn(name, F.expr(f"left({column}, len)"))


def path_suffix_counts(words: DataFrame, probes: DataFrame) -> DataFrame:
    """``probe``, ``len``, ``cnt``: for every prefix of each probe, how many words start with it.

    Words count once for each of their prefixes that is a prefix of a probe: an equi-join.
    """
    wanted = prefixes_of(probes.select("probe").distinct(), "probe")
    counts = prefixes_of(words, "word").join(wanted.select("prefix").distinct(), "prefix", "left_semi").groupBy("prefix").agg(F.count("*").alias("cnt"))
    return wanted.join(counts, "prefix", "left").select("probe", F.col("len").cast("long"), F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def match_prefixes(d: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """``column``, ``matched``, ``word``, ``id``: every word that is a prefix of the text, shorter ones first by ``matched``."""
    return prefixes_of(texts, column, "word", 1).join(d, "word").select(column, F.col("len").cast("long").alias("matched"), "word", "id")


def longest_prefix(words: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """``column``, ``matched``: length of the longest word that starts the text."""
    hits = prefixes_of(texts, column, "word", 1).join(words, "word")
    return hits.groupBy(column).agg(F.max("len").cast("long").alias("matched"))


def child_stats(words: DataFrame, depth: int) -> DataFrame:
    """``prefix``, ``children``: distinct next characters after each prefix of up to ``depth`` characters."""
    longer = prefixes_of(words, "word").where((F.col("len") <= depth) & (F.col("len") < F.char_length("word")))
    return longer.groupBy("prefix").agg(F.count_distinct(F.expr("substring(word, len + 1, 1)")).alias("children"))


def insert_if_absent(words: DataFrame, new: DataFrame) -> DataFrame:
    """``words`` with those of ``new`` whose word it lacks; of repeated new rows one goes in."""
    return words.unionByName(new.dropDuplicates(["word"]).join(words, "word", "left_anti"))


def seek(d: DataFrame, probes: DataFrame) -> DataFrame:
    """``probe``, ``idx``, ``word``, ``matched``, ``found``: the first word not smaller than each probe, the characters they share at their start, and whether they are equal; past the end no word."""
    at = lower_bounds(d, probes).join(d.withColumnRenamed("id", "idx"), "idx", "left")
    shared = F.coalesce(common_prefix_length(F.col("probe"), F.col("word")), F.lit(0))
    return at.select("probe", "idx", "word", shared.cast("long").alias("matched"), F.coalesce(F.col("word") == F.col("probe"), F.lit(False)).alias("found"))


def longest_shared_prefix(words: DataFrame, probes: DataFrame) -> DataFrame:
    """``probe``, ``matched``: the longest start of each probe that some word starts with."""
    return path_suffix_counts(words, probes).where("cnt > 0").groupBy("probe").agg(F.max("len").alias("matched"))


def neighbours(d: DataFrame) -> DataFrame:
    """``word``, ``before``, ``after``: the words next to each in order; null at the ends."""
    side = lambda name, step: d.select((F.col("id") + step).alias("id"), F.col("word").alias(name))
    return d.join(side("before", 1), "id", "left").join(side("after", -1), "id", "left").select("word", "before", "after")


def longest_word_prefix(d: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """``column``, ``matched``, ``word``, ``id``: the longest word that starts the text."""
    best = F.max(F.struct("matched", "word", "id")).alias("best")
    return match_prefixes(d, texts, column).groupBy(column).agg(best).select(column, "best.*")


def step_counts(words: DataFrame, probes: DataFrame, delimiter: str) -> DataFrame:
    """``probe``, ``step``, ``cnt``: after each part of a delimited probe, the words that start with the parts so far."""

    def steps(df: DataFrame, column: str) -> DataFrame:
        parts = F.split(F.col(column), re.escape(delimiter))
        each = df.select(column, F.posexplode(parts).alias("at", "part"), parts.alias("parts"))
        return each.select(column, (F.col("at") + 1).cast("long").alias("step"), F.slice("parts", F.lit(1), F.col("at") + 1).alias("path"))

    wanted = steps(probes.select("probe").distinct(), "probe")
    counts = steps(words, "word").join(wanted.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.count("*").alias("cnt"))
    return wanted.join(counts, "path", "left").select("probe", "step", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def approximate_ranks(d: DataFrame) -> DataFrame:
    """``word``, ``rank``: the place of each word among all, from 0 up to 1."""
    total = d.agg(F.greatest(F.max("id"), F.lit(1)).alias("_last"))
    return d.join(F.broadcast(total)).select("word", (F.col("id") / F.col("_last")).alias("rank"))  # a single row


def sampled(words: DataFrame, share: float) -> DataFrame:
    """The words whose digest lies in the lowest ``share`` of all: the same ones at every run and in every part."""
    return words.where(F.md5(F.col("word").cast("binary")) < f"{int(share * 2**32):08x}")


def random_words(words: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` words in the order of a digest of seed and word."""
    return words.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "word").cast("binary")), "word").limit(n)


def first_difference_counts(words: DataFrame) -> DataFrame:
    """``shared``, ``cnt``: how often neighbours in order share so many characters at their start."""
    near = with_previous(words.select("word"), ["word"], "word", "before").where("before is not null")
    return near.select(common_prefix_length(F.col("before"), F.col("word")).alias("shared")).groupBy("shared").agg(F.count("*").alias("cnt"))


def word_stats(words: DataFrame) -> DataFrame:
    """One row: ``words``, ``total_len``, ``max_len``, ``prefixes`` (different starts, the empty one among them: nodes of a trie)."""
    n = F.char_length("word").cast("long")
    starts = prefixes_of(words, "word").select("prefix").distinct().agg(F.count("*").alias("prefixes"))
    return words.agg(F.count("*").alias("words"), F.sum(n).alias("total_len"), F.max(n).alias("max_len")).join(F.broadcast(starts))  # single rows
