"""Counts of lengths, bytes and words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that :func:`byte_counts` counts at once.
SLICE = 1 << 20


def word_counts(df: DataFrame, word: Column, weight: Column | None = None) -> DataFrame:
    """``word``, ``cnt``: summed weights; a missing weight, or one below 1, counts as 1; empty words don't count."""
    one = F.lit(1) if weight is None else F.greatest(F.coalesce(weight, F.lit(1)), F.lit(1))
    return df.select(word.alias("word"), one.cast("long").alias("w")).where("word <> ''").groupBy("word").agg(F.sum("w").alias("cnt"))


def most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent words, of equal ones the smaller."""
    return counts.orderBy(F.desc("cnt"), "word").limit(n)


def histogram(df: DataFrame, key: Column) -> DataFrame:
    """``len``, ``cnt``: how often each key occurs."""
    return df.select(key.cast("long").alias("len")).groupBy("len").agg(F.count("*").alias("cnt"))


def histogram_summary(h: DataFrame) -> DataFrame:
    """One row on a histogram ``len``, ``cnt``; of equal counts the smallest key is named."""
    return h.agg(
        F.count("*").alias("distinct_key_cnt"),
        F.sum("cnt").cast("long").alias("cnt_sum"),
        F.sum(F.col("cnt") * F.col("len")).cast("long").alias("total_key_len"),
        F.min("len").alias("min_key"),
        F.max("len").alias("max_key"),
        F.min_by("len", F.struct("cnt", "len")).alias("min_cnt_key"),
        F.max_by("len", F.struct("cnt", -F.col("len"))).alias("max_cnt_key"),
    )


def symbol_counts(df: DataFrame, column: str, order: int = 0) -> DataFrame:
    """Counts of each character after the ``order`` characters before it (``prev``, ``cur``, ``cnt``; no ``prev`` for order 0)."""
    n = F.char_length(column) - order
    places = df.select(column, F.explode(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("i"))
    cur = F.expr(f"substring({column}, i + {order}, 1)").alias("cur")
    if not order:
        return places.select(cur).groupBy("cur").agg(F.count("*").alias("cnt"))
    return places.select(F.expr(f"substring({column}, i, {order})").alias("prev"), cur).groupBy("prev", "cur").agg(F.count("*").alias("cnt"))


def entropy_bytes(counts: DataFrame, context: list[str] | None = None) -> DataFrame:
    """``bytes``: size of an ideal code of what ``counts`` counted, given its context columns."""
    context = context or []
    total = counts.groupBy(*context).agg(F.sum("cnt").alias("total"))
    joined = counts.join(total, context) if context else counts.crossJoin(F.broadcast(total))  # a single row
    return joined.agg(F.round(-F.sum(F.col("cnt") * F.log2(F.col("cnt") / F.col("total"))) / 8, 4).alias("bytes"))


def byte_counts(df: DataFrame, column: str, order: int = 0) -> DataFrame:
    """``prev``, ``cur``, ``cnt``: counts of each UTF-8 byte after the ``order`` bytes before it, in hexadecimal; no ``prev`` for order 0.

    Texts are counted by NumPy in slices of :data:`SLICE` bytes, however many an Arrow batch
    has; what is shuffled are a slice's counts.
    """
    kind = (np.uint8, np.uint16, np.uint32, np.uint32)[order] if order < 4 else np.int64

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(0).drop_null().cast(pa.large_binary())
            if not len(texts):
                continue
            at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for start in range(at[0] + order, at[-1], SLICE):
                n = min(SLICE, at[-1] - start)
                codes = data[start - order : start - order + n].astype(kind)
                for k in range(1, order + 1):
                    codes <<= 8
                    codes |= data[start - order + k : start - order + k + n]
                within = np.ones(n, bool)  # no code reaches back over the start of its text
                for first in at[np.searchsorted(at, start - order, "right") : np.searchsorted(at, start + n)] - start:
                    within[max(first, 0) : max(first + order, 0)] = False
                code, times = np.unique(codes[within], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(times, pa.int64())], ["code", "n"])

    counts = df.select(F.col(column)).mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("cnt"))
    cur = F.lpad(F.hex(F.col("code").bitwiseAND(F.lit(255))), 2, "0").alias("cur")
    prev = [F.lpad(F.hex(F.shiftright("code", 8)), 2 * order, "0").alias("prev")] if order else []
    return counts.select(*prev, cur, "cnt")
