"""Algebra of k inputs, and boolean search over postings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tagged(ways: list[DataFrame]) -> DataFrame:
    """``key``, ``way`` of all inputs; each has one column."""
    return reduce(DataFrame.unionByName, [w.select(F.col(w.columns[0]).alias("key"), F.lit(i).alias("way")) for i, w in enumerate(ways)])


def merge(ways: list[DataFrame]) -> DataFrame:
    """All keys of all inputs, repeats kept, in order."""
    return tagged(ways).select("key").orderBy("key")


def union(ways: list[DataFrame]) -> DataFrame:
    return tagged(ways).select("key").distinct()


def intersection(ways: list[DataFrame]) -> DataFrame:
    """Keys that every input has; repeats within an input count once. One shuffle whatever the number of inputs."""
    return tagged(ways).groupBy("key").agg(F.count_distinct("way").alias("n")).where(F.col("n") == len(ways)).select("key")


def equal_counts(ways: list[DataFrame], least: int = 1) -> DataFrame:
    """``key``, ``cnt``: how many elements of all inputs equal it, repeats included."""
    return tagged(ways).groupBy("key").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def in_at_least(ways: list[DataFrame], k: int) -> DataFrame:
    """Keys of at least ``k`` different inputs."""
    return tagged(ways).groupBy("key").agg(F.count_distinct("way").alias("n")).where(F.col("n") >= k).select("key")


def group_sizes(ways: list[DataFrame]) -> DataFrame:
    """``key``, ``first``, ``rest``: of each group of equal keys in the merge of all inputs, its rows in the first input and in the others."""
    return tagged(ways).groupBy("key").agg(F.count_if(F.col("way") == 0).alias("first"), F.count_if(F.col("way") > 0).alias("rest"))


def sizes(ways: list[DataFrame]) -> DataFrame:
    """``union_size``, ``intersection_size`` in one pass."""
    by_key = tagged(ways).groupBy("key").agg(F.count_distinct("way").alias("n"))
    return by_key.agg(F.count("*").alias("union_size"), F.count_if(F.col("n") == len(ways)).alias("intersection_size"))


def multiset_intersection(a: DataFrame, b: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows of ``a`` that ``b`` has too; all repeats of ``a`` stay."""
    return a.join(b, on, "left_semi")


@dataclass(frozen=True)
class Query:
    """A boolean search over postings: its words, and whether a document has it, given the term column.

    Made by :func:`has` and :func:`at_least` and put together by ``&`` (and), ``|`` (or),
    ``-`` (without) and ``^`` (either but not both), which bind as Python has it: ``-``
    before ``&`` before ``^`` before ``|``.
    """

    words: tuple[str, ...]
    found: Callable[[Column], Column]

    def _with(self, other: Query, put: Callable[[Column, Column], Column]) -> Query:
        return Query(self.words + other.words, lambda term: put(self.found(term), other.found(term)))

    def __and__(self, other: Query) -> Query:
        return self._with(other, lambda a, b: a & b)

    def __or__(self, other: Query) -> Query:
        return self._with(other, lambda a, b: a | b)

    def __sub__(self, other: Query) -> Query:
        return self._with(other, lambda a, b: a & ~b)

    def __xor__(self, other: Query) -> Query:
        return self._with(other, lambda a, b: a != b)


def has(word: str) -> Query:
    """Documents with a term; a term of a field is ``field:value``."""
    return Query((word,), lambda term: F.coalesce(F.bool_or(term == word), F.lit(False)))


def at_least(k: int, *words: str) -> Query:
    """Documents with at least ``k`` of some terms."""
    parts = [has(w) for w in words]
    return Query(words, lambda term: reduce(Column.__add__, [p.found(term).cast("int") for p in parts], F.lit(0)) >= k)


def matching(postings: DataFrame, query: Query, doc: str = "doc_id", term: str = "term") -> DataFrame:
    """Documents of ``term``/``doc`` rows that a query finds: one aggregate by document over the rows of its terms, so one shuffle however many there are."""
    rows = postings.where(F.col(term).isin(*query.words))
    return rows.groupBy(doc).agg(query.found(F.col(term)).alias("_hit")).where("_hit").select(doc)
