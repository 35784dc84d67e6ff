"""Parsers of documents as table functions, so that any parser can feed an index."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register_parser(spark: SparkSession, name: str, parse: Callable[[str], Iterable[tuple[str, str]]]) -> None:
    """Makes ``parse``, which gives the (field, term) pairs of a text, a table function of SQL and of :func:`parsed`."""

    class Parser:
        def eval(self, text: str):
            yield from parse(text or "")

    spark.udtf.register(name, F.udtf(Parser, returnType="field string, term string"))


def parsed(docs: DataFrame, doc: str, column: str, name: str) -> DataFrame:
    """``doc``, ``field``, ``term``, ``freq`` of a registered parser's pairs."""
    rows = docs.sparkSession.sql(f"SELECT d.`{doc}`, p.field, p.term FROM {{docs}} d, LATERAL {name}(d.`{column}`) p", docs=docs)
    return rows.groupBy(doc, "field", "term").agg(F.count("*").alias("freq"))
