"""Structured Streaming: an index that grows with its documents, and windows over event time (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.etl import metadata_terms


def start_index(docs: DataFrame, doc: str, fields: list[str], path: str, checkpoint: str):
    """A query that appends ``doc``, ``term`` rows of a stream of documents to Parquet; they can be searched once written.

    Terms are their own ids, so arrival order needs no shared state.
    """
    terms = docs.select(doc, F.explode(F.array_distinct(F.array(*(F.concat(F.lit(f + ":"), F.col(f)) for f in fields)))).alias("term")).where("term is not null")
    return terms.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def search(index: DataFrame, doc: str, pattern: str) -> DataFrame:
    """Documents of an index with a term that starts with a match of ``pattern``."""
    from skarn.operators.patterns import anchored

    return index.where(anchored("term", pattern)).select(doc).distinct()


def batch_index(docs: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    return metadata_terms(docs, doc, fields)


def tumbling(events: DataFrame, at: str, key: str, value: str, width: str, late: str | None = None) -> DataFrame:
    """``start``, ``key``, ``n``, ``total`` of windows of ``width``; on a stream, rows later than ``late`` are dropped."""
    rows = events.withWatermark(at, late) if late else events
    out = rows.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str) -> DataFrame:
    """``key``, ``start``, ``n``: runs of a key's events with less than ``gap`` between them."""
    out = events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n")
