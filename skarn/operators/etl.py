"""Row streams: lookups beside a stream, key and value splitting, sorted runs, log parsing, inverted indexes."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skarn.functions.scalar import field
from skarn.operators.ordered import running_sums, with_previous


def lookup_join(rows: DataFrame, dimension: DataFrame, on: dict[str, str], take: dict[str, str], check: bool = True) -> DataFrame:
    """``rows`` with columns of ``dimension`` (``take``: new name to column), empty where nothing is found.

    ``on``: column of ``rows`` to key column; several form one key. Each row gets one
    answer: a key that ``dimension`` repeats is an error, unless ``check`` is off, where
    the caller vouches for it.
    """
    keys = [*on.values()]
    side = dimension.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_v_{n}") for n, c in take.items()))
    if check:
        several = side.groupBy(*(f"_k_{k}" for k in keys)).agg(F.count("*").alias("_n"), *(F.first(f"_v_{n}").alias(f"_v_{n}") for n in take))
        side = several.select("*", F.when(F.col("_n") > 1, F.raise_error(F.lit("a key has several answers"))).alias("_bad")).where("_bad is null").drop("_n", "_bad")
    joined = rows.join(side, [rows[c] == side[f"_k_{k}"] for c, k in on.items()], "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(f"_v_{n}").cast("string"), F.lit("")).alias(n) for n in take))


def external_lookup(rows: DataFrame, column: str, command: list[str], name: str = "answer") -> DataFrame:
    """``rows`` with a program's answers: it is run for each Arrow batch, reads one key a line and must write one line for each, which may be empty."""

    def asked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys = ["" if k is None else str(k) for k in b.column(b.schema.names.index(column)).to_pylist()]
            if any("\n" in k for k in keys):
                raise ValueError("a key has a line end")
            said = subprocess.run(command, input="".join(k + "\n" for k in keys), capture_output=True, text=True, check=True).stdout if keys else ""
            answers = said.split("\n")[: said.count("\n")]
            if len(answers) != len(keys):
                raise ValueError(f"{len(answers)} answers to {len(keys)} keys")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string())], [*b.schema.names, name])

    return rows.mapInArrow(asked, StructType([*rows.schema.fields, StructField(name, StringType())]))


def project_fields(lines: DataFrame, column: str, places: list[int], delimiter: str = "\t") -> DataFrame:
    """Fields of a delimited line by 1-based place, in the order asked for; missing ones are empty."""
    return lines.select(F.concat_ws(delimiter, *(field(F.col(column), delimiter, p - 1) for p in places)).alias("line"))


def split_kv(lines: DataFrame, column: str, key_places: list[int], delimiter: str = "\t") -> DataFrame:
    """``key``, ``val``: the 0-based fields named, in that order, and all the others; missing key fields are empty."""
    fields = F.split(F.col(column), delimiter)
    rest = F.filter(F.transform(fields, lambda x, i: F.when(~i.isin(key_places), x)), lambda x: x.isNotNull())
    return lines.select(F.concat_ws(delimiter, *(field(F.col(column), delimiter, p) for p in key_places)).alias("key"), F.array_join(rest, delimiter).alias("val"))


def split_first_tab(lines: DataFrame, column: str) -> DataFrame:
    """``key``, ``value`` around the first tab; without one the value is empty; empty lines are skipped."""
    c = F.col(column)
    return lines.where(c != "").select(F.substring_index(c, "\t", 1).alias("key"), F.when(F.instr(c, "\t") > 0, F.expr(f"substring({column}, instr({column}, '\t') + 1)")).otherwise("").alias("value"))


def sorted_runs(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """``df`` with ``run``: the number of breaks so far, one wherever a value is smaller than the one before."""
    marked = with_previous(df, order, value, "_before")
    return running_sums(marked, order, {"run": F.when(F.col("_before") > F.col(value), 1).otherwise(0).cast("long")}).drop("_before")


def document_terms(df: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    """``doc``, ``field``, ``term``, ``freq`` of the fields' lower-case words, which are runs of letters and digits of any script."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields)))
    words = df.select(doc, each.alias("e")).select(doc, "e.field", F.explode(F.split(F.lower("e.text"), r"[^\p{L}\p{N}]+")).alias("term"))
    return words.where("term <> ''").groupBy(doc, "field", "term").agg(F.count("*").alias("freq"))


def metadata_terms(df: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    """Distinct ``doc``, ``term`` with terms ``field:value``."""
    return df.select(doc, F.explode(F.array(*(F.concat(F.lit(f + ":"), F.col(f)) for f in fields))).alias("term")).where("term is not null").distinct()


def posting_lists(terms: DataFrame, doc: str, most: int = 100_000) -> DataFrame:
    """``term``, ``part``, ``docs`` (ascending ids joined by commas), ``df``: lists of very frequent terms come in parts of id ranges.

    A list holds the ids of one range of about ``most`` ids, so no row holds an unbounded list.
    """
    part = F.floor(F.col(doc) / most).cast("long")
    lists = terms.groupBy("term", part.alias("part")).agg(F.sort_array(F.collect_set(doc)).alias("ids"))
    return lists.select("term", "part", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("docs"), F.size("ids").cast("long").alias("df"))


def posting_ranges(terms: DataFrame, doc: str, most: int = 100_000) -> DataFrame:
    """``term``, ``part``, ``df``, ``first_doc``, ``last_doc``, ``hits`` of ``doc``, ``term``, ``freq`` rows: what an index knows of each range of ``most`` ids of a term."""
    part = F.floor(F.col(doc) / most).cast("long")
    return terms.groupBy("term", part.alias("part")).agg(
        F.count_distinct(doc).alias("df"), F.min(doc).alias("first_doc"), F.max(doc).alias("last_doc"), F.sum("freq").alias("hits")
    )


def document_postings(df: DataFrame, doc: str, column: str, most: int = 100_000) -> DataFrame:
    """:func:`posting_ranges` of the :func:`document_terms` of one column, without a shuffled row for each term of each document.

    Whole texts are dealt by ``doc`` once, so that a task has all rows of a document and knows
    which have a text of their own: their terms are counted by range at once. Only documents
    of several rows are told apart by their terms. A text's words are sorted within its row,
    where a word that differs from the one before is a term's first.
    """
    part = F.floor(F.col(doc) / most).cast("long")
    rows = df.where(F.col(column).isNotNull()).select(doc, column).repartitionByRange(doc)
    counted = rows.withColumn("_rows", F.count("*").over(Window.partitionBy(doc)))
    texts = counted.select(doc, F.when(F.col("_rows") > 1, F.col(doc)).alias("_own"), F.sort_array(F.split(F.lower(column), r"[^\p{L}\p{N}]+")).alias("_words"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("_words"))  # one longer than the words, so the last pair has no word
    words = texts.select(doc, "_own", F.explode(F.arrays_zip(F.col("_words").alias("term"), before.alias("before"))).alias("w")).where("w.term <> ''")
    first = F.when(~F.equal_null("w.term", "w.before"), F.col(doc))
    in_task = words.groupBy("w.term", part.alias("part"), "_own").agg(
        F.count(first).alias("df"), F.min(doc).alias("first_doc"), F.max(doc).alias("last_doc"), F.count("*").alias("hits")
    )
    return in_task.groupBy("term", "part").agg(
        F.sum(F.when(F.col("_own").isNull(), F.col("df")).otherwise(1)).alias("df"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.sum("hits").alias("hits")
    )


def range_lookup(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str, width: int, take: list[str]) -> DataFrame:
    """Columns ``take`` of the range [start, end) that each point lies in: an equi-join on cells, then the test.

    Cells are ``width`` wide, 64 times as wide for ranges over 64 cells, and so on, so no
    range has over 65 cells; points look in the cells of every width that ranges use.
    """
    size = F.greatest((F.col(end) - F.col(start)) / width, F.lit(1.0))
    level = F.floor(F.log(64.0, size) - 1e-9).cast("int")
    levelled = ranges.withColumn("_level", F.greatest(level, F.lit(0)))
    used = sorted(r[0] for r in levelled.select("_level").distinct().collect())  # a handful, whatever the ranges
    cell = lambda c: F.floor(F.col(c) / (F.lit(width) * F.pow(F.lit(64.0), F.col("_level"))))
    cells = levelled.withColumn("_last", F.col(end) - 1).withColumn("_cell", F.explode(F.sequence(cell(start), cell("_last"))))
    near = points.withColumn("_level", F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumn("_cell", cell(at))
    hit = near.join(cells.select("_level", "_cell", start, end, *take), ["_level", "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
    return hit.select(*points.columns, start, *take)


#: Categories of a log line's parts, each with its pattern (own patterns; longest match wins at each place).
LOG_PATTERNS = {
    "datetime": r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}[ t][0-9]{1,2}:[0-9]{2}:[0-9]{2}",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "pair": r"([a-z_][a-z0-9_]*)[=:] ?\"?([a-z0-9_.@-]+)\"?",
}


def parse_log(lines: DataFrame, doc: str, column: str, patterns: dict[str, str] = LOG_PATTERNS) -> DataFrame:
    """``doc``, ``field``, ``term``, ``freq`` of log lines.

    A lower-case line is scanned from its start: the longest match of any pattern at a place
    is a term, and scanning goes on behind it; without a match it goes on one character
    further. A pattern with two groups gives field and term, others the category as field.
    """

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        compiled = [(name, re.compile(p)) for name, p in patterns.items()]
        anywhere = re.compile("|".join(f"(?:{p})" for p in patterns.values()))
        for part in it:
            out = []
            for d, line in zip(part[doc], part[column], strict=True):
                line, at, seen = (line or "").lower(), 0, {}
                while start := anywhere.search(line, at):
                    at = start.start()
                    found = [(m.end(), name, m) for name, p in compiled if (m := p.match(line, at)) and m.end() > at]
                    end = max((f[0] for f in found), default=at + 1)
                    for e, name, m in found:
                        if e == end:
                            key = (m[1], m[2]) if m.re.groups >= 2 else (name, m[0])
                            seen[key] = seen.get(key, 0) + 1
                    at = end
                out += [(d, f, t, n) for (f, t), n in seen.items()]
            yield pd.DataFrame(out, columns=[doc, "field", "term", "freq"])

    kind = lines.schema[doc].dataType.simpleString()
    return lines.select(doc, column).mapInPandas(scan, f"{doc} {kind}, field string, term string, freq long")


def log_lines(terms: DataFrame, lines: DataFrame, doc: str, column: str, source: Column) -> DataFrame:
    """``line``: ``key:val <tab> line <tab> source`` for every term of every line."""
    return terms.join(lines.select(doc, column, source.alias("_source")), doc).select(F.concat_ws("\t", F.concat_ws(":", "field", "term"), column, "_source").alias("line"))
