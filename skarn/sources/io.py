"""Readers and writers of lines and length-prefixed binary records."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.scalar import chomp
from skarn.sources.scratch import stored


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of text files, without line ends; gzip, bzip2 and zstd files are read as such."""
    return spark.read.text(path).select(chomp(F.col("value")).alias("line"))


def read_fields(spark: SparkSession, path: str, names: list[str], delimiter: str = "\t") -> DataFrame:
    """Delimited lines as string columns; quotes mean nothing, missing fields are empty."""
    rows = spark.read.csv(path, sep=delimiter, quote="", schema=", ".join(f"`{n}` string" for n in names))
    return rows.fillna("")


def read_input_spec(spark: SparkSession, path: str) -> DataFrame:
    """``host``, ``source_path``, ``local_path``: lines of exactly three fields, any other is an error."""
    parts = F.split("line", "\t")
    checked = F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("not three fields: "), F.col("line"))).cast("array<string>"))
    return read_lines(spark, path).where("line <> ''").select(checked.alias("p")).select(*(F.col("p")[i].alias(n) for i, n in enumerate(("host", "source_path", "local_path"))))


def read_fixed(spark: SparkSession, path: str, length: int) -> DataFrame:
    """``path``, ``at``, ``record``: files cut into records of ``length`` bytes."""
    files = spark.read.format("binaryFile").load(path)
    starts = F.explode(F.when(F.length("content") > 0, F.sequence(F.lit(0), F.length("content") - 1, F.lit(length))).otherwise(F.array().cast("array<int>")))
    return files.select("path", "content", starts.alias("at")).select("path", "at", F.expr(f"substring(content, at + 1, {length})").alias("record"))


def _prefixed(content: bytes, inclusive: bool) -> Iterator[bytes]:
    at = 0
    while at + 4 <= len(content):
        n = int.from_bytes(content[at : at + 4], "little", signed=True)
        size = n - 4 if inclusive else n
        if size < 0 or at + 4 + size > len(content):
            raise ValueError(f"a record at {at} doesn't fit its file")
        yield content[at + 4 : at + 4 + size]
        at += 4 + size


def read_records(spark: SparkSession, path: str, inclusive: bool = True) -> DataFrame:
    """``path``, ``record``: records after a 32-bit little-endian length, which counts itself if ``inclusive``."""

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in it:
            for name, content in zip(files["path"], files["content"], strict=True):
                yield pd.DataFrame({"path": name, "record": list(_prefixed(content, inclusive))}, columns=["path", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "path string, record binary")


def read_kv(spark: SparkSession, path: str) -> DataFrame:
    """``key``, ``value``: records of two 32-bit lengths, key and value."""

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in it:
            for content in files["content"]:
                rows, at = [], 0
                while at < len(content):
                    k, v = (int.from_bytes(content[at + i : at + i + 4], "little") for i in (0, 4))
                    if at + 8 + k + v > len(content):
                        raise ValueError(f"a record at {at} doesn't fit its file")
                    rows.append((content[at + 8 : at + 8 + k], content[at + 8 + k : at + 8 + k + v]))
                    at += 8 + k + v
                yield pd.DataFrame(rows, columns=["key", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(cut, "key binary, value binary")


def read_tuples(spark: SparkSession, path: str, arity: int) -> DataFrame:
    """``path``, ``fields``: records of ``arity`` 32-bit ends of fields, then their bytes. A file is read in order, by one task."""

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in it:
            for name, content in zip(files["path"], files["content"], strict=True):
                rows, at = [], 0
                while at < len(content):
                    ends = [int.from_bytes(content[at + 4 * i : at + 4 * i + 4], "little") for i in range(arity)]
                    at += 4 * arity
                    if ends != sorted(ends) or at + ends[-1] > len(content):
                        raise ValueError(f"a record before {at} doesn't fit its file")
                    rows.append([content[at + a : at + z] for a, z in zip([0, *ends], ends)])
                    at += ends[-1]
                yield pd.DataFrame({"path": name, "fields": rows}, columns=["path", "fields"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "path string, fields array<binary>")


def tuple_records(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``record``: the columns as one record of :func:`read_tuples` each; nulls are empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary") for c in columns]
    ends = [reduce(lambda a, b: a + b, [F.octet_length(p) for p in parts[: i + 1]]) for i in range(len(parts))]
    return rows.select(F.concat(*map(little_endian, ends), *parts).alias("record"))


def write_outputs(rows: DataFrame, outputs: dict[str, tuple[str, list[str]]]) -> None:
    """One result to several places: path to (format, columns). The rows are worked out once."""
    kept = stored(rows, "outputs")
    for path, (kind, columns) in outputs.items():
        kept.select(*columns).write.format(kind).save(path)


def write_xml(rows: DataFrame, path: str, row: str = "doc", root: str = "result") -> None:
    """Rows as XML elements ``row`` below ``root``."""
    rows.write.format("xml").option("rowTag", row).option("rootTag", root).save(path)


def little_endian(n) -> F.Column:
    """A length as four bytes, lowest first."""
    digits = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in (7, 5, 3, 1))))


def kv_records(kv: DataFrame) -> DataFrame:
    """``record``: each key and value with their lengths before them."""
    k, v = F.col("key").cast("binary"), F.col("value").cast("binary")
    return kv.select(F.concat(little_endian(F.octet_length(k)), little_endian(F.octet_length(v)), k, v).alias("record"))


def concat_files(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """``path``, ``record``: whole files with their length before them, which counts itself; larger files are left out."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes)
    return files.select("path", F.concat(little_endian(F.octet_length("content") + 4), F.col("content")).alias("record"))


def write_parts(df: DataFrame, path: str, parts: int) -> None:
    """Lines of a one-column table in ``parts`` files."""
    df.repartition(parts).write.text(path)
