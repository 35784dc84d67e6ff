"""Lines from outside files: HTTP addresses and programs, as a data source with a part for each, and settings of ini files."""

from __future__ import annotations

import shlex
import subprocess
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Origin(InputPartition):
    def __init__(self, kind: str, value: str):
        self.kind, self.value = kind, value


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.origins = [_Origin(kind, v) for kind in ("url", "command") for v in options.get(kind, "").split("\n") if v]

    def partitions(self) -> list[InputPartition]:
        return self.origins

    def read(self, partition: _Origin) -> Iterator[tuple[str, str]]:
        if partition.kind == "url":
            with urllib.request.urlopen(partition.value) as source:
                for line in source:
                    yield partition.value, line.decode().rstrip("\r\n")
            return
        with subprocess.Popen(shlex.split(partition.value), stdout=subprocess.PIPE, text=True) as run:
            for line in run.stdout:
                yield partition.value, line.rstrip("\r\n")
        if run.returncode:
            raise RuntimeError(f"{partition.value} ended with {run.returncode}")


class LineSource(DataSource):
    """``origin``, ``line`` of the addresses in ``url`` and the programs in ``command``, one a line of the option."""

    @classmethod
    def name(cls) -> str:
        return "lines_of"

    def schema(self) -> str:
        return "origin string, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_lines_of(spark: SparkSession, urls: list[str] = (), commands: list[str] = ()) -> DataFrame:
    """``origin``, ``line``: each address is fetched, each program run, by a task of its own; a program that fails is an error."""
    if not urls and not commands:
        return spark.createDataFrame([], "origin string, line string")
    spark.dataSource.register(LineSource)
    return spark.read.format("lines_of").options(url="\n".join(urls), command="\n".join(commands)).load()


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """``section``, ``key``, ``value`` of ini files; lines before a section have an empty one, ``;`` and ``#`` begin comments, the last value of a key counts."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\\r?\\n")).alias("at", "raw"))
    line = F.trim("raw")
    within = Window.partitionBy("file").orderBy("at")  # a file of settings
    section = F.last(F.when(line.rlike(r"^\[.*\]$"), F.regexp_extract(line, r"^\[(.*)\]$", 1)), ignorenulls=True).over(within)
    rows = files.select("file", "at", F.coalesce(section, F.lit("")).alias("section"), line.alias("line")).where(r"line rlike '^[^;#\\[=][^=]*='")
    pairs = rows.select("file", "at", "section", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.regexp_replace("line", "^[^=]*=", "")).alias("value"))
    return pairs.groupBy("section", "key").agg(F.max_by("value", F.struct("file", "at")).alias("value"))
