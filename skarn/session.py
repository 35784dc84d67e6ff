"""Session settings and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "skarn", **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` adds or replaces settings.

    A master is only set when none is given from outside, so the same code runs
    under spark-submit.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).config(map=settings)
    if "spark.master" not in settings and "MASTER" not in os.environ and "PYSPARK_GATEWAY_PORT" not in os.environ:
        builder = builder.master("local[*]")
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
