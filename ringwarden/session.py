"""Sessions and table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ringwarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the queries assume (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a dataset folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
