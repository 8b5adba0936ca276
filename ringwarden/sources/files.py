"""Corpus files: JSON lines, one JSON array, delimited lines with rejects, files that may be missing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """The rows of JSON-lines files; blank lines are skipped, missing fields are null."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(row, ...): the elements of a file that holds one JSON array, numbered from 0; ``schema`` is that of an element."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("row", "x"))
    return rows.select("row", "x.*")


def read_delimited(spark: SparkSession, path: str, labels: list[str], least_words: int = 15) -> DataFrame:
    """(file, line, label, grp, text, problem) of ``label|group|text`` lines, in files that a glob may name.

    Lines are split at the first two bars and numbered from 1; blank ones are left
    out.  problem is null for a good line, else the first that holds: FIELDS
    (too few), LABEL (not in ``labels``), BAR (a bar in the text), SHORT (fewer than
    ``least_words`` words).  A file is read by one task, as line numbers need.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "raw"))
    part = F.split("raw", r"\|", 3)
    cut = lines.where(F.trim("raw") != "").select("file", (F.col("line") + 1).alias("line"), F.trim(F.get(part, 0)).alias("label"),
                                                  F.trim(F.get(part, 1)).alias("grp"), F.trim(F.get(part, 2)).alias("text"))
    problem = (F.when(F.col("text").isNull(), "FIELDS").when(~F.col("label").isin(labels), "LABEL").when(F.col("text").contains("|"), "BAR")
               .when(F.size(F.split("text", r"\s+")) < least_words, "SHORT"))
    return cut.withColumn("problem", problem)


def read_optional(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of JSON-lines files, none if the path does not exist."""
    try:
        return read_json_lines(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def row_digest(*columns: str) -> Column:
    """An aggregate that names a set of rows whatever their order: the sum of 32 bits of each row's MD5."""
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return F.sum(F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long"))


def write_json_lines(df: DataFrame, path: str) -> DataFrame:
    """Write JSON lines and return (rows, digest) of what was written; row order does not matter."""
    df.write.json(path)
    back = read_json_lines(df.sparkSession, path, df.schema)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(row_digest(*df.columns), F.lit(0)).alias("digest"))
