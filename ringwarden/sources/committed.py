"""Tables that are written together: a batch counts when its manifest, written last, is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch long, name string, rows long"


def committed_batches(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, name, rows) of the batches that count."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{folder}/commits")


def write_together(tables: dict[str, DataFrame], folder: str, batch: int, before_commit=None) -> bool:
    """Write the tables of a batch, then its manifest; False if the batch counts already and nothing is done.

    Parts of a broken attempt are replaced, as no reader sees them.  ``before_commit`` is
    called between data and manifest.
    """
    spark = next(iter(tables.values())).sparkSession
    if not committed_batches(spark, folder).where(F.col("batch") == batch).isEmpty():
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    rows = [(batch, name, spark.read.schema(df.schema).parquet(f"{folder}/{name}/batch={batch}").count()) for name, df in tables.items()]
    if before_commit:
        before_commit()
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/{batch}")
    return True


def read_committed(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The rows of a table's batches that count, with ``batch``."""
    done = committed_batches(spark, folder).where(F.col("name") == name).select("batch")
    if done.isEmpty():
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/{name}").join(done, "batch", "left_semi")
