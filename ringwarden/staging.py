"""Intermediate tables in the folder that all executors share.

A staged table cuts lineage like ``checkpoint()`` does, but is columnar and far
smaller.  It lives under ``spark.checkpoint.dir``; only where that setting is
missing and the master is local, as in tests, a folder of this machine is taken.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="ringwarden-")
    return _fallback[app]


class Staging:
    """Named tables of one run of an operator, each written once as Parquet."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_root(spark)}/ringwarden-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table as read again."""
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._staged_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._staged_path)
            path.getFileSystem(conf).delete(path, True)
