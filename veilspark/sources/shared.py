"""Cutting lineage by tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of each application of this process that has no spark.checkpoint.dir.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine if driver and executors are one process, else an error."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    return _own[context.applicationId]


def removed(spark: SparkSession, at: str) -> None:
    """Removes a table's folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Rounds:
    """Tables of an iteration: each is written to the shared folder and read back; those no longer wanted are removed.

    A table is whole before its predecessor goes, so a lost executor costs a retried task and never the iteration.
    """

    def __init__(self, spark: SparkSession, name: str = "settled"):
        self.spark, self.name, self.paths = spark, name, {}

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def only(self, *kept: DataFrame) -> None:
        """Removes all tables of this iteration but `kept`."""
        stay = {id(k) for k in kept}
        for i in [i for i in self.paths if i not in stay]:
            removed(self.spark, self.paths.pop(i)[0])


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """The rows, written to the shared folder and read back."""
    return Rounds(df.sparkSession, name)(df)
