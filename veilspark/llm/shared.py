"""Tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the tables that the innermost scratch() is to remove.
_paths: ContextVar[list[str] | None] = ContextVar("paths", default=None)


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


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there and survives lost executors. options: of the writer."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _paths.get()) is not None:
        paths.append(at)
    df.write.options(**options).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a table written inside go when it is written, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Rows up to which a narrow table (a few numbers or digests a row, some 100 bytes in memory) is broadcast.
NARROW = 500_000


def small(narrow: DataFrame, rows: int = NARROW) -> DataFrame:
    """A narrow written table, to be broadcast if it has no more than `rows` rows (its files' footers tell), else joined as Spark sees fit."""
    return F.broadcast(narrow) if narrow.count() <= rows else narrow


def removed(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end; what is to outlive them is written after it, see `settled`."""
    paths: list[str] = []
    token = _paths.set(paths)
    try:
        yield
    finally:
        _paths.reset(token)
        for at in paths:
            removed(spark, at)


def settled(make, spark: SparkSession, name: str) -> DataFrame:
    """The rows of make() as a table; all tables that make() writes on the way are removed."""
    outer = _paths.get()
    with scratch(spark):
        rows = make()
        inner = _paths.set(outer)
        try:
            return written(rows, name)
        finally:
            _paths.reset(inner)
