"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where it is unset, and only on a local
    master, a temporary folder is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="varisel-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing will read again."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spent_shuffles_go(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator`` on a DataFrame; shuffle files of the jobs that it runs go when the job ends, and not when the driver
    happens to collect its garbage: what ``written`` has stored needs them no more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @wraps(operator)
    def run(df: DataFrame, *args, **named) -> DataFrame:
        conf = df.sparkSession.conf
        before = conf.get(key)
        conf.set(key, "true")
        try:
            return operator(df, *args, **named)
        finally:
            conf.set(key, before)

    return run
