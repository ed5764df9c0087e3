"""Tables in the folder that driver and executors share; they cut lineage and outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigurationProblem

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it has none, a local session gets one of its own; on a cluster that is an error, as its machines share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationProblem("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="pricewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of df as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(p)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Of the tables written inside, only the last one, the result, is left; after an error none."""
    before = len(_written)
    try:
        yield
    except BaseException:
        _delete(spark, _written[before:])
        raise
    _delete(spark, _written[before:-1])


def newest() -> str:
    """The path of the table that was written last."""
    return _written[-1]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    _delete(spark, [path])


def clear(spark: SparkSession) -> None:
    """Deletes all tables of this process. DataFrames that were not collected or written elsewhere can't be read after that."""
    _delete(spark, list(_written))
