"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a local session gets a temporary folder and any other its warehouse.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        local = (spark.sparkContext.master or "").startswith("local[") or spark.sparkContext.master == "local"
        _own_dir[app] = tempfile.mkdtemp(prefix="millrace-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return _own_dir[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: its lineage ends there, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


#: Bytes on disk of a table that are too few to be split by themselves: a few row groups at most.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table of long texts dealt evenly to all cores: its file is often a single row group, hence a single task.

    Larger tables are read as they are. Columns and filters are still pruned below.
    """
    spark = df.sparkSession
    size, cores = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 1 << 20 < size <= SMALL and cores > 1 else df


def discard(*tables: DataFrame) -> None:
    """Delete tables of `stored` that nothing reads any more: what was made of them has been stored in turn."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._millrace_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
