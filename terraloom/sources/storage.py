"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: one folder for all that this process writes in between
RUN = f"run-{uuid.uuid4().hex}"
_made: str | None = None


def run_folder(spark: SparkSession) -> str:
    """This run's folder under `spark.checkpoint.dir`; where that is unset and all runs on one machine (tests), under an own temporary one."""
    global _made
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if _made is None:
            folder = tempfile.mkdtemp(prefix="terraloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)  # one machine, one process: nothing reads it any more
            _made = f"file://{folder}"
        base = _made
    return f"{base.rstrip('/')}/{RUN}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the run's folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_run(spark: SparkSession) -> None:
    """Remove the run's folder, when no result that reads from it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts the lineage with a copy that survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, rows: int = 50_000) -> DataFrame:
    """Rows dealt out by a key, about so many a task: a narrow table may lie in one block of one file, which one task reads."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def ranged(df: DataFrame, key: str, rows: int = 50_000) -> DataFrame:
    """Rows dealt out by ranges of a key, about so many a task: neighbours stay together."""
    return df.repartitionByRange(max(1, -(-df.count() // rows)), key)
