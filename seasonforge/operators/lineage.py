"""Cutting lineage: a frame as a table in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return path or _own_dir()


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="seasonforge-tables-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written and read back: iterations over it keep short plans, and lost executors cost no recomputation."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._table_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table behind a frame of ``written`` that nothing reads any more."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._table_path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
