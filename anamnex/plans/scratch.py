"""Tables written once in the folder that the cluster shares, so that what they cost is paid once and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where it may be unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.anamnex.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="anamnex-scratch-")
        spark.conf.set("spark.anamnex.scratch.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession) -> str:
    """A new folder there, which goes when the application ends: what is read from it must have run by then."""
    root = f"{shared_dir(spark)}/anamnex-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{fresh_dir(spark)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
