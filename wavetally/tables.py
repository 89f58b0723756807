"""Access to the input tables: one Parquet file or folder each."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table below ``sf_dir``; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read again, so that what follows neither repeats nor drags along its plan.

    A local session without that setting writes to a temporary folder; a cluster must have it.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}-stored"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
