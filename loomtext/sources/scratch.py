"""Tables that a job writes and reads again, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session that names none (tests) gets a temporary folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomtext-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own: what follows neither computes it again nor loses it with an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomtext-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Column of the part in tables that `in_ranges` writes.
PART = "_part"


def in_ranges(df: DataFrame, keys: list, parts: int | None = None) -> DataFrame:
    """df as a written table, cut by ranges of its keys into parts whose numbers follow the keys' order; equal keys share a part."""
    cut = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return written(cut.withColumn(PART, F.spark_partition_id()))
