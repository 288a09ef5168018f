"""A translation cache as a partitioned table: lookups by key, upserts that rewrite only the parts they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Entries live so many days.
DAYS = 7
#: Parts of the table: 256, by the first characters of the key.
BUCKET = 2
COLUMNS = ["key", "value", "ts", "bucket"]


def key(text: Column, source: Column, target: Column, backend: Column) -> Column:
    return F.md5(F.concat_ws("|", text, source, target, backend))


def _folder(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def exists(spark: SparkSession, path: str) -> bool:
    files, name = _folder(spark, path)
    return files.exists(name)


def read(spark: SparkSession, path: str, now: Column | None = None, days: int = DAYS) -> DataFrame:
    """Entries (key, value, ts, bucket) that have not expired at `now`; none where there is no table yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, value string, ts timestamp, bucket string")
    t = spark.read.schema("key string, value string, ts timestamp, bucket string").parquet(path)
    return t if now is None else t.where(F.col("ts") > now - F.expr(f"interval {days} days"))


def get(texts: DataFrame, path: str, now: Column, days: int = DAYS) -> DataFrame:
    """texts (key) with the cached value, null where there is none that lives. Parts of the table are pruned by the join's bucket."""
    live = read(texts.sparkSession, path, now, days).select("key", F.col("bucket").alias("_bucket"), F.col("value").alias("cached"))
    x = texts.withColumn("_b", F.substring("key", 1, BUCKET))
    return x.join(live.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (F.col("_b") == F.col("_bucket")), "left").drop("_key", "_bucket", "_b")


def upsert(new: DataFrame, path: str, now: Column, days: int = DAYS) -> None:
    """Write entries (key, value, ts) into the table: the latest of a key wins (then the greater value), expired ones of touched parts go.

    Null keys and blank values are not kept. Only parts that `new` touches are read and rewritten, each as a whole (dynamic partition overwrite): a job
    that fails leaves the others as they were. The merged rows are a table of their own before anything is overwritten. One writer at a time.
    """
    spark = new.sparkSession
    good = new.where(F.col("key").isNotNull() & (F.trim(F.coalesce("value", F.lit(""))) != "")).select("key", "value", "ts", F.substring("key", 1, BUCKET).alias("bucket"))
    good = written(good)
    touched = [r.bucket for r in good.select("bucket").distinct().collect()]  # 256 at most for md5 keys
    old = read(spark, path).where(F.col("bucket").isin(touched)) if touched else read(spark, path).limit(0)
    latest = old.select(*COLUMNS).unionByName(good).groupBy("key").agg(F.max(F.struct("ts", "value")).alias("e"))
    live = latest.select("key", "e.value", "e.ts", F.substring("key", 1, BUCKET).alias("bucket")).where(F.col("ts") > now - F.expr(f"interval {days} days"))
    merged = written(live)
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
