"""What the operators share: scratch tables, Arrow text access, work columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass holds at once; a longer single text is a pass of its own.
PASS_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch on its way to a Python worker, at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
#: Spark deletes a query's shuffle files at its end, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to BATCH where they are higher: batches of whole texts are what fills workers."""
    for name, most in BATCH.items():
        now = int(re.sub(r"\D", "", spark.conf.get(name)) or 0)
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where the session names none (tests)."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not given:
        if not sc.master.startswith("local") or sc.master.startswith("local-"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomtext-"))
        given = sc.getCheckpointDir()
    return given


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there and survives lost executors. The write's shuffle files go with it."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{scratch_root(spark)}/loomtext-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a scratch table that no later result reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loomtext-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df lacks, for work columns beside whatever extra columns df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, k = f"_{stem}", 0
        while name.lower() in taken:
            name, k = f"_{stem}{(k := k + 1)}", k
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets (nulls: empty), without a copy where there are no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_bytes[off[0] : off[-1]], off - off[0]


def passes(off: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts that hold about limit bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
