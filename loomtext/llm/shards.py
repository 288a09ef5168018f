"""Shuffled sharding in two passes over data that no memory holds.

First pass: every record goes to one of many memory-sized buckets by a seeded hash. Second pass: each
bucket is brought into a fixed order, shuffled by Fisher-Yates with its own seed and written. The law is
`key`: document id and number of shards decide the shard, and one more shard takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, discard, fresh, materialize

SHARDS = 24
SEED = 20_240
#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 16 << 20


def shard_of(key: Column, n: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash of the key is highest (rendezvous hashing): shard n+1 only takes from others."""
    draws = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(k)).alias("h"), F.lit(k).alias("k")) for k in range(n)]
    return F.greatest(*draws)["k"] if n > 1 else F.lit(0)


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of n by Fisher-Yates: from the end on, each place swaps with a uniformly drawn one up to itself."""
    order = list(range(n))
    draws = np.random.Generator(np.random.PCG64(seed & (2**63 - 1))).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def scatter(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs, shuffled, with struct `place`: size, text_crc32, shard, bucket, at (place in the bucket).

    Null keys are one key. Rows with equal key and text are interchangeable, so any order among them is the same
    result. Extra columns are carried along. A bucket holds rows of one shard; big shards have many buckets, and
    rows of one key spread over its shard's buckets by their text, so no key fills a bucket alone. A bucket is one task's: its
    number is the partition's. Null texts have size 8 and checksum 0. An empty table gives no rows.
    """
    place, order = fresh(docs, "place", "order")
    size = F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long") + 8
    total = docs.agg(F.sum(size)).first()[0] or 0
    per_shard = max(1, round(total / shards / bucket_bytes))
    sub = F.pmod(F.xxhash64(F.lit(seed + 1), col(key), col(text)), F.lit(per_shard)).cast("int")
    crc = F.coalesce(F.crc32(col(text).cast("binary")), F.lit(0)).cast("long")
    placed = docs.withColumn(
        place,
        F.struct(size.alias("size"), crc.alias("text_crc32"), shard_of(col(key), shards, seed).cast("int").alias("shard"), shard_of(col(key), shards + 1, seed).cast("int").alias("grown_shard"), sub.alias("sub")),
    )
    bucket = F.col(f"{place}.shard") * per_shard + F.col(f"{place}.sub")
    whole = placed.withColumn(order, bucket).repartitionById(shards * per_shard, F.col(order)).sortWithinPartitions(F.col(order), col(key), F.col(f"{place}.text_crc32"), F.col(f"{place}.size"), col(text))
    out = T.StructType([*docs.schema.fields, T.StructField("size", T.LongType()), T.StructField("text_crc32", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("at", T.LongType())])
    names = [f.name for f in out]
    n_docs = len(docs.columns)

    def shuffled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        number = table.column(order)[0].as_py()
        table = table.take(pa.array(fisher_yates(len(table), (seed << 32) ^ number)))
        p = table.column(place).combine_chunks()
        p = p.chunk(0) if isinstance(p, pa.ChunkedArray) else p
        columns = [*table.columns[:n_docs], *(p.field(x) for x in ("size", "text_crc32", "shard", "grown_shard")), table.column(order), pa.array(np.arange(len(table)))]
        yield from pa.Table.from_arrays(columns, names=names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            b = batch.column(batch.schema.get_field_index(order)).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for i, j in zip(edges, edges[1:]):
                if held and held[-1].column(held[-1].schema.get_field_index(order))[-1].as_py() != b[i]:
                    yield from shuffled(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield from shuffled(pa.Table.from_batches(held))

    # the struct is the last but one column, the bucket's number the last
    return whole.mapInArrow(run, out)


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write shuffled shards as Parquet under path/shard=N, a file for each bucket, and read them back (columns in scatter's order)."""
    out = scatter(docs, **options)
    out.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path).select(*map(col, out.columns))


def slots(scattered: DataFrame) -> DataFrame:
    """scattered with `slot`, gapless in each shard from 0: places before the bucket plus the place in it.

    Only the buckets' counts are summed up (a row for each bucket); a bucket's number orders it within its shard.
    """
    counts = scattered.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("bucket", before.alias("before"))
    return scattered.join(starts, "bucket").withColumn("slot", F.col("before") + F.col("at")).drop("before")


__all__ = ["BUCKET_BYTES", "SEED", "SHARDS", "discard", "fisher_yates", "materialize", "scatter", "shard_of", "slots", "write_shards"]
