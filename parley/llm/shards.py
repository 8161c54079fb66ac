"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets small enough for a task's memory, by a seeded
hash of the whole record key with its place in its file, so equal texts and repeated ids spread too. Pass
two reads bucket by bucket, numbers its records, puts the numbers into a Fisher-Yates order and writes the
records sorted by it. Texts stay in Spark's own rows, which its sorts spill; Python sees numbers only. Buckets one
after another are the global order; record i of it goes to shard i mod n at slot i div n, so shard
sizes differ by one record at most ("rows" law) and slots have no gaps. Only the buckets' counts
(one row a bucket) pass through the driver.

NULL texts have no bytes, empty tables give empty shards. The order depends on seed and files, not
on splits or timing: a repeated task gives the same records. Tables that are no file scan are written
with their row numbers first.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from parley.llm.common import RID, placed, scratch_path, ship_package

SHARDS = 16
BUCKET_BYTES = 16 << 20
SEED = 20
BUCKET, PLACE, SHARD, SLOT = "__llm_bucket", "__llm_place", "shard", "slot"


def _schema(docs: DataFrame) -> StructType:
    return StructType([*docs.schema.fields, StructField(SHARD, IntegerType()), StructField(SLOT, LongType())])


def _fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64([seed, bucket]))
    order = np.arange(n)
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else ()):
        order[i], order[j] = order[j], order[i]
    return order


def _places(bucket: np.ndarray, number: np.ndarray, first: dict[int, tuple[int, int]], seed: int) -> np.ndarray:
    """Place in the global order of the records numbered (from 1) in their buckets; `first`: a bucket's first place and size."""
    out = np.empty(len(bucket), np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, z in zip([0, *cuts], [*cuts, len(bucket)]):
        if z > a:
            at, n = first[b := int(bucket[a])]
            out[a:z] = at + _place_in(n, seed, b)[number[a:z] - 1]
    return out


@lru_cache(maxsize=1)
def _place_in(n: int, seed: int, bucket: int) -> np.ndarray:
    """Place of each record in its bucket's order; records come bucket by bucket."""
    place = np.empty(n, np.int64)
    place[_fisher_yates(n, seed, bucket)] = np.arange(n)
    return place


def _placed(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    if clash := {BUCKET, PLACE, SHARD, SLOT} & set(docs.columns):
        raise ValueError(f"rename the columns {sorted(clash)} first")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    rows = placed(docs)
    total = rows.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows = rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.lit(seed), id_col, RID), F.lit(buckets)))
    counts = {r[0]: r[1] for r in rows.groupBy(BUCKET).count().collect()}  # total / bucket_bytes rows
    first, at = {}, 0
    for b in range(buckets):
        first[b] = at, counts.get(b, 0)
        at += counts.get(b, 0)
    first = spark.sparkContext.broadcast(first)

    @F.arrow_udf("long")
    def place_of(bucket: pa.Array, number: pa.Array) -> pa.Array:
        return pa.array(_places(bucket.to_numpy(), number.to_numpy(), first.value, seed))

    # the order in which records arrive does not matter; ids that are missing come last
    number = F.row_number().over(Window.partitionBy(BUCKET).orderBy(F.col(RID).asc(), F.col(id_col).asc_nulls_last()))
    rows = rows.withColumn(PLACE, place_of(BUCKET, number.cast("long")))
    return rows.select(*docs.columns, F.pmod(PLACE, F.lit(shards)).cast("int").alias(SHARD),
                       F.expr(f"{PLACE} div {shards}").alias(SLOT), BUCKET, PLACE)


def shuffled(docs: DataFrame, **options) -> DataFrame:
    """docs with two more columns, shard int and slot long, in shuffled order by bucket."""
    return _placed(docs, **options).sortWithinPartitions(BUCKET, PLACE).drop(BUCKET, PLACE)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder per shard, records of a bucket in slot order in one file."""
    rows = _placed(docs, **options).sortWithinPartitions(SHARD, SLOT).drop(BUCKET, PLACE)
    rows.write.partitionBy(SHARD).parquet(path)


def sharded(docs: DataFrame, **options) -> DataFrame:
    """The shards of docs, written to the shared folder and read back."""
    path = scratch_path(docs.sparkSession, "shards")
    write_shards(docs, path, **options)
    return docs.sparkSession.read.schema(_schema(docs)).parquet(path)
