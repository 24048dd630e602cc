"""Two-pass external shuffle.

The first pass scatters the rows over buckets by a seeded hash of the whole row, uniformly and so that a bucket fits into memory. The
second puts each bucket into a fixed order, shuffles it by Fisher and Yates with a seed of its own, and writes it: bucket by bucket,
the result is a random order of all rows, the same whenever a lost task runs again.

Rows that are equal in all columns have one hash. Where so many are that they would fill more than an eighth of a bucket, they are
written first and scattered by their place in what was written. A task gets one bucket; if there are more buckets than tasks should
be, it gets several and sorts its rows by bucket, on disk if need be, so that it still holds one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalith.llm.common import checkpointed, row_bytes, sized


@dataclass(frozen=True)
class ShardParams:
    """bucket_bytes: that a bucket should have on average; a task holds it about four times. tasks: at most, of the second pass."""

    seed: int = 7
    bucket_bytes: int = 32 << 20
    tasks: int = 16_384


def fisher_yates(n: int, seed: int | list[int]) -> np.ndarray:
    """A permutation of n, from the last place down: each place is swapped with one at or below it."""
    order, rng = list(range(n)), np.random.default_rng(seed)
    swaps = rng.integers(0, np.arange(n, 0, -1)) if n else ()
    for i, j in zip(range(n - 1, 0, -1), swaps):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _hashable(t: T.DataType) -> bool:
    """Whether no map or variant is in it; Spark has no hash of these."""
    if isinstance(t, T.StructType):
        return all(_hashable(f.dataType) for f in t)
    return _hashable(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, T.MapType | T.VariantType)


def shuffled(docs: DataFrame, p: ShardParams = ShardParams()) -> DataFrame:
    """docs with shard (int) and position (long), its place in the shard; columns of these names in docs are replaced.

    Every row is there as often as in docs, whatever its nulls and texts. The number of shards follows the bytes, of arrays and structs
    too. Rows that are equal in every column are interchangeable. An empty table gives an empty table. Columns with maps or variants in
    them take no part in the hash. A single row larger than a bucket is a bucket by itself or with others.
    """
    docs = docs.drop("shard", "position")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # a grouped map can't take names with dots
    hashed = [F.col(f.name) for f in plain.schema if _hashable(f.dataType)] or [F.lit(0)]
    keyed = plain.withColumn("key", F.xxhash64(*hashed, F.lit(p.seed)))
    each = plain.select(F.xxhash64(*hashed, F.lit(p.seed)).alias("key"), row_bytes(plain).alias("b")).groupBy("key").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    # a row for each hot key and one for all others
    facts = checkpointed(each.groupBy(F.when((F.col("n") > 1) & (F.col("b") * 8 > p.bucket_bytes), F.col("key")).alias("key")).agg(F.sum("b").alias("b")))
    shards = max(1, -(-(facts.agg(F.sum("b")).first()[0] or 0) // p.bucket_bytes))
    hot = facts.where("key is not null").select("key")
    of = lambda *salt: F.pmod(F.xxhash64("key", *salt, F.lit(p.seed + 1)), F.lit(shards)).cast("int")
    if shards == 1 or hot.isEmpty():
        scattered = keyed.withColumn("shard", of())
    else:
        copies = checkpointed(keyed.join(sized(hot), "key", "left_semi"))
        scattered = keyed.join(sized(hot), "key", "left_anti").withColumn("shard", of()).unionByName(copies.withColumn("shard", of(F.monotonically_increasing_id())))
    out = T.StructType([*plain.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("position", T.LongType())])
    columns = out.fieldNames()[:-1]

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def bucket() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            held.clear()
            order = pc.sort_indices(whole, [("key", "ascending")])
            mixed = order.take(pa.array(fisher_yates(len(whole), [p.seed, whole["shard"][0].as_py()])))
            done = whole.select(columns).take(mixed).append_column("position", pa.array(np.arange(len(whole))))
            yield from done.to_batches(max_chunksize=4096)

        for batch in batches:
            if not len(batch):
                continue
            of = batch["shard"].to_numpy()
            ends = [*(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip([0, *ends], ends):
                if held and held[0]["shard"][0].as_py() != of[a]:
                    yield from bucket()
                held.append(batch.slice(a, b - a))
        if held:
            yield from bucket()

    # one task for each bucket, and nothing sorted on the way, or neighbouring buckets together
    together = -(-shards // p.tasks)
    parted = scattered.repartitionById(-(-shards // together), F.floor(F.col("shard") / together).cast("int"))
    if together > 1:
        parted = parted.sortWithinPartitions("shard")
    return parted.mapInArrow(shuffle, out).toDF(*names, "shard", "position")


def write_shards(docs: DataFrame, path: str, p: ShardParams = ShardParams()) -> None:
    """shuffled(docs) as Parquet: a folder shard=N with one file for each shard, whose rows are in order of position."""
    # the second pass leaves each shard in one task, so this sorts but doesn't shuffle
    shuffled(docs, p).sortWithinPartitions("shard", "position").write.partitionBy("shard").parquet(path)
