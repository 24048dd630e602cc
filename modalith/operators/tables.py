"""Relational operators over metadata tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modalith.sources.readers import ROW_ID

#: Bytes that the optimiser may think a side has for it to be sent to all tasks by hint.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the optimiser's estimate of its size is within the limit."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def keep_first(df: DataFrame, columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row for each combination of values, nulls being equal: the first in order, by default that of _row_id.

    Written as an aggregation rather than a window: partial results meet in the shuffle, so a value with very many rows costs no task
    more than others.
    """
    by = order or [F.col(ROW_ID)]
    rest = [c for c in df.columns if c not in columns]
    best = F.min_by(F.struct(*rest), F.struct(*by)) if rest else F.first(F.lit(1))
    out = df.groupBy(*columns).agg(best.alias("_first"))
    return out.select(*(F.col(c) if c in columns else F.col(f"_first.{c}").alias(c) for c in df.columns))


def is_repeat(df: DataFrame, columns: list[str], order: list[Column], name: str = "is_repeat") -> DataFrame:
    """df with a flag on every row but the first of its values."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*columns).orderBy(*order)) > 1)


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    """(value, copies) of values that several rows have; null counts as a value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("copies")).where("copies > 1")


def has_repeats(df: DataFrame, column: str) -> bool:
    return not repeated_values(df, column).isEmpty()


def merge_back(df: DataFrame, results: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """df with the columns of results, by key, nulls matching nulls; columns that both have are taken from results. strict: keys of
    results must be unique, else rows would multiply."""
    if strict and has_repeats(results, key):
        raise ValueError(f"results have repeated values of {key}")
    new = [c for c in results.columns if c != key]
    right = results.withColumnRenamed(key, "_key")
    return df.drop(*new).join(right, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def update_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the columns of new: those it has are replaced, the others added. Rows without a partner are left out."""
    for name, df in (("table", old), ("update", new)):
        if has_repeats(df, key):
            raise ValueError(f"the {name} has repeated values of {key}")
    overlap = [c for c in new.columns if c in old.columns and c != key]
    return old.drop(*overlap).join(new, key, "inner")


def missing_from(left: DataFrame, right: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows of left whose key right hasn't."""
    names = right.select(F.col(other or key).alias("_other")).distinct()
    return left.join(names, F.col(key) == F.col("_other"), "left_anti")


def pairing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that one side alone has."""
    a = left.select(F.col(key).alias("a")).distinct()
    b = right.select(F.col(key).alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full")
    return both.where("a is null or b is null").select(F.coalesce("a", "b").alias(key), F.when(F.col("b").isNull(), "left").otherwise("right").alias("side"))


def describe(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max): sample deviation, quartiles between neighbours, in one pass over df."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
                F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(v).alias("max"),
            )
        )
    rows = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    r = lambda c: F.round(c, digits)
    return rows.select("column", "count", r("mean").alias("mean"), r("std").alias("std"), r("min").alias("min"), *(r(F.col("q")[i]).alias(n) for i, n in enumerate(("p25", "p50", "p75"))), r("max").alias("max"))


def shuffled(df: DataFrame, seed: int | None = None, key: list[str] | None = None) -> DataFrame:
    """df in a random order, of which _row_id is the new one. With a seed the order is that of a digest of the seed and the key columns,
    by default all of them, and repeats however the rows are partitioned."""
    if seed is None:
        order = F.rand()
    else:
        values = [F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("")) for c in key or [c for c in df.columns if c != ROW_ID]]
        order = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *values))
    return df.drop(ROW_ID).withColumn(ROW_ID, order).orderBy(ROW_ID)


def persisted(df: DataFrame) -> DataFrame:
    """df, computed once and written to the folder in spark.checkpoint.dir, from which lost parts are read again. Only where the session
    names none and runs on this machine alone, as in tests, a folder is made here."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="modalith-"))
    return df.checkpoint(eager=True)


def dense_index(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """df with 0, 1, 2, ... in order. Rows are sorted into ranges, counted there, and numbered from where the ranges before end: no
    task sees more than its range.

    The ranges come from a sample, so the sorted rows are written before they are counted: counted and numbered apart, they could fall
    into ranges of two different samples.
    """
    part, place = "_part", "_place"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = persisted(ranged.withColumn(place, F.monotonically_increasing_id()))
    numbered = numbered.withColumn(part, F.shiftright(F.col(place), 33)).withColumn(place, F.col(place).bitwiseAND((1 << 33) - 1))
    # one row for each partition
    sizes = numbered.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(part), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return numbered.join(F.broadcast(starts), part).withColumn(name, F.col("_start") + F.col(place)).drop(part, place, "_start")


def even_split(df: DataFrame, parts: int, order: list[Column], name: str = "part") -> DataFrame:
    """df with the number of its part: contiguous, the first ones larger by one if they can't be equal."""
    n = df.count()
    base, more = divmod(n, parts)
    i = F.col("_index")
    out = dense_index(df, order, "_index")
    edge = more * (base + 1)
    after = F.floor((i - edge) / max(base, 1)) + more
    return out.withColumn(name, F.when(i < edge, F.floor(i / (base + 1))).otherwise(after).cast("int")).drop("_index")


def rank_slice(df: DataFrame, rank: int, world: int, order: list[Column]) -> DataFrame:
    """The rank-th of world slices of n // world + 1 rows each; the last is shorter."""
    size = df.count() // world + 1
    return dense_index(df, order, "_index").where(F.col("_index").between(rank * size, (rank + 1) * size - 1)).drop("_index")


def collect_by(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, rows): an array of structs for each key."""
    return df.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("rows"))
