"""Readers: a DatasetSpec becomes a lazy DataFrame with canonical columns first.

Rows carry no order in Spark. Where order counts (keep-first dedup, shard numbers), `_row_id` does: it follows the shard's number,
then the place in its table.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalith.sources.spec import FILES, MODALITIES, SHARDED, SHARDS, DatasetSpec
from modalith.sources.storage import Storage, adopt, join, open_bytes, openers, scheme, stem, table_format

ROW_ID = "_row_id"


def read_table(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header, or Parquet, by extension. Without a schema CSV columns are inferred; an empty field is null."""
    first = path if isinstance(path, str) else path[0]
    if table_format(first) == "parquet":
        return spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one table, from its first line or footer."""
    if table_format(path) == "parquet":
        return spark.read.parquet(path).columns
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns


def headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Column names of many tables of one format. The first lines of all CSV tables, or the footers of all Parquet ones, are read by one
    job, a task for some tables, and only these come to the driver."""
    if len(paths) < 2 or any(scheme(p) not in ("", "file") and scheme(p) not in openers() for p in paths):
        return {p: header(spark, p) for p in paths}
    found = openers()

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adopt(found)
        for batch in batches:
            names = []
            for path in batch["path"]:
                with open_bytes(path) as f:
                    if table_format(path) == "parquet":
                        names.append(pq.read_schema(f).names)
                    else:
                        names.append(next(csv.reader(io.TextIOWrapper(f, encoding="utf-8", newline="")), []))
            yield pd.DataFrame({"path": batch["path"], "names": names})

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 256)).mapInPandas(first, "path string, names array<string>").collect()
    return {r["path"]: list(r["names"]) for r in rows}


def shard_order(split: Column) -> list[Column]:
    """Numbers in order of size, then other names by letter."""
    return [F.coalesce(F.regexp_extract(split, r"^(\d{1,18})$", 1).try_cast("long"), F.lit(1 << 62)), split]


def with_row_id(df: DataFrame, *order: Column) -> DataFrame:
    """df with _row_id, which grows with order and then with the place in the scan. Only rows' places relative to each other count:
    ids have gaps."""
    place = F.monotonically_increasing_id()
    return df.withColumn(ROW_ID, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), place.alias("place")) if order else place)


def _canonical(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    lacking = [c for c in spec.required if c not in df.columns]
    if lacking:
        raise ValueError(f"the table lacks {lacking}; it has {df.columns}")
    return df.withColumnsRenamed(spec.renames)


def _arranged(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    first = [s.final for s in spec.stored]
    return df.select(*first, *(c for c in df.columns if c not in first))


def read_files(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """One table; its paths get the table's folder before them."""
    df = _canonical(read_table(spark, spec.path), spec)
    folder = spec.path.rpartition("/")[0]
    if folder:
        df = df.withColumns({c: F.concat(F.lit(folder + "/"), F.col(c)) for c in spec.path_columns})
    return _arranged(df, spec)


def shard_tables(spark: SparkSession, spec: DatasetSpec) -> list[str]:
    """Paths of the tables. Every table needs its archive or folder, and every archive its table."""
    names = Storage(spark).names(spec.path)
    tables = sorted((n for n in names if n.endswith(f".{spec.table_ext}")), key=lambda n: (not stem(n).isdigit(), int(stem(n)) if stem(n).isdigit() else 0, n))
    if not tables:
        raise FileNotFoundError(f"no .{spec.table_ext} in {spec.path}")
    have = set(names)
    suffix = f".{spec.archive_ext}" if spec.layout == SHARDS else ""
    absent = [n for n in tables if n[: -len(spec.table_ext) - 1] + suffix not in have]
    if absent:
        raise FileNotFoundError(f"tables without their files: {absent}")
    if spec.layout == SHARDS:
        alone = [n for n in names if n.endswith(suffix) and f"{n[: -len(suffix)]}.{spec.table_ext}" not in have]
        if alone:
            raise FileNotFoundError(f"archives without their table: {alone}")
    return [join(spec.path, n) for n in tables]


def read_sharded(spark: SparkSession, spec: DatasetSpec, validate_columns: bool = True) -> DataFrame:
    """All tables of a folder as one, with split_name second. With validate_columns all must have the same columns; else what a table
    lacks is null.

    Tables with the same columns are one scan, however many there are.
    """
    tables = shard_tables(spark, spec)
    heads: dict[tuple[str, ...], list[str]] = {}
    by_table = headers(spark, tables)
    for t in tables:
        heads.setdefault(tuple(by_table[t]), []).append(t)
    if validate_columns and len({frozenset(h) for h in heads}) > 1:
        raise ValueError(f"tables differ in their columns: {[sorted(h) for h in heads]}")
    parts = []
    for paths in heads.values():
        df = _canonical(read_table(spark, paths), spec)
        parts.append(df.withColumn("split_name", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    suffix = f".{spec.archive_ext}/" if spec.layout == SHARDS else "/"
    paths = {MODALITIES[s.modality].path: F.concat(F.lit(spec.path + "/"), "split_name", F.lit(suffix), F.col(s.canonical)) for s in spec.stored if s.how == SHARDED}
    df = df.withColumns(paths).drop(*(s.canonical for s in spec.stored if s.how == SHARDED))
    first = [s.final for s in spec.stored]
    return df.select(*first, "split_name", *(c for c in df.columns if c not in (*first, "split_name")))


def read(spark: SparkSession, spec: DatasetSpec, validate_columns: bool = True) -> DataFrame:
    return read_files(spark, spec) if spec.layout == FILES else read_sharded(spark, spec, validate_columns)
