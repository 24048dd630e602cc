"""Changes of a dataset's tables on disk. All tables are checked before the first is written, and each is swapped in whole."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalith.functions.columns import base_name
from modalith.operators.tables import persisted, update_by_key
from modalith.sources.readers import headers, read_table, shard_tables
from modalith.sources.spec import COLUMN, FILES, SHARDED, DatasetSpec
from modalith.sources.storage import stem
from modalith.sources.writers import write_single_table

_LOG = logging.getLogger(__name__)


def _tables(spark: SparkSession, spec: DatasetSpec) -> list[str]:
    return [spec.path] if spec.layout == FILES else shard_tables(spark, spec)


def _alike(spark: SparkSession, paths: list[str], column: str) -> list[list[str]]:
    """The tables by their columns: those of one list are one scan."""
    out: dict[tuple[str, ...], list[str]] = {}
    for p, h in headers(spark, paths).items():
        if column not in h:
            raise KeyError(f"{p}: no column {column}")
        out.setdefault(tuple(h), []).append(p)
    return list(out.values())


def _rewrite(spark: SparkSession, paths: list[str], change: Callable[[str, DataFrame], DataFrame]) -> list[str]:
    """What went wrong, a line for each table that could not be written."""
    errors = []
    for path in paths:
        try:
            # all columns as text: what isn't changed is written as it was read
            df = read_table(spark, path) if path.endswith(".parquet") else spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
            write_single_table(change(path, df), path)
        except Exception as e:  # noqa: BLE001 - told to the caller
            _LOG.warning("%s could not be written: %s", path, e)
            errors.append(f"{path}: {e}")
    return errors


def rename_columns(spark: SparkSession, spec: DatasetSpec, names: dict[str, str]) -> list[str]:
    paths = _tables(spark, spec)
    for p, have in headers(spark, paths).items():
        lacking, clash = sorted(set(names) - set(have)), sorted(set(names.values()) & set(have) - set(names))
        if lacking or clash:
            raise KeyError(f"{p}: no column {lacking}" if lacking else f"{p}: there is already a column {clash}")
    return _rewrite(spark, paths, lambda _, df: df.withColumnsRenamed(names))


def delete_columns(spark: SparkSession, spec: DatasetSpec, columns: list[str]) -> list[str]:
    kept = sorted(set(columns) & set(spec.required))
    if kept:
        raise ValueError(f"{kept} hold the dataset's modalities")
    paths = _tables(spark, spec)
    for p, have in headers(spark, paths).items():
        lacking = sorted(set(columns) - set(have))
        if lacking:
            raise KeyError(f"{p}: no column {lacking}")
    return _rewrite(spark, paths, lambda _, df: df.drop(*columns))


def update_columns(spark: SparkSession, spec: DatasetSpec, df: DataFrame, columns: list[str]) -> list[str]:
    """Writes columns of df, a dataset as it was read, into the tables, by file name. In a sharded layout the rows of df for a table
    must be all of its rows; tables of which df has none stay as they are."""
    key = next(s for s in spec.stored if s.how != COLUMN)
    if spec.layout == FILES:
        folder = spec.path.rpartition("/")[0]
        name = F.substring(F.col(key.final), len(folder) + 2, 1 << 30) if folder else F.col(key.final)
        new = df.select(name.alias(key.user_column), *columns)
        return _rewrite(spark, [spec.path], lambda _, old: update_by_key(old, new, key.user_column))
    assert key.how == SHARDED
    new = df.select("split_name", base_name(F.col(key.final)).alias(key.user_column), *columns)
    touched = {r[0] for r in new.select("split_name").distinct().collect()}  # a name for each table
    paths = [p for p in _tables(spark, spec) if stem(p) in touched]
    # all tables at once: how often each name is in the update and in its table
    name = key.user_column
    mine = new.select("split_name", F.col(name).alias("name"), F.lit(1).alias("n"), F.lit(0).alias("o"))
    for some in _alike(spark, paths, name):
        theirs = read_table(spark, some).select(F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1).alias("split_name"), F.col(name).cast("string").alias("name"), F.lit(0).alias("n"), F.lit(1).alias("o"))
        mine = mine.unionByName(theirs)
    each = mine.groupBy("split_name", "name").agg(F.sum("n").alias("n"), F.sum("o").alias("o"))
    odd = each.where("n <> 1 or o <> 1").groupBy("split_name").agg(F.max(F.greatest("n", "o")).alias("most")).orderBy("split_name").first()
    if odd:
        raise ValueError(f"{odd['split_name']}: " + (f"repeated values of {name}" if odd["most"] > 1 else "the update has not the table's rows"))
    new = persisted(new.repartition("split_name"))
    return _rewrite(spark, paths, lambda p, old: update_by_key(old, new.where(F.col("split_name") == stem(p)).drop("split_name"), key.user_column))
