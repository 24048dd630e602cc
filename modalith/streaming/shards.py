"""The same operators on shards that keep arriving. Beyond bounded datasets, which everything else here is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalith.operators.extract import Extractor, apply
from modalith.sources.spec import MODALITIES, SHARDED, SHARDS, DatasetSpec


def stream_tables(spark: SparkSession, spec: DatasetSpec, schema: T.StructType | str, per_trigger: int = 100) -> DataFrame:
    """Rows of tables as they come to the dataset's folder; an archive must be there before its table."""
    if spec.layout == "files":
        raise ValueError("one table is no stream")
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", f"*.{spec.table_ext}")
    df = raw.parquet(spec.path) if spec.table_ext == "parquet" else raw.option("header", True).option("multiLine", True).option("escape", '"').csv(spec.path)
    df = df.withColumn("split_name", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)).withColumnsRenamed(spec.renames)
    suffix = f".{spec.archive_ext}/" if spec.layout == SHARDS else "/"
    for s in spec.stored:
        if s.how == SHARDED:
            df = df.withColumn(MODALITIES[s.modality].path, F.concat(F.lit(spec.path + "/"), "split_name", F.lit(suffix), F.col(s.canonical))).drop(s.canonical)
    return df


def stream_extract(df: DataFrame, spec: DatasetSpec, extractor: Extractor, on_error: str = "null") -> DataFrame:
    """Extraction as rows arrive: stateless, so archives of a batch are brought together by a shuffle only."""
    return apply(df, spec, extractor, on_error, validate=False)


def deduplicate_within(df: DataFrame, columns: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each combination of values within the delay; older state is forgotten."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(columns)


def counts_per_window(df: DataFrame, time: str, key: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """(start, key, rows): arrivals by window and key, each window once, when the watermark has passed it."""
    grouped = df.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), key)
    return grouped.agg(F.count("*").alias("rows")).select(F.col("w.start").alias("start"), key, "rows")
