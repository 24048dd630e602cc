"""Dataset: a spec and a lazy table. Operations give new datasets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modalith.operators import metadata, tables, transforms, validate
from modalith.operators.extract import Extractor, NativeExtractor, RowFunction, apply, apply_native, apply_rows
from modalith.sources import media, readers, writers
from modalith.sources.spec import FOLDERS, SHARDS, DatasetSpec


@dataclass(frozen=True)
class Dataset:
    df: DataFrame
    spec: DatasetSpec

    @classmethod
    def read(cls, spark: SparkSession, spec: DatasetSpec, validate_columns: bool = True) -> Dataset:
        return cls(readers.read(spark, spec, validate_columns), spec)

    @classmethod
    def of(cls, df: DataFrame, spec: DatasetSpec) -> Dataset:
        """A table that is here already; its columns have canonical names."""
        return cls(df, spec)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def modalities(self) -> list[str]:
        return self.spec.modalities

    def __getitem__(self, column: str) -> Column:
        return self.df[column]

    def count(self) -> int:
        return self.df.count()

    def with_df(self, df: DataFrame) -> Dataset:
        return replace(self, df=df)

    def with_column(self, name: str, value: Column) -> Dataset:
        return self.with_df(self.df.withColumn(name, value))

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> Dataset:
        return self.with_df(f(self.df))

    def where(self, condition: Column | str) -> Dataset:
        """Rows where it is true; a null condition is not."""
        return self.with_df(self.df.where(condition))

    def extract(self, what: Extractor | NativeExtractor | RowFunction, on_error: str = "raise", validate: bool = True, **more: Any) -> Dataset:
        if isinstance(what, RowFunction):
            return self.with_df(apply_rows(self.df, what))
        if isinstance(what, NativeExtractor):
            return self.with_df(apply_native(self.df, what))
        return self.with_df(apply(self.df, self.spec, what, on_error, validate, **more))

    def keep_first(self, columns: list[str], order: list[Column] | None = None) -> Dataset:
        """Order: by default that of the tables."""
        if order:
            return self.with_df(tables.keep_first(self.df, columns, order))
        by = readers.shard_order(F.col("split_name")) if "split_name" in self.columns else []
        return self.with_df(tables.keep_first(readers.with_row_id(self.df, *by), columns).drop(readers.ROW_ID))

    def shuffled(self, seed: int | None = None) -> Dataset:
        return self.with_df(tables.shuffled(self.df, seed).drop(readers.ROW_ID))

    def sample(self, where: str | None = None, seed: int | None = None) -> tuple[dict[str, Any], dict[str, Any]]:
        return media.random_sample(self.df, self.spec, where, seed)

    def with_bytes(self, modality: str, column: str, on_error: str = "raise") -> Dataset:
        return self.with_df(media.with_bytes(self.df, self.spec, modality, column, on_error))

    def resize_images(self, resizer: transforms.Resizer, folder: str, **more: Any) -> Dataset:
        return self.with_df(transforms.resize_images(self.df, self.spec, resizer, folder, **more))

    def transform_videos(self, transform: transforms.VideoTransform, folder: str, **more: Any) -> Dataset:
        return self.with_df(transform.apply(self.df, self.spec, folder, **more))

    def validate(self, check: list[str] | None = None, structure: bool = True, metadata: bool = True, extras: bool = False) -> validate.Report:
        return validate.validate(self.spark, self.df, self.spec, check, structure, metadata, extras)

    def write_shards(self, folder: str, **more: Any) -> Dataset:
        return Dataset.read(self.spark, writers.write(self.df, self.spec, folder, SHARDS, **more))

    def write_folders(self, folder: str, **more: Any) -> Dataset:
        return Dataset.read(self.spark, writers.write(self.df, self.spec, folder, FOLDERS, **more))

    def rename_columns(self, names: dict[str, str]) -> list[str]:
        """In the tables on disk; read the dataset again to see it."""
        return metadata.rename_columns(self.spark, self.spec, names)

    def delete_columns(self, names: list[str]) -> list[str]:
        return metadata.delete_columns(self.spark, self.spec, names)

    def update_columns(self, names: list[str]) -> list[str]:
        return metadata.update_columns(self.spark, self.spec, self.df, names)

    def summary(self) -> dict[str, Any]:
        """Layout, path, modalities, columns, rows, and statistics of width, height and their ratio if they are there."""
        out: dict[str, Any] = {"layout": self.spec.layout, "path": self.spec.path, "modalities": self.modalities, "columns": len(self.columns), "rows": self.count()}
        width = next((c for c in ("width", "WIDTH", "w") if c in self.columns), None)
        height = next((c for c in ("height", "HEIGHT", "h") if c in self.columns), None)
        if width and height:
            some = self.df.select(F.col(width).alias("width"), F.col(height).alias("height"), (F.col(width) / F.col(height)).alias("aspect_ratio"))
            out["sizes"] = {r["column"]: r.asDict() for r in tables.describe(some, ["width", "height", "aspect_ratio"]).collect()}
        return out


