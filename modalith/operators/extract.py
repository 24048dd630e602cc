"""Feature extractors: functions that add columns and never remove rows.

An extractor says what it needs and what it adds, and turns a batch of samples into a batch of results. `apply` runs it inside one
Arrow stage that carries the row along, so results need no join to come home and repeated paths don't multiply rows. What an
extractor sets up, such as a model, is made once for each task.
"""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalith.operators.tables import persisted
from modalith.sources.media import Fetcher, by_archive
from modalith.sources.spec import COLUMN, SHARDS, DatasetSpec
from modalith.sources.storage import openers

_LOG = logging.getLogger(__name__)


class Extractor(ABC):
    """modalities: what of a sample it reads. metadata: columns it reads besides. outputs: DDL of the columns it adds."""

    modalities: tuple[str, ...] = ()
    metadata: tuple[str, ...] = ()
    outputs: str = ""
    batch_size: int = 64

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.outputs)

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema]

    def setup(self) -> Any:
        """What all batches of a task share."""
        return None

    def prepare(self, data: dict[str, bytes | str], row: dict[str, Any]) -> Any:
        """One sample, read. What it raises counts as an error of that row."""
        return data, row

    @abstractmethod
    def process(self, state: Any, batch: list[Any]) -> list[tuple]:
        """For each prepared sample the values of outputs. What it raises ends the job."""


class NativeExtractor(ABC):
    """An extractor of text or other columns that is an expression. outputs: DDL."""

    outputs: str = ""

    @property
    def columns(self) -> list[str]:
        return [f.name for f in T.StructType.fromDDL(self.outputs)]

    @abstractmethod
    def expressions(self) -> list:
        """A column for each output."""


class RowFunction(ABC):
    """A function of single rows. inputs: columns it reads; outputs: DDL."""

    inputs: tuple[str, ...] = ()
    outputs: str = ""

    @property
    def columns(self) -> list[str]:
        return [f.name for f in T.StructType.fromDDL(self.outputs)]

    @abstractmethod
    def row(self, values: dict[str, Any]) -> tuple:
        """The outputs' values."""


class ExtractionError(RuntimeError):
    pass


def gpu_profile(gpus: int = 1, cpus: int = 1) -> ResourceProfile:
    """A profile for apply: every task then has that many GPUs of its own, on whatever executors have them."""
    tasks = TaskResourceRequests().cpus(cpus).resource("gpu", gpus)
    executors = ExecutorResourceRequests().cores(cpus).resource("gpu", gpus)
    return ResourceProfileBuilder().require(tasks).require(executors).build


def apply(df: DataFrame, spec: DatasetSpec, extractor: Extractor, on_error: str = "raise", validate: bool = True, profile: ResourceProfile | None = None, tasks: int | None = None) -> DataFrame:
    """df with the extractor's columns; columns of these names are replaced.

    on_error "raise": a file that can't be read, or whose preparation fails, ends the job. "null": the row stays, its results are
    null. validate, with "null", checks at once that no row failed, and raises if one did.

    profile: resources of the tasks, as of gpu_profile; tasks: into how many the rows are split, where archives don't decide it.
    """
    if on_error not in ("raise", "null"):
        raise ValueError("on_error is raise or null")
    lacking = [m for m in extractor.modalities if m not in spec.modalities] + [c for c in extractor.metadata if c not in df.columns]
    if lacking:
        raise ValueError(f"{type(extractor).__name__} needs {lacking}")
    kept = df.drop(*extractor.columns)
    schema = T.StructType([*kept.schema, *extractor.schema, T.StructField("_ok", T.BooleanType())])
    sources = {m: (spec[m].final, spec[m].how == COLUMN) for m in extractor.modalities}
    ext = spec.archive_ext if spec.layout == SHARDS else None
    size, names, strict, found = extractor.batch_size, extractor.columns, on_error == "raise", openers()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, get = extractor.setup(), Fetcher(ext, found)
        for whole in batches:
            for at in range(0, len(whole), size):
                some = whole.iloc[at : at + size].reset_index(drop=True)
                ready, places = [], []
                for i, row in enumerate(some.to_dict("records")):
                    try:
                        data = {m: row[c] if inline else get(row[c]) for m, (c, inline) in sources.items()}
                        ready.append(extractor.prepare(data, row))
                        places.append(i)
                    except Exception as e:  # noqa: BLE001 - whatever a decoder raises
                        if strict:
                            raise
                        _LOG.warning("row skipped: %s", e)
                results: list[tuple | None] = [None] * len(some)
                for i, r in zip(places, extractor.process(state, ready) if ready else [], strict=True):
                    results[i] = r
                for k, name in enumerate(names):
                    some[name] = pd.Series([None if r is None else r[k] for r in results], dtype=object)
                some["_ok"] = [r is not None for r in results]
                yield some
        get.close()

    sharded = any(not inline for _, inline in sources.values())
    if tasks and not (sharded and spec.layout == SHARDS):
        kept = kept.repartition(tasks)
    out = (by_archive(kept, spec) if sharded else kept).mapInPandas(run, schema, profile=profile)
    if validate and not strict:
        out = persisted(out)  # the check and what comes after it share one run of the extractor
    if validate and not strict and not out.where(~F.col("_ok")).isEmpty():
        raise ExtractionError(f"{type(extractor).__name__} failed on some rows")
    return out.drop("_ok")


def apply_native(df: DataFrame, extractor: NativeExtractor) -> DataFrame:
    return df.withColumns(dict(zip(extractor.columns, extractor.expressions(), strict=True)))


def apply_rows(df: DataFrame, function: RowFunction) -> DataFrame:
    """df with the function's outputs; it runs on Arrow batches of the columns that it reads."""
    names = function.columns

    @F.pandas_udf(function.outputs)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([function.row(r) for r in batch.to_dict("records")], columns=names)

    made = df.withColumn("_made", run(F.struct(*function.inputs)))
    return made.withColumns({n: F.col(f"_made.{n}") for n in names}).drop("_made")


