"""The bytes behind a table's paths, read where they are needed."""

from __future__ import annotations

import os
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalith.sources.spec import SHARDS, DatasetSpec
from modalith.sources.storage import adopt, open_tar, openers, read_bytes


class Fetcher:
    """Bytes by path. A path through an archive (.../3.tar/name) is that member, found by base name; the last archive stays open."""

    def __init__(self, archive_ext: str | None, found: dict | None = None) -> None:
        """found: the openers of the driver, in a task."""
        adopt(found or {})
        self.mark = f".{archive_ext}/" if archive_ext else None
        self.archive: str | None = None
        self.tar: tarfile.TarFile | None = None
        self.members: dict[str, tarfile.TarInfo] = {}

    def __call__(self, path: str) -> bytes:
        if not self.mark or self.mark not in path:
            return read_bytes(path)
        head, _, member = path.rpartition(self.mark)
        archive = head + self.mark[:-1]
        if archive != self.archive:
            self.close()
            self.tar, self.archive = open_tar(archive), archive
            self.members = {os.path.basename(m.name): m for m in self.tar.getmembers() if m.isfile()}
        if member not in self.members:
            raise KeyError(f"{archive} has no member {member}")
        return self.tar.extractfile(self.members[member]).read()

    def close(self) -> None:
        if self.tar:
            self.tar.close()
        self.tar = self.archive = None


def by_archive(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """df so that rows of one archive are in one task and follow each other: it is then opened once."""
    if spec.layout != SHARDS:
        return df
    together = df.repartition("split_name")
    return together if df.isStreaming else together.sortWithinPartitions("split_name")


def with_bytes(df: DataFrame, spec: DatasetSpec, modality: str, column: str, on_error: str = "raise") -> DataFrame:
    """df with a column of the modality's bytes. on_error: raise, or null for what can't be read."""
    path = spec[modality].final
    ext, found = spec.archive_ext if spec.layout == SHARDS else None, openers()

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = Fetcher(ext, found)
        for batch in batches:
            for at in range(0, len(batch), 64):  # few blobs at a time
                some = batch.iloc[at : at + 64].copy()
                out = []
                for p in some[path]:
                    try:
                        out.append(get(p))
                    except (OSError, KeyError, tarfile.TarError):
                        if on_error == "raise":
                            raise
                        out.append(None)
                some[column] = pd.Series(out, index=some.index, dtype=object)
                yield some
        get.close()

    schema = T.StructType([*(f for f in df.schema if f.name != column), T.StructField(column, T.BinaryType())])
    return by_archive(df.drop(column), spec).mapInPandas(fetch, schema)


def archive_members(df_archives: DataFrame) -> DataFrame:
    """(archive, member, bytes) of every file in the archives of a column path."""
    found = openers()

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adopt(found)
        for batch in batches:
            for path in batch["path"]:
                with open_tar(path) as tar:
                    for m in tar:
                        if m.isfile():
                            yield pd.DataFrame({"archive": [path], "member": [m.name], "bytes": [m.size]})

    return df_archives.select("path").mapInPandas(expand, "archive string, member string, bytes long")


def random_sample(df: DataFrame, spec: DatasetSpec, where: str | None = None, seed: int | None = None) -> tuple[dict[str, bytes | str], dict]:
    """({modality: bytes or text}, row) of one row, drawn at random from those that satisfy where."""
    some = df.where(where) if where else df
    row = some.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(1).collect()
    if not row:
        raise LookupError("no row to draw")
    get = Fetcher(spec.archive_ext if spec.layout == SHARDS else None)
    found = row[0].asDict()
    return {m: get(found[c]) if c in spec.path_columns else found[c] for c, m in spec.final_columns.items()}, found
