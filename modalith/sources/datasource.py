"""`spark.read.format("tarshards")`: archives as rows (split_name, member, content), one task for each archive.

Options: path, the folder of archives; archive_ext, tar; splits, a comma between names, of the only archives to read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from modalith.sources.storage import local, open_tar


class _Archive(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str, ext: str, splits: str | None) -> None:
        self.folder, self.ext, self.only = local(folder), f".{ext}", set(splits.split(",")) if splits else None

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.folder) if n.endswith(self.ext))
        return [_Archive(os.path.join(self.folder, n)) for n in names if self.only is None or n.split(".", 1)[0] in self.only]

    def read(self, partition: _Archive | None) -> Iterator[tuple]:
        if partition is None:  # no archive at all
            return
        split = os.path.basename(partition.path).split(".", 1)[0]
        with open_tar(partition.path) as tar:
            for m in tar:
                if m.isfile():
                    yield split, m.name, tar.extractfile(m).read()


class TarShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarshards"

    def schema(self) -> str:
        return "split_name string, member string, content binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], self.options.get("archive_ext", "tar"), self.options.get("splits"))
