"""Files of any Hadoop file system, from the driver and from tasks.

Tables are read by Spark. This is for listings, for single files and for the bytes that tables point to. Paths without a scheme are
those of the machine; tasks open others through fsspec-like openers that the caller registers with `register`.
"""

from __future__ import annotations

import io
import os
import tarfile
from collections.abc import Callable
from typing import BinaryIO

from pyspark.sql import SparkSession

#: scheme -> opener(path, mode) of this process. What goes to tasks takes them along, see `openers` and `adopt`.
_OPENERS: dict[str, Callable[[str, str], BinaryIO]] = {}


class UnknownTableFormat(ValueError):
    """A table is neither CSV nor Parquet."""


def scheme(path: str) -> str:
    head, sep, _ = path.partition("://")
    return head if sep else ""


def register(name: str, opener: Callable[[str, str], BinaryIO]) -> None:
    _OPENERS[name] = opener


def openers() -> dict[str, Callable[[str, str], BinaryIO]]:
    """Those registered so far, for what is pickled."""
    return dict(_OPENERS)


def adopt(found: dict[str, Callable[[str, str], BinaryIO]]) -> None:
    """In a task: the openers of the process that sent it."""
    _OPENERS.update(found)


def local(path: str) -> str:
    return path.removeprefix("file://")


def open_bytes(path: str, mode: str = "rb") -> BinaryIO:
    name = scheme(path)
    if name in ("", "file"):
        return open(local(path), mode)
    if name not in _OPENERS:
        raise FileNotFoundError(f"no opener is registered for {name}://, needed by {path}")
    return _OPENERS[name](path, mode)


def read_bytes(path: str) -> bytes:
    with open_bytes(path) as f:
        return f.read()


def open_tar(path: str) -> tarfile.TarFile:
    """The archive, read member by member from the file itself where that is possible."""
    return tarfile.open(local(path)) if scheme(path) in ("", "file") else tarfile.open(fileobj=io.BytesIO(read_bytes(path)))


def join(base: str, *parts: str) -> str:
    """One / between the parts, none at the end."""
    return "/".join([base.rstrip("/"), *(p.strip("/") for p in parts if p.strip("/"))])


def table_format(path: str) -> str:
    for ext in ("csv", "parquet"):
        if path.endswith(f".{ext}"):
            return ext
    raise UnknownTableFormat(path)


class Storage:
    """The driver's side: the Hadoop file system of each path."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, path: str):  # noqa: ANN202
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted."""
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def mkdir(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def move(self, source: str, target: str) -> None:
        """Puts source in target's place."""
        fs, p = self._fs(source)
        _, q = self._fs(target)
        fs.delete(q, True)
        if not fs.rename(p, q):
            raise OSError(f"{source} can't be moved to {target}")

    def write(self, path: str, data: bytes) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()


def base_name(path: str) -> str:
    return os.path.basename(path)


def stem(path: str) -> str:
    """The name up to its first dot."""
    return base_name(path).split(".", 1)[0]


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; where it is unset and all runs on this machine, as in tests, here."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return join(root, f"{name}-{uuid.uuid4().hex}") if root else tempfile.mkdtemp(prefix=f"modalith-{name}-")
