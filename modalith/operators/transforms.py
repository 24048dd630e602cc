"""File transforms: new files from old ones, and the metadata that changes with them.

The sizes are column expressions; only pixels and streams need a tool. Tasks may run twice, so results go to a new folder, under a
name that depends on the source alone, and the path column then points there.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalith.functions import columns as X
from modalith.functions.images import decode, encode_png, resize
from modalith.sources.spec import SHARDS, DatasetSpec
from modalith.sources.storage import local, read_bytes


@dataclass(frozen=True)
class Resizer:
    mode: X.SizeMode
    size: int = 512
    fixed: tuple[int, int] = (512, 512)
    downscale_only: bool = True

    def column(self, width: Column, height: Column) -> Column:
        return X.new_size(width, height, self.mode, self.size, self.fixed, self.downscale_only)

    def new_size(self, w: int, h: int) -> tuple[int, int]:
        """The same rule for one image."""
        if self.mode is X.SizeMode.FIXED:
            return self.fixed
        small = self.mode is X.SizeMode.MIN_SIZE
        if self.downscale_only and (min if small else max)(w, h) < self.size:
            return w, h
        if h >= w if small else w >= h:
            return self.size, int(self.size * h / w)
        return int(self.size * w / h), self.size


def _guard(spec: DatasetSpec, modality: str) -> None:
    if modality not in spec.modalities:
        raise ValueError(f"the dataset has no {modality}")
    if spec.layout == SHARDS:
        raise ValueError("files in archives aren't transformed; write the dataset to folders first")


def _rewritten(df: DataFrame, column: str, folder: str, make: Callable[[bytes, dict], bytes | None], needed: list[str], suffix: str | None = None) -> DataFrame:
    """df whose path column leads to the new file where make gave one."""
    root = local(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(root, exist_ok=True)
        for batch in batches:
            out = []
            for row in batch[[column, *needed]].to_dict("records"):
                path = row[column]
                new = make(read_bytes(path), row)
                if new is not None:
                    target = os.path.join(root, sha256(path.encode()).hexdigest()[:32] + (suffix or os.path.splitext(path)[1]))
                    part = f"{target}.{uuid.uuid4().hex}"
                    with open(part, "wb") as f:
                        f.write(new)
                    os.replace(part, target)
                    path = target
                out.append(path)
            yield batch.assign(**{column: out})

    return df.mapInPandas(run, df.schema)


def resize_images(df: DataFrame, spec: DatasetSpec, resizer: Resizer, folder: str, encode: Callable | None = None, suffix: str = ".png") -> DataFrame:
    """df with images of the new size, where it is another; needs width and height and changes them. encode: RGB array -> bytes, PNG
    by default."""
    _guard(spec, "image")
    path, write = spec["image"].final, encode or encode_png

    def make(blob: bytes, row: dict) -> bytes | None:
        w, h = int(row["_new"]["width"]), int(row["_new"]["height"])
        return None if (w, h) == (row["width"], row["height"]) else write(resize(decode(blob), w, h))

    sized = df.withColumn("_new", resizer.column(F.col("width"), F.col("height")))
    done = _rewritten(sized, path, folder, make, ["width", "height", "_new"], suffix)
    return done.withColumns({"width": F.col("_new.width"), "height": F.col("_new.height")}).drop("_new")


def ffmpeg_installed() -> bool:
    return shutil.which("ffmpeg") is not None


@dataclass(frozen=True)
class VideoTransform:
    """Scaling, frame rate and cutting of videos in one ffmpeg run each."""

    resizer: Resizer | None = None
    fps: int | None = None
    fps_eps: float = 0.1
    cut_start: str | None = None
    cut_duration: str | None = None
    copy_stream: bool = False
    preset: str | None = None
    crf: int | None = None
    copy_audio: bool = True

    def __post_init__(self) -> None:
        if bool(self.cut_start) != bool(self.cut_duration):
            raise ValueError("cutting needs a start and a duration")
        if self.copy_stream and (self.fps or self.resizer):
            raise ValueError("streams can be copied only when cutting")
        if not (self.resizer or self.fps or self.cut_start):
            raise ValueError("nothing to do")

    @property
    def required(self) -> list[str]:
        return [*(["width", "height"] if self.resizer else []), *(["fps"] if self.fps else []), *([self.cut_start, self.cut_duration] if self.cut_start else [])]

    @property
    def changed(self) -> list[str]:
        return [c for c in self.required if c in ("width", "height", "fps")]

    def command(self, source: str, target: str, row: dict) -> list[str] | None:
        """Arguments, without a shell; None if the video stays as it is."""
        before: list[str] = []
        after: list[str] = []
        pictures: list[str] = []
        if self.resizer:
            size = self.resizer.new_size(row["width"], row["height"])
            if size != (row["width"], row["height"]):
                pictures.append("scale={}:{}".format(*(n + n % 2 for n in size)))
        if self.fps and not self.fps - self.fps_eps <= row["fps"] <= self.fps + self.fps_eps:
            pictures.append(f"fps={self.fps}")
        if self.cut_start and row[self.cut_start] is not None and not pd.isna(row[self.cut_start]):
            before += ["-ss", str(row[self.cut_start])]
            after += ["-t", str(row[self.cut_duration])]
            if self.copy_stream:
                after += ["-c", "copy", "-avoid_negative_ts", "1"]
        if pictures:
            after += ["-vf", ",".join(pictures)]
        if not after:
            return None
        quality = [*(["-preset", self.preset] if self.preset else []), *(["-crf", str(self.crf)] if self.crf else []), *(["-c:a", "copy"] if self.copy_audio else [])]
        return ["ffmpeg", "-hide_banner", *before, "-i", source, *after, *quality, target, "-y"]

    def metadata(self, df: DataFrame) -> DataFrame:
        """df with the sizes and rates that the new videos have."""
        new = {}
        if self.resizer:
            size, same = self.resizer.column(F.col("width"), F.col("height")), F.col("width").cast("int")
            moved = (size["width"] != same) | (size["height"] != F.col("height").cast("int"))
            new |= {c: F.when(moved, X.even(size[c])).otherwise(F.col(c)).cast("int") for c in ("width", "height")}
        if self.fps:
            new["fps"] = X.adjusted_fps(F.col("fps"), self.fps, self.fps_eps)
        return df.withColumns(new)

    def apply(self, df: DataFrame, spec: DatasetSpec, folder: str, run: Callable[[list[str]], None] | None = None) -> DataFrame:
        """run: what executes a command; ffmpeg on the executors by default."""
        _guard(spec, "video")
        if run is None and not ffmpeg_installed():
            raise RuntimeError("ffmpeg is not installed")
        path, root = spec["video"].final, local(folder)
        execute = run or (lambda c: subprocess.run(c, capture_output=True, check=True))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            os.makedirs(root, exist_ok=True)
            for batch in batches:
                out = []
                for row in batch.to_dict("records"):
                    ext = os.path.splitext(row[path])[1]
                    target = os.path.join(root, sha256(row[path].encode()).hexdigest()[:32] + ext)
                    part = os.path.join(root, f"{uuid.uuid4().hex}{ext}")
                    args = self.command(local(row[path]), part, row)
                    if args:
                        execute(args)
                        os.replace(part, target)
                    out.append(target if args else row[path])
                yield batch.assign(**{path: out})

        return self.metadata(df.mapInPandas(work, df.schema))
