"""The extractors: media facts, hashes, similarities, and models behind pluggable backends.

A backend is a callable made in the task by the factory that the caller registers or passes; this package brings no model. What
surrounds a model - sampling of frames, crops, normalisation, heads, templates, answer cleaning, column names - is here.
"""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalith.functions import columns as X
from modalith.functions.images import BadImage, check_whole, decode, encode_png, image_size, perceptual_hash, resize, rgb
from modalith.operators.extract import Extractor

#: name -> factory of a backend
BACKENDS: dict[str, Callable[[], Any]] = {}


def register_backend(name: str, factory: Callable[[], Any]) -> None:
    BACKENDS[name] = factory


class ImageInfo(Extractor):
    """A damaged image is a result, not an error: is_correct is false, the sizes are null and error says why."""

    modalities = ("image",)
    outputs = "is_correct boolean, width int, height int, channels int, error string"

    def prepare(self, data: dict, row: dict) -> tuple:
        blob = data["image"]
        try:
            w, h, c = image_size(blob)
            if blob[:8] == b"\x89PNG\r\n\x1a\n":
                h, w, c = decode(blob).shape
            else:
                check_whole(blob)
            return True, w, h, c, None
        except BadImage as e:
            return False, None, None, None, str(e)

    def process(self, state: Any, batch: list) -> list[tuple]:
        return batch


def image_info_native(df: DataFrame, path: str = "image_path") -> DataFrame:
    """The same for loose files, by Spark's image source: the files are listed and decoded in the JVM and meet df by path."""
    spark = df.sparkSession
    folders = [r[0] for r in df.select(F.regexp_replace(path, "/[^/]*$", "")).distinct().collect()]  # as many as there are folders
    found = spark.read.format("image").load(folders).select("image.*")
    good = F.col("nChannels") > 0
    plain = F.regexp_replace("origin", "^file:/+", "/")
    facts = found.select(
        plain.alias("_origin"), good.alias("is_correct"), *(F.when(good, F.col(c)).alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "channels"))),
        F.when(~good, "cannot identify image file").alias("error"),
    )
    return df.join(facts, F.regexp_replace(path, "^file:/+", "/") == F.col("_origin"), "left").drop("_origin")


class PerceptualHash(Extractor):
    modalities = ("image",)

    def __init__(self, size: int = 8) -> None:
        self.size, self.outputs = size, f"image_phash_{size} string"

    def prepare(self, data: dict, row: dict) -> str:
        return perceptual_hash(decode(data["image"]), self.size)

    def process(self, state: Any, batch: list) -> list[tuple]:
        return [(h,) for h in batch]


class Constant(Extractor):
    """1 for every image: for trying out pipelines."""

    modalities = ("image",)
    outputs = "dummy_label int"

    def process(self, state: Any, batch: list) -> list[tuple]:
        return [(1,)] * len(batch)


class AudioInfo(Extractor):
    """WAV by the standard library; others by soundfile, where that is installed."""

    modalities = ("audio",)
    outputs = "is_correct boolean, duration double, sample_rate int, error string"

    def prepare(self, data: dict, row: dict) -> tuple:
        try:
            return True, *self.facts(data["audio"]), None
        except (wave.Error, EOFError, RuntimeError) as e:
            return False, None, None, str(e) or "audio is cut short"

    @staticmethod
    def facts(blob: bytes) -> tuple[float, int]:
        try:
            with wave.open(io.BytesIO(blob)) as w:
                return w.getnframes() / w.getframerate(), w.getframerate()
        except wave.Error as e:
            try:
                import soundfile
            except ImportError:
                raise e from None
            s = soundfile.SoundFile(io.BytesIO(blob))
            return len(s) / s.samplerate, s.samplerate

    def process(self, state: Any, batch: list) -> list[tuple]:
        return batch


class _Backed(Extractor):
    """backend: a name in BACKENDS, or a factory."""

    def __init__(self, backend: str | Callable[[], Any]) -> None:
        if isinstance(backend, str) and backend not in BACKENDS:
            raise LookupError(f"no backend {backend!r} is registered; there are {sorted(BACKENDS)}")
        self.factory = BACKENDS[backend] if isinstance(backend, str) else backend

    def setup(self) -> Any:
        return self.factory()


class VideoInfo(_Backed):
    """backend: bytes -> (width, height, fps, duration)."""

    modalities = ("video",)
    outputs = "is_correct boolean, error string, width int, height int, fps double, duration double"

    def process(self, probe: Any, batch: list) -> list[tuple]:
        out = []
        for data, _ in batch:
            try:
                out.append((True, None, *probe(data["video"])))
            except Exception as e:  # noqa: BLE001 - whatever a decoder raises
                out.append((False, str(e), None, None, None, None))
        return out


class ImageScore(_Backed):
    """A number for each image: aesthetics, safety, and the like. backend: list of RGB arrays -> list of numbers."""

    modalities = ("image",)

    def __init__(self, name: str, backend: str | Callable[[], Any], kind: str = "double") -> None:
        super().__init__(backend)
        self.outputs, self.kind = f"`{name}` {kind}", kind

    def prepare(self, data: dict, row: dict) -> np.ndarray:
        return rgb(decode(data["image"]))

    def process(self, model: Any, batch: list) -> list[tuple]:
        cast = int if self.kind == "int" else float
        return [(cast(x),) for x in model(batch)]


def aesthetic(backend: str | Callable, name: str = "aesthetic_score") -> ImageScore:
    return ImageScore(name, backend)


def nsfw(backend: str | Callable) -> ImageScore:
    return ImageScore("nsfw_score", backend)


def watermark(model: str, backend: str | Callable) -> ImageScore:
    """0 or 1."""
    return ImageScore(f"watermark_{model}", backend, "int")


class LabelScores(_Backed):
    """Similarity of each image to each label. backend: object with text(list of str) and image(list of arrays), both giving vectors;
    a label's vector is the normalised mean over its prompts, made once for each task."""

    modalities = ("image",)

    def __init__(self, model: str, labels: list[str], backend: str | Callable, templates: tuple[str, ...] = ("{}", "photo of a {}")) -> None:
        super().__init__(backend)
        self.labels, self.templates = labels, list(templates)
        self.outputs = ", ".join(f'`{model} clip score "{x}"` double' for x in labels)

    def setup(self) -> tuple[Any, np.ndarray]:
        model = self.factory()
        return model, np.array([X.prototype(model.text(X.label_prompts(x, self.templates))) for x in self.labels])

    def prepare(self, data: dict, row: dict) -> np.ndarray:
        return rgb(decode(data["image"]))

    def process(self, state: tuple, batch: list) -> list[tuple]:
        model, prototypes = state
        v = np.array(model.image(batch), float)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return [tuple(map(float, r)) for r in (v / np.where(n == 0, 1, n)) @ prototypes.T]


class TextSimilarity(_Backed):
    """Similarity of each image to its own text, row by row, times exp(logit_scale) if there is one."""

    modalities = ("image", "text")

    def __init__(self, name: str, backend: str | Callable, templates: tuple[str, ...] = ("{}",), logit_scale: float | None = None) -> None:
        super().__init__(backend)
        self.outputs, self.templates, self.factor = f"`{name}` double", list(templates), 1.0 if logit_scale is None else float(np.exp(logit_scale))

    def prepare(self, data: dict, row: dict) -> tuple[np.ndarray, list[str]]:
        return rgb(decode(data["image"])), X.label_prompts(data["text"], self.templates)

    def process(self, model: Any, batch: list) -> list[tuple]:
        images = np.array(model.image([b[0] for b in batch]), float)
        n = np.linalg.norm(images, axis=1, keepdims=True)
        texts = model.text([p for b in batch for p in b[1]])
        k = len(self.templates)
        own = np.array([X.prototype(texts[i * k : i * k + k]) for i in range(len(batch))])
        return [(float(x) * self.factor,) for x in (images / np.where(n == 0, 1, n) * own).sum(1)]


class Caption(_Backed):
    """A caption for each image or video. backend: (list of bytes or arrays, prompt) -> list of texts; `after` and `stop` cut the
    answer out of what the model says, `once` empties captions that repeat a sentence."""

    def __init__(self, name: str, backend: str | Callable, modality: str = "image", prompt: str | None = None, after: str | None = None, stop: str | None = None, once: bool = False) -> None:
        super().__init__(backend)
        self.modalities, self.prompt, self.after, self.stop, self.once = (modality,), prompt, after, stop, once
        self.outputs = f"`{name}` string"
        self.batch_size = 16 if modality == "image" else 8

    def prepare(self, data: dict, row: dict) -> Any:
        return rgb(decode(data["image"])) if "image" in data else data["video"]

    def answer(self, text: str) -> str:
        text = text.strip()
        if self.after:
            text = text.rpartition(self.after)[2]
        text = text.partition("</s>")[0]
        if self.stop:
            text = text.removesuffix(self.stop)
        text = text.strip()
        parts = text.split(".")
        return "" if self.once and len(set(parts)) < len(parts) else text

    def process(self, model: Any, batch: list) -> list[tuple]:
        return [(self.answer(t),) for t in model(batch, self.prompt)]


def captioner(model: str, prompt_name: str | None, backend: str | Callable, modality: str = "image", **more: Any) -> Caption:
    """A captioner whose column is named after its model and prompt."""
    name = f"caption {model}" + (f" prompt {prompt_name}" if prompt_name else "")
    return Caption(name, backend, modality, prompt_name, **more)


class TextBoxes(_Backed):
    """backend: list of RGB arrays -> for each a list of boxes, two corners each."""

    modalities = ("image",)
    outputs = "text_boxes array<array<array<int>>>, num_text_boxes int, text_area double"

    def prepare(self, data: dict, row: dict) -> np.ndarray:
        return rgb(decode(data["image"]))

    def process(self, model: Any, batch: list) -> list[tuple]:
        out = []
        for px, boxes in zip(batch, model(batch), strict=True):
            h, w = px.shape[:2]
            boxes = [[[int(v) for v in corner] for corner in b] for b in boxes]
            out.append((boxes, len(boxes), sum(abs((b[1][0] - b[0][0]) * (b[1][1] - b[0][1])) for b in boxes) / (w * h)))
        return out


class ReadText(_Backed):
    """Text in the boxes of a column, as JSON [[box, text], ...]. backend: list of crops -> list of texts."""

    modalities = ("image",)

    def __init__(self, model: str, backend: str | Callable, boxes: str = "text_boxes") -> None:
        super().__init__(backend)
        self.metadata, self.boxes, self.outputs = (boxes,), boxes, f"`OCR_{model}` string"

    def prepare(self, data: dict, row: dict) -> list:
        px = rgb(decode(data["image"]))
        h, w = px.shape[:2]
        out = []
        for box in row[self.boxes] if row[self.boxes] is not None else []:
            (x0, y0), (x1, y1) = ((min(max(int(c[0]), 0), w), min(max(int(c[1]), 0), h)) for c in box)
            out.append(([[int(v) for v in c] for c in box], px[min(y0, y1) : max(y0, y1), min(x0, x1) : max(x0, x1)]))
        return out

    def process(self, model: Any, batch: list) -> list[tuple]:
        crops = [c for boxes in batch for _, c in boxes if c.size]
        texts = iter(model(crops) if crops else [])
        return [(json.dumps([[b, next(texts) if c.size else ""] for b, c in boxes], ensure_ascii=False),) for boxes in batch]


class FrameOf(_Backed):
    """An image extractor on one frame of each video. backend: bytes -> object with fps, duration, frames and read(index)."""

    modalities = ("video",)

    def __init__(self, inner: Extractor, backend: str | Callable, position: float = 0.5) -> None:
        super().__init__(backend)
        self.inner, self.position, self.outputs, self.metadata = inner, position, inner.outputs, inner.metadata

    def setup(self) -> tuple[Any, Any]:
        return self.factory(), self.inner.setup()

    def prepare(self, data: dict, row: dict) -> tuple:
        return data["video"], row

    def process(self, state: tuple, batch: list) -> list[tuple]:
        opened, inner, ready = state[0], state[1], []
        for blob, row in batch:
            v = opened(blob)
            i = min(int(int(v.fps * v.duration) * self.position), v.frames - 1)
            ready.append(self.inner.prepare({"image": encode_png(v.read(i))}, row))
        return self.inner.process(inner, ready)


class OpticalFlow(_Backed):
    """Mean motion between sampled frames, to three digits; NaN for fewer than two. backend: object with frames(bytes) -> number,
    read(bytes, index) and flow(frame, frame) -> array (height, width, 2)."""

    modalities = ("video",)
    batch_size = 4

    def __init__(self, name: str, backend: str | Callable, step: int = 12, passes: int = 10, min_side: int = 512) -> None:
        super().__init__(backend)
        self.outputs, self.step, self.passes, self.min_side = f"{name} double", step, passes, min_side

    def _small(self, frame: np.ndarray) -> np.ndarray:
        """The frame with its shorter side at min_side, if it is longer."""
        h, w = frame.shape[:2]
        if min(h, w) <= self.min_side:
            return frame
        return resize(frame, max(1, w * self.min_side // min(h, w)), max(1, h * self.min_side // min(h, w)))

    def process(self, model: Any, batch: list) -> list[tuple]:
        out = []
        for data, _ in batch:
            at = range(self.step, min(self.passes * self.step + 1, model.frames(data["video"])), self.step)
            frames = [self._small(np.atleast_3d(model.read(data["video"], i))) for i in at]
            means = [float(np.linalg.norm(model.flow(a, b), axis=2).mean()) for a, b in zip(frames, frames[1:])]
            out.append((round(float(np.mean(means)), 3) if means else float("nan"),))
        return out
