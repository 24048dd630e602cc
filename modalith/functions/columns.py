"""Scalar functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_EXTENSIONS = frozenset({".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tiff"})


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_stem(path: Column) -> Column:
    """The base name up to its first dot."""
    return F.substring_index(base_name(path), ".", 1)


def extension(path: Column) -> Column:
    """From the last dot on, with it; empty without one."""
    return F.regexp_extract(path, r"(\.[^.]*)$", 1)


def with_extension(path: Column, old: str, new: str) -> Column:
    """The extension, and only at the end, exchanged."""
    return F.regexp_replace(path, rf"\.{old.lstrip('.')}$", f".{new.lstrip('.')}")


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def without_prefix(path: Column, prefix: str) -> Column:
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def random_name() -> Column:
    """32 hexadecimal digits."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


class SizeMode(Enum):
    FIXED = "fixed"
    MIN_SIZE = "min"
    MAX_SIZE = "max"


def new_size(width: Column, height: Column, mode: SizeMode, size: int = 512, fixed: tuple[int, int] = (512, 512), downscale_only: bool = True) -> Column:
    """struct (width, height): fixed, or the smaller (min) or larger (max) side brought to size and the other in proportion, cut to a
    whole number. downscale_only leaves alone what is smaller already."""
    if mode is SizeMode.FIXED:
        return F.struct(F.lit(fixed[0]).alias("width"), F.lit(fixed[1]).alias("height"))
    side, to_width = (F.least(width, height), height >= width) if mode is SizeMode.MIN_SIZE else (F.greatest(width, height), width >= height)
    scaled = lambda a, b: F.floor(F.lit(size).cast("long") * a / b).cast("int")
    whole = F.lit(size)
    fit = F.when(to_width, F.struct(whole.alias("width"), scaled(height, width).alias("height"))).otherwise(F.struct(scaled(width, height).alias("width"), whole.alias("height")))
    same = F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))
    return F.when((side < size) & F.lit(downscale_only), same).otherwise(fit)


def even(n: Column) -> Column:
    return n + n % 2


def adjusted_fps(fps: Column, target: int, eps: float = 0.1) -> Column:
    """target where fps is further than eps from it."""
    return F.when((fps < target - eps) | (fps > target + eps), F.lit(float(target))).otherwise(fps)


def aspect_ratio(width: Column, height: Column) -> Column:
    return width / height


def frame_index(fps: Column, duration: Column, position: Column | float, frames: Column) -> Column:
    """The frame at a relative position of a video."""
    return F.least(F.floor(F.floor(fps * duration) * position), frames - 1).cast("int")


def sampled_frames(step: int, passes: int, frames: Column) -> Column:
    """Every step-th frame from step on, passes of them at most."""
    last = F.least(F.lit(passes * step), frames - 1)
    return F.when(last >= step, F.sequence(F.lit(step), last.cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))


def padded(n: Column, to: int = 8) -> Column:
    """struct (before, after): what brings n to a multiple, split between both sides."""
    rest = F.pmod(-n, F.lit(to))
    return F.struct(F.floor(rest / 2).cast("int").alias("before"), (rest - F.floor(rest / 2)).cast("int").alias("after"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(a: Column) -> Column:
    """A vector of zeros stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """A zero vector has similarity 0 to all."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def scaled_similarity(a: Column, b: Column, logit_scale: float) -> Column:
    return F.exp(F.lit(logit_scale)) * cosine(a, b)


def linear_head(embedding: Column, weights: list[float], bias: float, normalise: bool = False) -> Column:
    """weights . embedding + bias, as of a regression over embeddings; stacked affine layers collapse to one."""
    e = l2_normalised(embedding) if normalise else embedding
    return dot(e, F.array(*(F.lit(float(w)) for w in weights))) + F.lit(bias)


def collapse(layers: list[tuple[list[list[float]], list[float]]]) -> tuple[list[float], float]:
    """(weights, bias) of affine layers (matrix, bias) with one output in the end."""
    import numpy as np

    w, b = np.array(layers[0][0], float), np.array(layers[0][1], float)
    for m, c in layers[1:]:
        w, b = np.array(m, float) @ w, np.array(m, float) @ b + np.array(c, float)
    return w[0].tolist(), float(b[0])


def label_prompts(label: str, templates: list[str]) -> list[str]:
    return [t.format(label.strip()) for t in templates]


def prototype(vectors: list[list[float]]) -> list[float]:
    """The mean of normalised vectors, normalised."""
    import numpy as np

    v = np.array(vectors, float)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    m = (v / np.where(n == 0, 1, n)).mean(0)
    return (m / (np.linalg.norm(m) or 1)).tolist()


def boxes_from_json(text: Column) -> Column:
    """array of struct (box, text) of JSON pairs [[box, text], ...]."""
    pairs = F.from_json(text, "array<array<string>>")
    return F.transform(pairs, lambda p: F.struct(F.from_json(p[0], "array<array<int>>").alias("box"), p[1].alias("text")))


def clamped_box(box: Column, width: Column, height: Column) -> Column:
    """struct (x0, y0, x1, y1) of two corners, inside the image and in order."""
    x = lambda i: F.least(F.greatest(box[i][0], F.lit(0)), width)
    y = lambda i: F.least(F.greatest(box[i][1], F.lit(0)), height)
    return F.struct(F.least(x(0), x(1)).alias("x0"), F.least(y(0), y(1)).alias("y0"), F.greatest(x(0), x(1)).alias("x1"), F.greatest(y(0), y(1)).alias("y1"))


def text_area(boxes: Column, width: Column, height: Column) -> Column:
    """Area of all boxes, each two opposite corners, over the image's."""
    area = lambda b: F.abs((b[1][0] - b[0][0]) * (b[1][1] - b[0][1])).cast("double")
    return F.aggregate(boxes, F.lit(0.0), lambda s, b: s + area(b)) / (width * height)


def caption_without_repeats(caption: Column) -> Column:
    """The caption, or an empty one if a sentence of it repeats."""
    parts = F.split(caption, r"\.")
    return F.when(caption.isNull(), None).when(F.size(F.array_distinct(parts)) == F.size(parts), caption).otherwise("")


def model_answer(text: Column, stop: str | None = None, after: str | None = None) -> Column:
    """A model's answer: what follows the last mark `after`, up to </s>, without the stop string, trimmed."""
    white = F.lit(" \t\r\n")
    t = F.btrim(text, white)
    if after:
        t = F.substring_index(t, after, -1)
    t = F.substring_index(t, "</s>", 1)
    if stop:
        t = F.when(F.endswith(t, F.lit(stop)), F.left(t, F.length(t) - len(stop))).otherwise(t)
    return F.btrim(t, white)
