"""Pipelines: stages over a dataset, each a function of it, with a policy for errors."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from modalith.operators.tables import persisted
from modalith.operators.transforms import Resizer, VideoTransform
from modalith.plans.dataset import Dataset

STOP, CONTINUE = "stop", "continue"


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[Dataset], Dataset]
    on_error: str = STOP


def logger(name: str, folder: str | None = None) -> logging.Logger:
    """A logger to the standard output, or to <folder>/<name>.log."""
    out = logging.getLogger(f"modalith.pipeline.{name}")
    if not out.handlers:
        handler = logging.FileHandler(f"{folder}/{name}.log") if folder else logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        out.addHandler(handler)
        out.setLevel(logging.INFO)
    return out


@dataclass
class Pipeline:
    """on_error of a stage: stop raises; continue leaves the dataset as it was before the stage, and for that runs the stage at once and
    keeps its rows, as a lazy one would fail elsewhere. counts: log rows after each stage, which runs the plan each time."""

    name: str
    logs: str | None = None
    counts: bool = False
    stages: list[Stage] = field(default_factory=list)

    def _add(self, name: str, run: Callable[[Dataset], Dataset], on_error: str) -> Pipeline:
        if on_error not in (STOP, CONTINUE):
            raise ValueError("on_error is stop or continue")
        self.stages.append(Stage(name, run, on_error))
        return self

    def extract(self, make: Callable[..., Any], kwargs: dict | None = None, on_error: str = STOP, skip_if_present: bool = True, apply: dict | None = None) -> Pipeline:
        """make(**kwargs) gives the extractor, when the stage runs. If all its columns are there the stage is skipped, or they are made
        anew; columns of a part of them always are."""

        def run(d: Dataset) -> Dataset:
            what = make(**(kwargs or {}))
            have = [c for c in what.columns if c in d.columns]
            if skip_if_present and len(have) == len(what.columns):
                return d
            return d.with_df(d.df.drop(*have)).extract(what, **(apply or {}))

        return self._add(f"extract {getattr(make, '__name__', make)}", run, on_error)

    def shuffle(self, seed: int | None = None, on_error: str = STOP) -> Pipeline:
        return self._add("shuffle", lambda d: d.shuffled(seed), on_error)

    def deduplicate(self, columns: list[str], on_error: str = STOP) -> Pipeline:
        return self._add(f"deduplicate {columns}", lambda d: d.keep_first(columns), on_error)

    def dataframe(self, f: Callable[[DataFrame], DataFrame], on_error: str = STOP) -> Pipeline:
        return self._add(f"dataframe {getattr(f, '__name__', f)}", lambda d: d.transform(f), on_error)

    def files(self, what: Resizer | VideoTransform, folder: str, on_error: str = STOP, **more: Any) -> Pipeline:
        step = (lambda d: d.resize_images(what, folder, **more)) if isinstance(what, Resizer) else (lambda d: d.transform_videos(what, folder, **more))
        return self._add(f"files {type(what).__name__}", step, on_error)

    def run(self, d: Dataset) -> Dataset:
        log = logger(self.name, self.logs)
        for stage in self.stages:
            try:
                new = stage.run(d)
                if stage.on_error == CONTINUE:
                    new = new.with_df(persisted(new.df))
            except Exception:
                if stage.on_error == STOP:
                    raise
                log.exception("%s failed; the dataset stays as it was", stage.name)
                continue
            d = new
            log.info("%s: columns %s%s", stage.name, len(d.columns), f", rows {d.count()}" if self.counts else "")
        return d
