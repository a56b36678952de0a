"""Runs of user-supplied recognisers and detectors over tables of images, and hooks on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardspark.operators.readings import best_reading


def infer_readings(images: DataFrame, factory: Callable[[], Callable[[bytes], tuple[str, float]]], key: str = "path", content: str = "content") -> DataFrame:
    """(key, text, conf, method) per image. The factory is called once a task; an image that fails gets the method `error`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = factory()
        for frame in frames:
            out = []
            for name, data in zip(frame[key], frame[content], strict=True):
                try:
                    text, conf = read(data)
                    out.append((name, text, float(conf), "model"))
                except Exception:  # one bad image never ends the job
                    out.append((name, "", 0.0, "error"))
            yield pd.DataFrame(out, columns=[key, "text", "conf", "method"])

    return images.select(key, content).mapInPandas(run, f"`{key}` {dict(images.dtypes)[key]}, text string, conf double, method string")


def infer_detections(frames: DataFrame, factory: Callable[[], Callable[[bytes], list[tuple]]], key: str = "frame", content: str = "content") -> DataFrame:
    """(key, box_id, x1, y1, x2, y2, cls, conf): a detector's boxes; a frame that fails has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = factory()
        for batch in batches:
            out = []
            for name, data in zip(batch[key], batch[content], strict=True):
                try:
                    out += [(name, i, *map(float, box), int(cls), float(conf)) for i, (box, cls, conf) in enumerate(detect(data))]
                except Exception:
                    continue
            yield pd.DataFrame(out, columns=[key, "box_id", "x1", "y1", "x2", "y2", "cls", "conf"])

    return frames.select(key, content).mapInPandas(run, f"`{key}` {dict(frames.dtypes)[key]}, box_id int, x1 double, y1 double, x2 double, y2 double, cls int, conf double")


def best_of_attempts(images: DataFrame, variants: dict[str, Callable[[bytes], bytes]], factory: Callable[[], Callable[[bytes], tuple[str, float]]], key: str = "path") -> DataFrame:
    """The best reading of several preparations of each image; the plain image is always one of them."""
    steps = {"direct": None} | variants

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = factory()
        for frame in frames:
            out = []
            for name, data in zip(frame[key], frame["content"], strict=True):
                for i, (method, prepare) in enumerate(steps.items()):
                    try:
                        text, conf = read(prepare(data) if prepare else data)
                        out.append((name, i, text, float(conf), method))
                    except Exception:
                        out.append((name, i, "", 0.0, "error"))
            yield pd.DataFrame(out, columns=[key, "attempt", "text", "conf", "method"])

    kind = dict(images.dtypes)[key]
    return best_reading(images.select(key, "content").mapInPandas(run, f"`{key}` {kind}, attempt int, text string, conf double, method string"), key, "attempt")


def on_batch(stream: DataFrame, hooks: list[Callable[[DataFrame, int], None]]):
    """A writer that calls the hooks with every batch, in order."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for hook in hooks:
                hook(held, number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(each)


def count_errors(readings: DataFrame) -> DataFrame:
    return readings.agg(F.count("*").alias("images"), F.count_if(F.col("method") == "error").alias("errors"))
