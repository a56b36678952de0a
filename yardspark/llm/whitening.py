"""Whitening of embeddings by the covariance of their distinct vectors.

A vector's entries c become whole numbers x = floor(scale * c) + offset. Equal x vectors are grouped; each group counts
once in the fit, or as often as it has rows. The centred groups are multiplied with themselves in each task, the
products are summed in Spark, and the driver decomposes one matrix of dimensions x dimensions. Each distinct vector is
whitened once; rows get their vector's values by a join in which frequent vectors are broadcast.

Rows take no part whose vector is null or empty, holds a null or non-finite entry or one beyond 2**40 / scale, or has
another length than most of the rest (the greater length of equally frequent ones). Ids are not looked at: null and
repeated ones stay, each row with its own vector's values. Components without variance (an eigenvalue of at most 1e-12
of the trace) cannot be whitened and are left out, so a table of one distinct vector gives no rows, as an empty one
does. Of each eigenvector the sign is taken that makes its largest entry positive. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardspark.llm._staging import Staging, join_counted

#: Entries beyond this after scaling are treated like non-finite ones.
_MOST = 1 << 40
#: Least share of the trace of a component that can be whitened.
_LEAST = 1e-12
#: Rows of vectors handled at once.
_ROWS = 4096


@dataclass
class Model:
    """A fit: weight and sums of the x vectors, components as columns, their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def whole_numbers(vector: Column, scale: int, offset: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + offset)


def _usable(vector: Column, scale: int) -> Column:
    bound = float(_MOST) / scale  # NaN is greater than any number
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < bound, F.lit(False))), F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(vectors, weights, rows) of a few rows at a time; the first two columns are vector and weight."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part.column(0).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims), part.column(1).to_numpy(zero_copy_only=False), part


def _sums(vectors: DataFrame, dims: int, kind: str) -> tuple[int, list]:
    """The weight of all vectors and their weighted sum, exact for whole numbers."""
    number = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, number), 0
        for x, w, _ in _blocks(batches, dims, number):
            total, n = total + w.astype(number) @ x, n + int(w.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total), pa.array(np.full(dims, n))], names=["j", "s", "n"])

    rows = vectors.mapInArrow(run, f"j long, s {kind}, n long").groupBy("j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("j").collect()
    return (rows[0]["n"], [r["s"] for r in rows]) if rows else (0, [])


def _covariance(vectors: DataFrame, base: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """The covariance with divisor n around base + rest; base is taken off first, in the vectors' own numbers."""
    dims, kind = len(base), base.dtype.type
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((dims, dims)), False
        for x, w, _ in _blocks(batches, dims, kind):
            d = (x - base).astype(float) - rest
            total, some = total + (d * w[:, None]).T @ d, True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])], names=["i", "j", "v"])

    out = np.zeros((dims, dims))
    for r in vectors.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n
    return out


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and the fractions that are left."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])


def fit(vectors: DataFrame, dims: int, most: int) -> Model | None:
    """The model of distinct vectors (x, weight); None without any."""
    n, sums = _sums(vectors, dims, "long")
    if not n:
        return None
    values, columns = np.linalg.eigh(_covariance(vectors, *_centre(n, sums), n))
    trace, order = float(values.sum()), np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > _LEAST * trace]
    columns = columns[:, order]
    top = np.abs(columns).argmax(axis=0)
    return Model(n, sums, columns * np.sign(columns[top, np.arange(len(order))]), values[order], trace)


def _whiten(vectors: DataFrame, model: Model) -> DataFrame:
    """vectors (x, weight, ...) with z, the whitened components, and deviation, the sum of (n * x - sums) ** 2."""
    dims, n = len(model.sums), model.n
    base, rest = _centre(n, model.sums)
    left = np.array([s % n for s in model.sums], np.int64)
    matrix = model.components / np.sqrt(model.values)
    names = [c for c in vectors.columns if c not in ("x", "weight")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, w, part in _blocks(batches, dims, np.int64):
            d = x - base
            z = (d.astype(float) - rest) @ matrix
            big = dims * (n * (int(np.abs(d).max(initial=0)) + 1)) ** 2 >= 1 << 63
            apart = (d.astype(object) if big else d) * n - left
            rows = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], part.column(1), rows, pa.array((apart**2).sum(axis=1).tolist(), pa.int64())], names=[*names, "weight", "z", "deviation"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", weight long, z array<double>, deviation long")


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64, offset: int = 1_000_000, most: int = 16, by_count: bool = False) -> DataFrame:
    """(vec_id, z, n, deviation, explained, identity_error): each usable row's whitened components and the fit's figures.

    z: up to `most` components by falling eigenvalue; explained: each one's share of the variance; identity_error: the
    largest absolute entry of the whitened vectors' covariance less the identity; n: the weight of the fit, which takes
    each distinct vector once, or by_count as often as it has rows; deviation: exact, an error where it passes a long.
    """
    spark = table.sparkSession
    kind = table.schema[vec_id].dataType.simpleString()
    nothing = spark.createDataFrame([], f"`{vec_id}` {kind}, z array<double>, n long, deviation long, explained array<double>, identity_error double")
    good = table.select(vec_id, F.col(vector).alias("v")).filter(_usable(F.col("v"), scale))
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return nothing
    dims = lengths["d"]
    keys = {"h": F.xxhash64("x"), "g": F.xxhash64(F.lit(1), "x")}
    rows = good.filter(F.size("v") == dims).select(vec_id, whole_numbers(F.col("v"), scale, offset).alias("x"))
    stage = Staging(spark, "whitening")
    groups = stage.put(rows.groupBy("x").agg(F.count("*").alias("times")).withColumns(keys), "groups")
    weighted = groups.select("x", (F.col("times") if by_count else F.lit(1).cast("long")).alias("weight"), "times", "h", "g")
    model = fit(weighted, dims, most)
    if model is None or not len(model.values):
        return nothing
    white = stage.put(_whiten(weighted, model), "white")
    stage.drop("groups")
    held = white.select("z", "weight")
    n, sums = _sums(held, len(model.values), "double")
    error = np.abs(_covariance(held, np.zeros(len(sums)), np.array(sums) / n, n) - np.eye(len(sums))).max()
    out = join_counted(rows.withColumns(keys).drop("x"), white.drop("weight"), ["h", "g"], "times", lengths["count"])
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return out.select(vec_id, "z", F.lit(model.n).cast("long").alias("n"), "deviation", share.alias("explained"), F.lit(float(error)).alias("identity_error"))
