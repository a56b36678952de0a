"""Whitening against numpy over all distinct vectors, with repeats, odd vectors and small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from yardspark.llm import _staging, whitening

SCHEMA = "vec_id long, embedding array<float>, z string, h long"


def brute(vectors, by_count):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors])
    fit = x if by_count else np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    d = fit - 1_000_000.0
    d = d - d.mean(axis=0)
    e, u = np.linalg.eigh(d.T @ d / n)
    e, u = e[::-1], u[:, ::-1]
    z = (x - 1_000_000.0 - (sums - 1_000_000 * n) / n) @ u / np.sqrt(e)
    return n, [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True)) for v in x], z, e / e.sum()


@pytest.mark.parametrize("by_count", [False, True])
def test_whitening_by_definition(spark, by_count, monkeypatch):
    monkeypatch.setattr(_staging.join_counted, "__defaults__", (8,))  # so that one vector is frequent and others are joined
    rng = random.Random(5)
    good = [np.float32([rng.gauss(0, s) for s in (3.0, 2.0, 1.0, 0.5)]).tolist() for _ in range(60)]
    good += [good[0]] * 40 + [good[1]] * 2
    odd = [None, [], [1.0, None, 2.0, 3.0], [1.0, float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [3.0e38, 0.0, 0.0, 0.0], [1.0, 2.0], [1.0] * 5]
    rows = [(i if i % 7 else None, v, "clash", 1) for i, v in enumerate(good)] + [(900 + i, v, "clash", 1) for i, v in enumerate(odd)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), most=3, by_count=by_count).collect()
    n, deviation, z, share = brute(good, by_count)
    assert len(got) == len(good) and {r.n for r in got} == {n} and all(r.identity_error < 1e-9 for r in got)
    by_id = {r.vec_id: r for r in got if r.vec_id is not None}
    signs = np.sign(np.array(by_id[1].z) * z[1, :3])
    for i in range(len(good)):
        if i % 7:
            assert by_id[i].deviation == deviation[i]
            assert np.allclose(by_id[i].z, z[i, :3] * signs, rtol=1e-9, atol=1e-9) and np.allclose(by_id[i].explained, share[:3], rtol=1e-9)
    assert sorted(r.deviation for r in got) == sorted(deviation)


def test_whitening_without_variance_and_large_sums(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], "", 0), (2, [1.0, 2.0], "", 0)], SCHEMA)
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 7.0], "", 0) for i in range(5)], SCHEMA)
    assert {len(r.z) for r in whitening.whiten(flat).collect()} == {1}
    wide = spark.createDataFrame([(i, [2_300_000.0 * i, 1.0], "", 0) for i in range(6)], SCHEMA)
    with np.errstate(invalid="ignore"):
        n, deviation, *_ = brute([[2_300_000.0 * i, 1.0] for i in range(6)], False)
    assert {r.vec_id: r.deviation for r in whitening.whiten(wide).collect()} == dict(enumerate(deviation))
    assert whitening.whiten(flat.withColumn("vec_id", F.lit("a"))).count() == 5
