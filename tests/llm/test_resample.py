"""Importance resampling against a plain version, with runs of words over line ends, ties, odd rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from yardspark.llm import _staging, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most, buckets):
    w = WORD.findall((text or "").translate(UPPER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, most, buckets, percent, least):
    docs = [features(t, most, buckets) for _, t in rows]
    s, t = Counter(b for _, f in docs for b in f), Counter(b for x in target for b in features(x, most, buckets)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * float(s.total() + buckets) / ((s[b] + 1.0) * float(t.total() + buckets))))
    out = []
    for (i, _), (n, f) in zip(rows, docs, strict=True):
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r, rank.get(id(r))) for r in out]


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [1, 2, 4])
def test_resample_by_definition(spark, most, monkeypatch):
    monkeypatch.setattr(_staging.join_counted, "__defaults__", (8,))  # so that frequent lines are told from others
    monkeypatch.setattr(resample, "_STEPS", 7)
    rng = random.Random(most)
    vocabulary = ["Alpha", "beta", "GAMMA", "délta", "Éps", "42", "x", "ζ", "don't", "日本"]
    line = lambda: rng.choice([" ", "  ", ", ", "\t"]).join(rng.choices(vocabulary, k=rng.randrange(0, 9)))
    common = [line() for _ in range(5)] + ["one common line"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.5 else line() for _ in range(rng.randrange(0, 7)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, "a\rb\x00c\x1fd e"), (94, "word " * 3000), (95, "Ä" * 5000), (None, "one common line\n" * 20), (96, rows[7][1]), (97, rows[7][1])]
    target = [line() for _ in range(9)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, weight string").repartition(3)
    bench = spark.createDataFrame([(t, 5) for t in target], "text string, h int")
    got = resample.resample(docs, bench, most=most, buckets=500, percent=30, least_words=6, seed="7")
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert plain(got) == sorted(brute(rows, target, most, 500, 30, 6), key=repr)


def test_resample_ties_and_small_tables(spark):
    schema = "doc_id long, text string"
    bench = spark.createDataFrame([("some words",)], "text string")
    same = spark.createDataFrame([(5, "a b c")] * 4 + [(None, "a b c")] * 2, schema)
    got = resample.resample(same, bench, percent=50, least_words=1).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3] and len(got) == 6
    few = resample.resample(same, bench, percent=10, least_words=1).collect()
    assert len(few) == 6 and not any(r.rank for r in few)
    assert resample.resample(same.limit(0), bench).count() == 0
    assert resample.resample(same, bench.limit(0), percent=100, least_words=1).filter("rank is null").count() == 0
    words = resample.resample(same.withColumn("doc_id", F.lit("id")), bench, percent=100, least_words=4)
    assert words.count() == 6 and words.filter("rank is not null").count() == 0
