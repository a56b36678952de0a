"""Importance resampling of documents towards the word n-grams of a target corpus.

Words are runs of digits, letters and signs beyond ASCII, with A-Z lower-cased; features are all runs of 1 to `most`
words, joined by a blank, in buckets by crc32. A bucket's gain is the logarithm of its share in the target over its
share in the documents, both smoothed by one a bucket, in thousandths and rounded down. A document's weight is the sum
of its features' gains; with Gumbel noise from a hash of its id it becomes the score by which documents are drawn.

Newlines separate words, so texts are cut into lines, and the features of each distinct line are counted once: the
corpus's counts take them times the line's occurrences, and the documents take the line's weight. Runs of words that
go over the end of a line are added for each document from the words next to the line ends alone.

A null or empty text has no features: n_features and weight are 0. Each row is a document of its own, also where its id
repeats or is null (hashed as an empty id); of equal scores the smaller id comes first, null last, then the row read
first. Lines are told apart by two 64-bit hashes once their features are counted. An empty table gives an empty one; an
empty target makes every gain follow from the documents alone. Other columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardspark.llm._staging import Staging, join_counted

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Signs between words, after lower-casing.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Steps of the scores' histogram from which the least drawn score is bounded.
_STEPS = 4096


def words(line: Column) -> Column:
    plain = F.octet_length(line) == F.char_length(line)  # ASCII alone: lower() changes A-Z only, and is faster
    small = F.when(plain, F.lower(line)).otherwise(F.translate(line, _UPPER, _SMALL))
    return F.filter(F.split(small, _BETWEEN), lambda w: w != "")


def _bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def _runs(w: Column, size: int) -> Column:
    """All runs of `size` consecutive words."""
    if size == 1:
        return w
    at = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(w, i, size), " "))


def _line_features(w: Column, most: int, buckets: int) -> Column:
    return F.flatten(F.array(*[F.transform(_runs(w, k), lambda x: _bucket(x, buckets)) for k in range(1, most + 1)]))


def _crossing_features(lines: Column, most: int, buckets: int) -> Column:
    """Buckets of the runs that hold words of two or more lines: of a long line only its first and last words matter."""
    if most == 1:
        return F.array().cast("array<int>")
    reach = 2 * (most - 1)
    # a long line is cut into its first and last words; the gap between them takes no part in any run
    near = lambda w: F.when(F.size(w) <= reach, w).otherwise(F.concat(F.slice(w, 1, most - 1), F.array(F.lit(None).cast("string")), F.slice(w, 1 - most, most - 1)))
    marked = F.transform(lines, lambda x, i: F.transform(near(words(x)), lambda w: F.struct(w.alias("w"), i.alias("i"))))
    flat = F.flatten(marked)

    def of(size: int) -> Column:
        at = F.when(F.size(flat) >= size, F.sequence(F.lit(1), F.size(flat) - size + 1)).otherwise(F.array().cast("array<int>"))
        runs = F.transform(at, lambda p: F.slice(flat, p, size))
        crossing = F.filter(runs, lambda r: (r[0]["i"] < r[size - 1]["i"]) & ~F.exists(r, lambda x: x["w"].isNull()))
        return F.transform(crossing, lambda r: _bucket(F.array_join(F.transform(r, lambda x: x["w"]), " "), buckets))

    return F.flatten(F.array(*[of(k) for k in range(2, most + 1)]))


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x != "")


class Features:
    """The features of a corpus: distinct lines with their counts, and of each row the crossing runs, both written."""

    def __init__(self, stage: Staging, docs: DataFrame, text: str, most: int, buckets: int, name: str, crossing: DataFrame | None = None):
        self.most, self.buckets = most, buckets
        each = docs.select(F.explode(_lines(F.col(text))).alias("line"))
        # a line's occurrences are summed in the tasks that read it and once more for the whole corpus
        known = each.groupBy("line").agg(F.count("*").alias("times"))
        w = known.select("times", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), words(F.col("line")).alias("w")).filter(F.size("w") > 0)
        self.lines = stage.put(w.select("h", "g", "times", F.size("w").alias("n_words"), _line_features(F.col("w"), most, buckets).alias("buckets")), f"{name}-lines")
        self.crossing = crossing if crossing is not None else docs.select(_crossing_features(_lines(F.col(text)), most, buckets).alias("crossing"))

    def counts(self) -> dict[int, int]:
        """Features of the whole corpus in each bucket that has some; at most `buckets` numbers reach the driver."""
        parts = self.lines.select(F.explode("buckets").alias("b"), F.col("times").alias("n"))
        if self.most > 1:
            parts = parts.unionByName(self.crossing.select(F.explode("crossing").alias("b"), F.lit(1).cast("long").alias("n")))
        return {r["b"]: r["n"] for r in parts.groupBy("b").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Each bucket's gain in thousandths."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def _sum_of(buckets: Column, gain: list[int]) -> Column:
    table = F.from_json(F.lit(json.dumps(gain)), "array<bigint>")  # folded to one constant
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda total, b: total + F.get(table, b))


def weigh(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", most: int = 1, buckets: int = 10_000) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of every row of docs; row is a number of its own."""
    stage = Staging(docs.sparkSession, "resample")
    keys = F.transform(_lines(F.col(text)), lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g")))
    # rows get their numbers once, in a written table, so that a task that runs again cannot number them anew
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), keys.alias("keys"), _crossing_features(_lines(F.col(text)), most, buckets).alias("crossing"))
    rows = stage.put(rows, "rows")
    ours = Features(stage, docs, text, most, buckets, "docs", rows)
    theirs = Features(stage, target, target_text, most, buckets, "target")
    gain = gains(ours.counts(), theirs.counts(), buckets)
    known = ours.lines.select("h", "g", "times", F.col("n_words").cast("long").alias("w"), F.size("buckets").cast("long").alias("n"), _sum_of(F.col("buckets"), gain).alias("weight"))
    total = known.agg(F.sum("times")).first()[0] or 0
    places = rows.select("row", F.explode("keys").alias("k")).select("row", "k.h", "k.g")
    found = join_counted(places, known, ["h", "g"], "times", total).select("row", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "w", "n", "weight")
    own = rows.select("row", "doc_id", F.lit(0).cast("long").alias("w"), F.size("crossing").cast("long").alias("n"), _sum_of(F.col("crossing"), gain).alias("weight"))
    sums = own.unionByName(found).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("w").alias("n_words"), F.sum("n").alias("n_features"), F.sum("weight").alias("weight"))
    out = stage.put(sums, "weights")
    stage.drop("docs-lines", "target-lines", "rows")
    return out


def _least_drawn(scores: DataFrame, wanted: int) -> int | None:
    """A score that at least `wanted` rows reach, near the highest such one; None without rows."""
    ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    if ends["low"] is None:
        return None
    step = (ends["high"] - ends["low"]) // _STEPS + 1
    for part, n in sorted(((r[0], r[1]) for r in scores.groupBy(F.floor((F.col("score") - ends["low"]) / step)).count().collect()), reverse=True):
        wanted -= n
        if wanted <= 0:
            return ends["low"] + part * step
    return ends["low"]


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every document, those drawn with their rank from 1.

    Of the documents of at least `least_words` words, `percent` in a hundred with the highest scores are drawn. A
    histogram bounds the scores that can be drawn; only those are sorted, over many tasks, and each task's rows get
    their ranks from the numbers of rows of the tasks before it.
    """
    stage = Staging(docs.sparkSession, "draw")
    weights = weigh(docs, target, doc_id, text, target_text, most, buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((noise + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stage.put(weights.withColumn("score", score), "scored")
    fit = scored.filter(F.col("n_words") >= least_words)
    wanted = fit.count() * percent // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    least = _least_drawn(fit, wanted) if wanted else None
    unranked = lambda df: df.select(*columns, F.lit(None).cast("long").alias("rank"))
    if least is None:
        return unranked(scored)
    near = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    best = scored.filter(near)
    best = best.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    best = stage.put(best.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)}), "best")
    before, first = 0, []
    for r in sorted(best.groupBy("part").count().collect()):  # a row for each task
        first.append((r["part"], before))
        before += r["count"]
    offsets = docs.sparkSession.createDataFrame(first, "part long, before long")
    ranked = best.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("at") + 1)
    drawn = ranked.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return drawn.unionByName(unranked(scored.filter(~near)))
