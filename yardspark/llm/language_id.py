"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (one to three letters, blanks marking word ends) by rank. A text
gets the language whose profile has the least out-of-place distance: the sum over the text's own n-grams of the
difference of ranks, and of the profile's length where an n-gram is absent. Ties go to the alphabetically first
language. A null text or one without a letter gets `und` and score 0. Any id, also null or repeated, is kept; each row
is judged alone. Without training rows every text gets `und`, and an empty table gives an empty one. Columns named like
an output are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardspark.llm._words import pieces

UNKNOWN = "und"
#: n-grams in a profile.
PROFILE = 400
#: About so many training documents of each language are read; the bound of the fitted sample.
SAMPLE = 3000
#: Bits of a letter's code point in the number of an n-gram; no letter needs more.
_BITS = 20
_tables: list[np.ndarray] = []


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether an id is not learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def _letter_codes() -> np.ndarray:
    """The code point of each letter, 0 for other signs."""
    if not _tables:
        table = np.zeros(0x110000, np.int64)
        letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
        table[letters] = letters
        _tables.append(table)
    return _tables[0]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as ascending numbers, and their counts; none without a letter."""
    code = _letter_codes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    code = np.concatenate((np.zeros(1, np.int64), code, np.zeros(1, np.int64)))
    code = code[np.concatenate((code[:-1] + code[1:] > 0, code[-1:] >= 0))]
    if len(code) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = code[:-1] << _BITS | code[1:]
    three = two[:-1] << _BITS | code[2:]
    return np.unique(np.concatenate((code[code > 0], two | 1 << (3 * _BITS), three[code[1:-1] > 0] | 1 << (3 * _BITS + 1))), return_counts=True)


def top_ngrams(text: str, size: int = PROFILE) -> np.ndarray:
    """A text's most frequent n-grams by descending count, ties by number."""
    gram, n = ngram_counts(text)
    if len(gram) > size:  # counts above the last one that gets in, and as many of the last as there is room for
        least = np.partition(n, len(n) - size)[len(n) - size]
        last = np.flatnonzero(n == least)[: size - int((n > least).sum())]
        keep = n > least
        keep[last] = True
        gram, n = gram[keep], n[keep]
    return gram[np.argsort(-n, kind="stable")]


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from about `sample` whole texts of each language, taken by a hash of the key; size x languages numbers reach the driver."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = {r[0]: min(1.0, sample / r[1]) for r in rows.groupBy(lang).count().collect()}
    if not share:
        return {}
    bound = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 20)))])
    rows = rows.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < bound[F.col(lang)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], int] = {}
        for batch in pieces(batches):
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for g, n in zip(*(x.tolist() for x in ngram_counts(words)), strict=True):
                    total[name, g] = total.get((name, g), 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"])

    grams = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, gram long, n long")
    ranked = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = ranked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= size)
    out: dict[str, list[int]] = {name: [] for name in sorted(share)}
    for r in sorted(best.collect(), key=lambda r: r["r"]):
        out[r["lang"]].append(r["gram"])
    return {k: v for k, v in out.items() if v}


class Judge:
    """Out-of-place distances of texts to profiles."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for v in profiles.values() for g in v], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[name], np.int64)), j] = np.arange(len(profiles[name]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        gram = top_ngrams(text or "", self.size)
        if not len(gram) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, gram)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != gram] = len(self.grams)
        rank = self.ranks[at]
        apart = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(gram))[:, None])).sum(0)
        best = int(np.argmin(apart))
        return self.names[best], 1.0 - float(apart[best]) / (self.size * len(gram))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score (0 to 1: 1 less the distance over the greatest possible one)."""
    judge = docs.sparkSession.sparkContext.broadcast(profiles)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = Judge(judge.value, size)
        for batch in pieces(batches):
            said = [decide(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
