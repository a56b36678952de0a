"""Toxicity scores by the nearest labelled examples under exact TF-IDF cosine.

Features are chosen from a bounded sample of labelled texts (SAMPLE rows of each label at most, about): the words
whose share of texts differs most between labels, by chi-square. Their inverse document frequencies are counted over
all texts. The examples' vectors stand in an inverted index whose lists are cut into blocks with their greatest
weight; a text's exact nearest examples are found from these bounds, block by block. They vote by similarity, and a
prior (the weighted share of label 1 among examples without features) votes with the weight PRIOR, so that a text
without evidence gets the prior as its score.

A null or empty text, or one without a feature, gets the prior. Labels other than 0 and 1 and null ids are not learnt
from. Ties go to the example with the smaller id. Rows are judged alone; repeated ids are kept. Ids may be of any type
that can be ordered; of several texts under one labelled id the first in order of the texts is learnt from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from yardspark.llm._words import pieces

#: Examples of each label that are read and indexed, about; the bound of the fitted sample.
SAMPLE = 2000
FEATURES, LEAST_FEATURES, CHI_SQUARE = 2000, 50, 25.0
NEIGHBOURS, PRIOR, BLOCK = 15, 0.25, 64
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text: runs of letters, digits and bytes beyond ASCII, with A-Z lower-cased."""
    return (text or "").encode().translate(_WORDS).split()


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether an id's label is not learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, label) of about `sample` examples of each label by a hash of the id, and how many rows each stands for."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("label"))
    total = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = {k: min(1.0, sample / n) for k, n in total.items()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    wanted = F.lit(False)
    for k, s in share.items():
        wanted = wanted | ((F.col("label") == k) & (draw < int(s * (1 << 20))))
    # the draw has about `sample` rows of each label; the bound holds on an uneven one too, and the same rows come again on a retry
    drawn = known.filter(wanted).dropDuplicates(["doc_id", "label"]).orderBy(draw, "doc_id", "label").limit(2 * sample * max(1, len(share)))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), {k: 1 / s for k, s in share.items()}


class Model:
    """Selected words with their weights, and the examples' block-max index."""

    def __init__(self, examples: list[tuple[int, str, int]], weight: dict[int, float], features: int = FEATURES, k: int = NEIGHBOURS, prior: float = PRIOR, kind: T.DataType | None = None):
        self.kind = kind or T.LongType()
        self.k, self.smooth, self.weight = k, prior, weight
        self.examples = sorted(examples)
        self.label = np.array([e[2] for e in self.examples], np.int64)
        self.ids = [e[0] for e in self.examples]
        self.counts = [Counter(words(e[1])) for e in self.examples]
        self.terms = self._select(features)
        self.number = {t: i for i, t in enumerate(self.terms)}

    def _select(self, most: int) -> list[bytes]:
        """Words by chi-square of presence against the label, the strongest first."""
        with_, n1 = (Counter(), Counter()), int(self.label.sum())
        n0 = len(self.label) - n1
        for c, y in zip(self.counts, self.label, strict=True):
            with_[y].update(c.keys())
        scored = []
        for t in with_[0].keys() | with_[1].keys():
            a, b = with_[1][t], with_[0][t]
            if a + b >= 3 and n0 and n1 and a + b < n0 + n1:
                d = a * (n0 - b) - b * (n1 - a)
                scored.append((-(n0 + n1) * d * d / ((a + b) * (n0 + n1 - a - b) * n0 * n1), t))
        scored.sort()
        return [t for i, (s, t) in enumerate(scored[:most]) if -s >= CHI_SQUARE or i < LEAST_FEATURES]

    def index(self, frequency: np.ndarray, n_docs: int) -> None:
        """Weights from the corpus's document frequencies, then the lists of examples by term."""
        self.idf = np.log((1 + n_docs) / (1 + frequency)) + 1
        rows = [self.vector(c) for c in self.counts]
        lists: dict[int, list[tuple[int, float]]] = {}
        bare = {0: 0.0, 1: 0.0}
        for e, (term, value) in enumerate(rows):
            if not len(term):
                bare[int(self.label[e])] += self.weight[int(self.label[e])]
            for t, v in zip(term.tolist(), value.tolist(), strict=True):
                lists.setdefault(t, []).append((e, v))
        total = {y: self.weight.get(y, 0.0) * float((self.label == y).sum()) for y in (0, 1)}
        whole = sum(total.values())
        base = total[1] / whole if whole else 0.0
        self.prior = (bare[1] + base) / (bare[0] + bare[1] + 1)  # smoothed by one row of the base rate
        self.lists = {t: (np.array([e for e, _ in p]), np.array([v for _, v in p])) for t, p in lists.items()}
        self.most = {t: np.maximum.reduceat(v, np.arange(0, len(v), BLOCK)) for t, (_, v) in self.lists.items()}
        self.blocks = -(-len(rows) // BLOCK)
        # bounds by block of example numbers, so that the terms' blocks line up
        self.bound = {}
        for t, (e, v) in self.lists.items():
            self.bound[t] = np.zeros(self.blocks)
            np.maximum.at(self.bound[t], e // BLOCK, v)
        self.counts, self.examples = [], []  # the texts are not sent to the workers

    def vector(self, counts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of length one."""
        term = np.array(sorted(self.number[t] for t in counts if t in self.number), np.int64)
        tf = np.array([counts[self.terms[t]] for t in term], float)
        value = (1 + np.log(tf)) * self.idf[term]
        return term, value / np.sqrt((value * value).sum()) if len(term) else value

    def nearest(self, term: np.ndarray, value: np.ndarray) -> list[tuple[float, int]]:
        """The k greatest cosines above 0 as (cosine, example), ties to the smaller example, by block bounds."""
        use = [(t, v) for t, v in zip(term.tolist(), value.tolist(), strict=True) if t in self.lists]
        if not use:
            return []
        bound = sum(v * self.bound[t] for t, v in use)
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or len(best) == self.k and bound[block] < best[-1][0] - 1e-12:
                break
            score = np.zeros(BLOCK)
            for t, v in use:
                e, w = self.lists[t]
                lo, hi = np.searchsorted(e, (block * BLOCK, (block + 1) * BLOCK))
                score[e[lo:hi] - block * BLOCK] += v * w[lo:hi]
            best += [(round(float(score[i]), 12), block * BLOCK + i) for i in np.flatnonzero(score > 0).tolist()]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[: self.k]
        return best

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """The share of weighted votes for label 1, and the ids of the examples that gave most of them."""
        known = Counter(filter(self.number.__contains__, words(text)))
        if not known:
            return self.prior, []
        best = self.nearest(*self.vector(known))
        votes = [(s * self.weight[int(self.label[e])], int(self.label[e])) for s, e in best]
        unit = self.smooth * min(self.weight.values())
        share = (sum(v for v, y in votes if y) + unit * self.prior) / (sum(v for v, _ in votes) + unit)
        return min(1.0, share), [self.ids[e] for _, e in best[:3]]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from a bounded sample of labels, with document frequencies over all of docs."""
    rows, weight = labelled(docs, labels, sample)
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # the same again when a task is run anew
    model = Model([(r["doc_id"], r["text"] or "", r["label"]) for r in rows.toLocalIterator()], weight, kind=docs.schema["doc_id"].dataType)
    sent = docs.sparkSession.sparkContext.broadcast(model.number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, n = sent.value, Counter(), 0
        for batch in pieces(batches):
            for x in batch.column(0).to_pylist():
                n += 1
                total.update(known.keys() & set(words(x)))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *(known[t] for t in total)], pa.int64()), pa.array([n, *total.values()], pa.int64())], names=["term", "n"])

    got = {r[0]: r[1] for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect()}
    model.index(np.array([got.get(i, 0) for i in range(len(model.terms))], float), got.get(-1, 0))
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1), predicted (1 from 0.5) and evidence (ids of up to three nearest examples)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted", "evidence")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(model.kind))])
    at, kind = docs.columns.index(text), pa.list_(to_arrow_type(model.kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        for batch in pieces(batches):
            said = [judge.score(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in said], pa.float64()), pa.array([int(s >= 0.5) for s, _ in said], pa.int32()), pa.array([e for _, e in said], kind)], names=schema.names)

    return docs.mapInArrow(run, schema)
