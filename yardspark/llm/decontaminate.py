"""Benchmark decontamination: rare n-gram seeds find test items in documents, Smith-Waterman alignment scores them.

Seeds are word n-grams of the items (of SEED words; a shorter item is one seed), and every seed is searched. Where a
document has enough seed hits of one item, they become windows of the text that hold every alignment through them.
Edits can break every seed of a copy that still scores high, so single words are searched too: an alignment with fewer
hits that reaches the threshold matches at least `least_matched` of the item's words, hence some of its rarer ones
(document frequencies are counted over all texts), and texts that hold enough of these are windows where enough of the
item's words stand together. Every window is aligned with the item word by word; the score is the alignment's share of
the item's perfect score. What is passed over cannot reach the threshold, so the findings are those of aligning each
item with each whole text.

Words are runs outside space and 0x09-0x0D, with case folded; ASCII punctuation counts as space. Null or empty texts and items match
nothing. Rows are judged alone: a repeated document or item gives repeated findings, which are merged by id, also by a
null id of documents; items without an id are not searched. Of equal scores the earlier window counts. An empty table
gives an empty result; columns named like an output are not read. An item with fewer than MIN_WORDS words is too short to
be evidence and is not searched.

The items' words are broadcast while they keep to BROADCAST_WORDS; beyond that items are dealt into parts that each
keep to it, and the documents are read once for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from yardspark.llm._staging import Staging
from yardspark.llm._words import pieces, shingles, slices, words

SEED, MIN_WORDS = 3, 6
BROADCAST_WORDS = 4_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_PUNCTUATION = bytes(b if chr(b).isalnum() or b >= 128 or b in b"\t\n\x0b\x0c\r " else 32 for b in range(256))


def bare(raw: bytes) -> bytes:
    """The text with ASCII punctuation as spaces and case folded beyond A-Z, which `words` lowers."""
    return (raw if raw.isascii() else raw.decode(errors="replace").casefold().encode()).translate(_PUNCTUATION)


def item_words(items: list[tuple]) -> tuple[list, dict[int, np.ndarray]]:
    """(ids, word hashes by place in the ids) of the items that are long enough and have an id."""
    kept = [(key, code) for key, text in items if key is not None and len(code := words([bare((text or "").encode())])[0]) >= MIN_WORDS]
    return [key for key, _ in kept], {i: code for i, (_, code) in enumerate(kept)}


class Seeds:
    """The seeds of all items as a sorted table, with the (item, offset) places of each."""

    def __init__(self, items: dict[int, np.ndarray], n: int = SEED):
        places = []
        for key in sorted(items):
            code, at = shingles(items[key], np.zeros(len(items[key]), np.int64), n)
            places.append((code, np.full(len(code), key), at))
        self.code, self.item, self.at = (np.concatenate(x) if places else np.empty(0, np.int64) for x in (zip(*places, strict=True) if places else ((), (), ())))
        self.n, self.code = n, self.code.astype(np.uint64)
        self._index(np.lexsort((self.at, self.item, self.code)))

    def _index(self, take: np.ndarray) -> None:
        self.code, self.item, self.at = self.code[take], self.item[take], self.at[take]
        self.unique, self.first, self.count = np.unique(self.code, return_index=True, return_counts=True)
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(self.unique >> np.uint64(44)).astype(np.int64)] = True

    def places(self, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the hit, place) of every place of the hit seeds."""
        spread = np.repeat(np.arange(len(seed)), self.count[seed])
        return spread, self.first[seed][spread] + np.arange(len(spread)) - np.repeat(np.cumsum(self.count[seed]) - self.count[seed], self.count[seed])

    def hits(self, code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, index of the word in all texts, number of the seed) of each hit in the words of some texts."""
        hashed, first = shingles(code, owner, self.n)
        some = np.flatnonzero(self.quick[(hashed >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.unique, hashed[some])
        good = at < len(self.unique)
        good[good] = self.unique[at[good]] == hashed[some][good]
        word = first[some[good]]
        return owner[word], word, at[good]

    def keep_rarest(self, frequency: np.ndarray, keep: np.ndarray) -> None:
        """Leaves the keep[item] rarest places of each item, ties by offset."""
        order = np.lexsort((self.at, np.repeat(frequency, self.count), self.item))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(self.item[order], self.item[order], "left")
        self._index(np.flatnonzero(rank < keep[self.item.astype(np.int64)]))


def least_matched(length: int, threshold: float, min_hits: int) -> int:
    """The fewest words of an item that an alignment at the threshold with under min_hits intact seeds matches.

    m matched words in r runs hold at least m - (SEED - 1) r seeds, and there is an edit between two runs, so the score
    is at most MATCH m + GAP (r - 1).
    """
    full = threshold * MATCH * length
    r = lambda m: max(1, -(-(m - max(0, min_hits - 1)) // (SEED - 1)))
    return next((m for m in range(1, length + 1) if MATCH * m + GAP * (r(m) - 1) >= full - 1e-9), length + 1)


def reach(length: int, threshold: float) -> int:
    """The most words of a text that an alignment at the threshold covers: its words and as many added as its score bears."""
    return length + int(max(0.0, 1 - threshold) * MATCH * length) // -GAP


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: (best local score, first word, word after) within the window, by rows of the item."""
    columns = np.arange(1, len(window) + 1)
    before, start = np.zeros(len(window) + 1, np.int64), np.arange(len(window) + 1)
    best = (0, 0, 0)
    for word in item:
        gain = np.where(window == word, MATCH, MISMATCH)
        cross, up = before[:-1] + gain, before[1:] + GAP
        value, origin = np.where(cross >= up, cross, up), np.where(cross >= up, start[:-1], start[1:])
        fresh = value <= 0
        value, origin = np.where(fresh, 0, value), np.where(fresh, columns, origin)
        # a gap along the row costs GAP a word: the running maximum of value - GAP * column
        lifted = value - GAP * columns
        source = np.maximum.accumulate(np.where(lifted == np.maximum.accumulate(lifted), np.arange(len(lifted)), 0))
        moved = lifted[source] + GAP * columns
        value, origin = np.where(moved > value, moved, value), np.where(moved > value, origin[source], origin)
        before, start = np.concatenate(([0], value)), np.concatenate(([0], origin))
        at = int(np.argmax(value))
        if value[at] > best[0]:
            best = (int(value[at]), int(origin[at]), at + 1)
    return best


def windows(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint spans of words that cover all the given ones."""
    spans: list[list[int]] = []
    for low, high in sorted(zip(begin.tolist(), end.tolist(), strict=True)):
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    return [(a, b) for a, b in spans]


def best_alignment(query: np.ndarray, distinct: np.ndarray, times: np.ndarray, text: np.ndarray, starts: np.ndarray, matched: int, threshold: float) -> tuple[float, int, int]:
    """(score, first word, word after) of the item's best alignment at the threshold, else a score of 0.

    distinct, times: the item's words in ascending order and how often it has each.
    starts: where the item begins by each seed hit. matched: the words that an alignment elsewhere matches at least.
    """
    far, which = reach(len(query), threshold), np.minimum(np.searchsorted(distinct, text), len(distinct) - 1)
    inside = np.flatnonzero(distinct[which] == text)
    dense = inside[: max(0, len(inside) - matched + 1)]
    dense = dense[inside[matched - 1 :] - dense < far]
    if not len(starts) and not len(dense):
        return 0.0, 0, 0
    begin, end = np.concatenate((starts - (far - len(query)), dense)), np.concatenate((starts, dense)) + far
    best = (0.0, 0, 0)
    for low, high in windows(np.maximum(begin, 0), np.minimum(end, len(text))):
        first, last = np.searchsorted(inside, [low, high])
        shared = np.minimum(np.bincount(which[inside[first:last]], minlength=len(distinct)), times).sum()
        if shared < threshold * len(query) - 1e-9:
            continue
        got, a, b = align(query, text[low:high])
        if (share := got / (MATCH * len(query))) > best[0]:
            best = (share, low + a, low + b)
    return best if best[0] >= threshold else (0.0, 0, 0)


def _parts(benchmark: DataFrame, item_id: str, item_text: str) -> list[DataFrame]:
    """The benchmark in parts that each keep to BROADCAST_WORDS words, about."""
    size = benchmark.agg(F.sum(F.size(F.split(F.coalesce(item_text, F.lit("")), r"\s+")))).first()[0] or 0
    n = max(1, -(-size // BROADCAST_WORDS))
    return [benchmark.filter(F.pmod(F.xxhash64(item_id, item_text), F.lit(n)) == i) for i in range(n)] if n > 1 else [benchmark]


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_hits: int = 2, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of each leaked item: the best window at or above the threshold.

    min_hits: seed hits of an item from which a document is aligned around them; with fewer it is aligned where enough
    single words of the item stand together, so that no leak is lost. Several parts of a benchmark are searched one
    after the other, and what one needs on the driver and the workers goes before the next.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts, out, stage = _parts(benchmark, item_id, item_text), None, Staging(docs.sparkSession, "leaks")
    for i, part in enumerate(parts):
        search = Search(rows, part.select(item_id, item_text), threshold, min_hits)
        found = search.leaks(rows, benchmark.schema[item_id].dataType)
        if len(parts) > 1:
            found = stage.put(found, f"part{i}")
            search.release()
        out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("score", "first_word", "last_word"), F.struct("score", -F.col("first_word"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.first_word", "b.last_word")


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_hits: int = 2, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold a leaked item. Each row is judged by its own text, whatever its id; nothing is shuffled."""
    parts, stage = _parts(benchmark, item_id, item_text), Staging(docs.sparkSession, "clean")
    for i, part in enumerate(parts):
        search = Search(docs.select(F.col(text).alias("text")), part.select(item_id, item_text), threshold, min_hits)
        docs = search.without_leaks(docs, text)
        if len(parts) > 1:
            docs = stage.put(docs, f"part{i}")
            search.release()
    return docs


class Search:
    """Seeds of some items with what the texts' word frequencies make of them, as broadcasts, and the steps that use them."""

    def __init__(self, docs: DataFrame, items: DataFrame, threshold: float, min_hits: int):
        sc, self.threshold, self.min_hits = docs.sparkSession.sparkContext, threshold, min_hits
        self.keys, codes = item_words([(r[0], r[1]) for r in items.toLocalIterator()])
        single = Seeds(codes, 1)
        counting = sc.broadcast(single)
        frequency = self._frequencies(docs, counting, len(single.unique))
        counting.unpersist()
        # of the rarer words an alignment misses at most as many as of all words
        matched = np.array([least_matched(len(x), threshold, min_hits) for x in codes.values()], np.int64)
        length = np.array([len(x) for x in codes.values()], np.int64)
        keep = np.maximum(-(-length // 2), length - matched + 1)
        single.keep_rarest(frequency, keep)
        distinct = {i: np.unique(x, return_counts=True) for i, x in codes.items()}
        self.sent = sc.broadcast((codes, Seeds(codes), single, matched, matched - (length - keep), distinct))

    def release(self) -> None:
        self.sent.unpersist()

    @staticmethod
    def _frequencies(docs: DataFrame, sent, n: int) -> np.ndarray:
        """In how many texts each distinct word of the items stands."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = sent.value
            total = np.zeros(len(table.unique), np.int64)
            for batch in batches:
                for _, raw in slices(batch.column(0)):
                    code, owner, _, _ = words([bare(t) for t in raw])
                    doc, _, seed = table.hits(code, owner)
                    pairs = np.unique(doc * np.int64(len(table.unique) + 1) + seed)
                    total += np.bincount(pairs % (len(table.unique) + 1), minlength=len(total))[: len(total)]
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["seed", "n"])

        counted = docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
        frequency = np.zeros(n, np.int64)
        frequency[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
        return frequency

    def _finder(self):
        """The function that gives (text number, item, score, first word, word after) of every leak in some texts."""
        sent, min_hits, threshold = self.sent, self.min_hits, self.threshold

        def pairs_of(code: np.ndarray, owner: np.ndarray) -> tuple[dict[tuple[int, int], np.ndarray], set[tuple[int, int]]]:
            """The item's starts by seed hits for each (text, item) with enough of them; those with enough of the rarer words."""
            items, table, few, _, needed, _ = sent.value
            doc, word, seed = table.hits(code, owner)
            spread, place = table.places(seed)
            d, item, start = doc[spread], table.item[place], word[spread] - np.searchsorted(owner, doc)[spread] - table.at[place]
            order = np.lexsort((start, item, d))
            d, item, start = d[order], item[order], start[order]
            edge = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (item[1:] != item[:-1])))) if len(d) else np.empty(0, int)
            near = {(int(d[s]), int(item[s])): start[s:e] for s, e in zip(edge, np.append(edge, len(d))[1:], strict=True) if e - s >= min_hits}
            doc, _, seed = few.hits(code, owner)
            doc, seed = np.divmod(np.unique(doc * np.int64(len(few.unique) + 1) + seed), len(few.unique) + 1)
            spread, place = few.places(seed)
            pair, n = np.unique(doc[spread] * np.int64(len(items) + 1) + few.item[place], return_counts=True)
            d, item = np.divmod(pair, len(items) + 1)
            some = n >= needed[item]
            return near, set(zip(d[some].tolist(), item[some].tolist(), strict=True))

        def find(raw: list[bytes]) -> Iterator[tuple]:
            items, _, _, matched, _, distinct = sent.value
            none = np.empty(0, np.int64)
            code, owner, _, _ = words([bare(t) for t in raw])
            begin = np.searchsorted(owner, np.arange(len(raw) + 1))
            near, more = pairs_of(code, owner)
            for i, k in sorted(near.keys() | more):
                least = int(matched[k]) if (i, k) in more else len(items[k]) + len(code)
                best = best_alignment(items[k], *distinct[k], code[begin[i] : begin[i + 1]], near.get((i, k), none), least, threshold)
                if best[0]:
                    yield (i, k, *best)

        return find

    def leaks(self, rows: DataFrame, item_kind: T.DataType) -> DataFrame:
        """rows: doc_id, text."""
        find, keys = self._finder(), self.keys
        schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("item_id", item_kind), *[T.StructField(c, k()) for c, k in (("score", T.DoubleType), ("first_word", T.LongType), ("last_word", T.LongType))]])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(first + i, *x) for first, raw in slices(batch.column(1)) for i, *x in find(raw)]
                columns = [pa.array([x[c] for x in out], t) for c, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in out], pa.int64())), pa.array([keys[x[1]] for x in out], item_type), *columns], names=schema.names)

        item_type = to_arrow_type(schema["item_id"].dataType)
        return rows.mapInArrow(score, schema)

    def without_leaks(self, docs: DataFrame, text: str) -> DataFrame:
        find, at = self._finder(), docs.columns.index(text)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                keep = np.ones(batch.num_rows, bool)
                for first, raw in slices(batch.column(at)):
                    keep[[first + x[0] for x in find(raw)]] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(clean, docs.schema)
