"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

Words outside the vocabulary are encoded by Spark's higher-order functions, which fold ranked merges over their byte
arrays with a literal table of ranks. Distinct words that are frequent in a bounded sample of texts (at most FREQUENT
of them, so the broadcast is bounded) are folded once; all others are folded within their documents, once for each
distinct word of a document, so the sample only saves work. No text is shuffled. Decoding concatenates the ids' binary
pieces.

A null or empty text has no ids. Every row is encoded alone, with any id, also null or repeated; columns named like an
output are replaced. Texts are encoded whole, of any length.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardspark.llm._pretokens import Chunks, Table, gather, letters, segments, splitter
from yardspark.llm._staging import Staging
from yardspark.llm._words import pieces, slices

#: Most words whose ids are broadcast.
FREQUENT = 1 << 18
#: Bytes of a word beyond which it is merged with a heap, as a fold takes time with the square of the length.
LONG = 128
#: About so many texts, and no more than this part of them, are sampled by a hash for the frequent words.
SAMPLE, PART = 1 << 15, 1 / 8
#: Files of the sample's words: these are few bytes, which would else be folded in one task.
FOLDING = 32
#: Chunks that a task remembers.
MEMORY = 200_000
#: Distinct chunks that a task counts before it passes the counts on.
FLUSH = 200_000
#: Ids from here on stand for the words of a document that are still to be folded.
_OPEN = 1 << 31
#: Bits of an id within a table entry, and all of them set.
_BITS = 20
_MASK = (1 << _BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The two ids from which ranked merging makes each id; a merged pair's rank is the id it makes."""
    out: dict[tuple[int, int], int] = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out[ranks[parts[0]], ranks[parts[1]]] = rank
    return out


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by ranked merging with a heap, in time n log n."""
    cut = [*range(1, len(word) + 1), len(word)]  # where the part that begins at i ends; -1: no part begins there
    before = [*range(-1, len(word))]
    pair = lambda i: ranks.get(word[i : cut[cut[i]]]) if cut[i] < len(word) else None
    heap = [(r, i, cut[cut[i]]) for i in range(len(word)) if (r := pair(i)) is not None]
    heapify(heap)
    while heap:
        rank, i, end = heappop(heap)
        if cut[i] < 0 or cut[i] >= len(word) or cut[cut[i]] != end:
            continue
        gone = cut[i]
        cut[i], cut[gone] = end, -1
        if end < len(word):
            before[end] = i
        for j in (before[i], i):
            if j >= 0 and (r := pair(j)) is not None:
                heappush(heap, (r, j, cut[cut[j]]))
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i : cut[i]]])
        i = cut[i]
    return out


def merge_table(pairs: dict[tuple[int, int], int]) -> tuple[list[int], list[int]]:
    """(places, entries): the pair (a, b) stands in entries[places[a] + b] as a + 1 << 40 | id << 20, if it merges.

    The partners of each left id are laid into one array where they fit first, those with most partners first. An entry
    names its left id, so a pair that does not merge finds another's entry or an empty one, 0.
    """
    partners: dict[int, list[tuple[int, int]]] = {}
    for (a, b), rank in pairs.items():
        partners.setdefault(a, []).append((b, rank))
    ids = 256 + max(map(max, pairs), default=0) + max(pairs.values(), default=0)
    used = np.zeros(2 * ids + 4 * len(pairs), bool)
    entries, places, at, before = np.zeros(len(used), np.int64), [0] * ids, 0, 0
    for a in sorted(partners, key=lambda a: (-len(partners[a]), a)):
        bs = np.array([b for b, _ in partners[a]])
        if len(bs) != before:  # as many partners as before do not fit earlier, mostly
            at, before = 0, len(bs)
        at = max(at, int(np.argmin(used)) - int(bs.min()))
        while True:
            tried = np.arange(at, at + 512)
            if (at + 512 + int(bs.max())) >= len(used):
                used, entries = np.append(used, np.zeros(ids, bool)), np.append(entries, np.zeros(ids, np.int64))
            if len(fits := tried[~used[tried[:, None] + bs].any(1)]):
                break
            at += 512
        at = places[a] = int(fits[0])
        used[places[a] + bs] = True
        entries[places[a] + bs] = ((a + 1) << 2 * _BITS) | (np.array([r for _, r in partners[a]], np.int64) << _BITS)
    return places, entries[: max(places) + ids].tolist()


def _numbers(values: list[int], kind: str) -> Column:
    """A literal array, folded from one string."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold_merges(words: Column, ranks: dict[bytes, int], table: tuple[list[int], list[int]]) -> Column:
    """The ids (array<array<int>>) of words given as arrays of their byte values, by ranked merging.

    The state holds a number for each part: the rank at which it merges with the next part, then its id; without such a
    merge the number is at least `none`. The least number is the next merge, the leftmost of equal ones comes first, and
    only its neighbours get new ranks. The literal tables are bound once, outside the fold.
    """
    mask, none, last = F.lit(_MASK), F.lit(1 << 2 * _BITS), F.lit(1 << 3 * _BITS)

    def fold(word: Column, single: Column, places: Column, entries: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            """A part's number; null without a next part b. An entry of another left id leaves bits above its rank."""
            return F.get(entries, F.get(places, a) + b).bitwiseXOR(a * F.lit((1 << 2 * _BITS) + 1) + F.lit(1 << 2 * _BITS))

        def merged(parts: Column, new: Column, at: Column) -> Column:
            tail = F.coalesce(part(new, F.get(parts, at + 1).bitwiseAND(mask)), new + last)
            rest = F.slice(parts, at + 2, F.size(parts))
            head = F.concat(F.slice(parts, F.lit(1), at - 2), F.array(part(F.get(parts, at - 2).bitwiseAND(mask), new), tail), rest)
            return F.when(at > 1, head).otherwise(F.concat(F.array(tail), rest))

        def step(parts: Column, _: Column) -> Column:
            return _let(F.array_min(parts), lambda best: F.when(best >= none, parts).otherwise(_let(F.array_position(parts, best).cast("int"), lambda at: merged(parts, F.shiftright(best, _BITS), at))))

        ids = F.transform(word, lambda b: F.get(single, b))
        start = _let(ids, lambda i: F.transform(i, lambda a, at: F.coalesce(part(a, F.get(i, at + 1)), a + last)))
        return F.transform(F.aggregate(F.slice(word, F.lit(2), F.size(word)), start, step), lambda x: x.bitwiseAND(mask).cast("int"))

    single, places, entries = ([ranks[bytes([b])] for b in range(256)], *table)
    bound = lambda values, then: _let(_numbers(values, "bigint"), then)
    return bound(entries, lambda e: bound(places, lambda p: bound(single, lambda s: F.transform(words, lambda w: fold(w, s, p, e)))))


def word_counts(docs: DataFrame, ranks, split_pattern: str, text: str = "text") -> DataFrame:
    """(word, n): the distinct pretokens of the texts that are not in the vocabulary. ranks: a broadcast."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = splitter(split_pattern), ranks.value

        def out(seen: Counter) -> pa.RecordBatch:
            words: Counter = Counter()
            for chunk, n in seen.items():
                for w in [chunk] if letters(chunk) else [w.encode() for w in split(chunk.decode())]:
                    if len(w) <= LONG and w not in known:
                        words[w] += n
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                found = Chunks([part for t in texts for part in segments(t)])
                for chunk, n in zip(found.take(np.arange(len(found.code))), np.bincount(found.number, minlength=len(found.code)).tolist(), strict=True):
                    seen[chunk] += n
                if len(seen) > FLUSH:
                    yield out(seen)
                    seen.clear()
        yield out(seen)

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, ranks: dict[bytes, int], table, most: int = FREQUENT) -> pa.Table:
    """The most frequent words, at most `most` of them, with their ids: those above the least count that keeps to the bound."""
    top = F.least("n", F.lit(10_000))
    least, left = 10_001, most
    for r in sorted(counts.groupBy(top.alias("c")).count().collect(), reverse=True):
        left -= r[1]
        if left < 0:
            break
        least = r[0]
    word = F.encode("word", "UTF-8")
    return counts.filter(F.col("n") >= max(2, least)).select(word.alias("word"), F.get(fold_merges(F.array(byte_values(word)), ranks, table), F.lit(0)).alias("ids")).toArrow()


def known_chunks(words: pa.Table, ranks: dict[bytes, int]) -> Table:
    """The ids of the vocabulary's entries and of the given words, where they are runs of letters and so whole chunks."""
    own = [(t, i) for t, i in ranks.items() if letters(t)]
    taken = [Chunks.of([t for t, _ in own])]
    size, flat = [np.ones(len(own), np.int64)], [np.array([i for _, i in own], "<u4")]
    for batch in words.to_batches(max_chunksize=1 << 14):  # a little at a time, as the driver has other tables too
        taken.append(Chunks.of(batch.column(0).to_pylist()))
        size.append(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        flat.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<u4"))
    return Table(np.concatenate([x.code for x in taken]), np.concatenate([x.check for x in taken]), np.concatenate(size), np.concatenate(flat))


class Pieces:
    """The bytes of every id, in one flat array."""

    def __init__(self, ranks: dict[bytes, int]):
        named = {i: t for t, i in ranks.items()}
        self.size = np.zeros(max(named, default=0) + 1, np.int64)
        self.size[list(named)] = [len(t) for t in named.values()]
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(named[i] for i in sorted(named)), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all the ids' pieces, where each piece ends)."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return gather(self.flat, self.start[ids], size), ends


def byte_values(word: Column) -> Column:
    """A binary as the array of its byte values."""
    return F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.conv(F.hex(F.substring(word, i, F.lit(1))), 16, 10).cast("int"))


def _joined(parts: Column, places: Column, words: Column) -> Column:
    """The parts (array<binary>) in order, each but the last followed by the word that stands at its place."""
    each = _let(words, lambda w: F.zip_with(parts, places, lambda p, i: F.when(i.isNull(), p).otherwise(F.concat(p, F.get(w, i)))))
    return F.array_join(each.cast("array<string>"), "").cast("binary")


def encode(docs: DataFrame, vocabulary: str, split_pattern: str, text: str = "text", frequent: int = FREQUENT, sample: int = SAMPLE, part: float = PART, decoded: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with `ids`, the text's token ids as little-endian unsigned 32-bit integers, and n_tokens.

    decoded: also the bytes to which the ids decode, as decode() gives them. keep_text: whether the text stays.
    """
    spark, ranks = docs.sparkSession, read_ranks(vocabulary)
    table, sent = merge_table(merges(ranks)), spark.sparkContext.broadcast(ranks)
    share = int(min(part, sample / max(1, docs.count())) * (1 << 20))
    drawn = docs.filter(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < share)
    stage = Staging(spark, "byte_bpe")
    # written in many files, so that folding them is many tasks, without an exchange in a plan that holds the tables
    counts = stage.put(word_counts(drawn, sent, split_pattern, text).repartition(FOLDING), "words")
    common = spark.sparkContext.broadcast(known_chunks(frequent_words(counts, ranks, table, frequent), ranks))
    stage.drop("words")
    docs = docs.drop("ids", "n_tokens", *["decoded"] * decoded)
    at = docs.columns.index(text)
    own = [i for i, f in enumerate(docs.schema.fields) if keep_text or i != at]
    binaries, one = T.ArrayType(T.BinaryType()), T.ArrayType(T.IntegerType())
    # the columns of docs travel under names that clash with nothing
    kept = [T.StructField(f"c{i}", docs.schema.fields[i].dataType) for i in own]
    parts = T.StructType([*kept, T.StructField("ids", binaries), T.StructField("pieces", binaries), T.StructField("places", one), T.StructField("open", T.ArrayType(one))])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known, common_ids = splitter(split_pattern), sent.value, common.value
        piece = Pieces(known) if decoded else None
        memory = Table.empty()  # what this task has resolved; idle workers hold nothing
        of = lambda values, ends, kind: pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])

        def resolve(new: list[bytes]) -> tuple[list[bytes], list[bytes], np.ndarray]:
            """(the chunks' ids, words still to be folded, which open ids stand for, which chunks have none of these)."""
            ids, opened, closed = [], {}, np.ones(len(new), bool)
            for k, c in enumerate(new):
                out = []
                for w in (c,) if letters(c) else [x.encode() for x in split(c.decode())]:
                    if (i := known.get(w)) is not None:
                        out.append(i.to_bytes(4, "little"))
                    elif len(w) > LONG:
                        out.append(np.array(merge_long(w, known), "<u4").tobytes())
                    else:
                        out.append((_OPEN + opened.setdefault(w, len(opened))).to_bytes(4, "little"))
                        closed[k] = False
                ids.append(b"".join(out))
            return ids, list(opened), closed

        def run(rows: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            nonlocal memory
            cut = [(i, part) for i, t in enumerate(texts) for part in segments(t)]
            found = Chunks([part for _, part in cut])
            if len(memory.code) > MEMORY:
                memory = Table.empty()
            size, parts_of = np.zeros(len(found.code), np.int64), []
            left = np.arange(len(found.code))
            for source in (common_ids, memory):
                at = source.find(found.code[left], found.check[left])
                hit = at >= 0
                size[left[hit]] = source.size[at[hit]]
                parts_of.append((left[hit], gather(source.flat, source.start[at[hit]], source.size[at[hit]])))
                left = left[~hit]
            each, opened, closed = resolve(found.take(left))
            size[left] = n = np.array([len(x) >> 2 for x in each], np.int64)
            fresh_ids = np.frombuffer(b"".join(each), "<u4")
            parts_of.append((left, fresh_ids))
            closed &= found.end[left] - found.start[left] < 64
            kept = left[closed]
            memory = memory.with_more(found.code[kept], found.check[kept], n[closed], gather(fresh_ids, (np.cumsum(n) - n)[closed], n[closed]))
            begin = np.cumsum(size) - size
            flat = np.empty(int(size.sum()), "<u4")
            for which, values in parts_of:
                flat[np.repeat(begin[which] - (np.cumsum(size[which]) - size[which]), size[which]) + np.arange(len(values))] = values
            number, per_part = found.number, found.per_text
            n = size[number]
            ids = gather(flat, begin[number], n)
            ends = np.cumsum(np.bincount(np.repeat(np.array([i for i, _ in cut]), per_part), n, minlength=len(texts)).astype(np.int64))
            is_open = ids >= _OPEN
            where = np.flatnonzero(is_open)
            # parts end at open words and at the ends of texts, in this order
            order = np.argsort(np.concatenate((2 * where, 2 * ends - 1)), kind="stable")
            closed = np.concatenate(([0], np.cumsum(~is_open)))
            stops = np.concatenate(([0], np.concatenate((closed[where], closed[ends]))[order]))
            known_ids = ids[~is_open]
            doc = np.searchsorted(ends, where, "right")
            per = np.bincount(doc, minlength=len(texts))
            outer = np.concatenate(([0], np.cumsum(per + 1))).astype(np.int32)
            columns = [rows.column(i) for i in own]
            columns.append(pa.ListArray.from_arrays(outer, of(known_ids, 4 * stops, pa.binary())))
            if decoded:
                flat, piece_ends = piece.join(known_ids)
                columns.append(pa.ListArray.from_arrays(outer, of(flat, np.concatenate(([0], piece_ends))[stops], pa.binary())))
            else:
                columns.append(pa.nulls(len(texts), pa.list_(pa.binary())))
            # each text's distinct open words, and which of them stands at each place
            pair, place = np.unique(doc * np.int64(len(opened) + 1) + (ids[where] - np.uint32(_OPEN)).astype(np.int64), return_inverse=True)
            home, word = np.divmod(pair, len(opened) + 1)
            first = np.searchsorted(home, np.arange(len(texts) + 1)).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(per))).astype(np.int32), pa.array((place - first[doc]).astype(np.int32))))
            size = np.array([len(w) for w in opened], np.int64)
            start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(opened), np.uint8)
            inner = np.concatenate(([0], np.cumsum(size[word]))) if len(word) else np.zeros(1, np.int64)
            values = flat[np.repeat(start[word] - inner[:-1], size[word]) + np.arange(inner[-1])] if len(word) else flat[:0]
            columns.append(pa.ListArray.from_arrays(first, pa.ListArray.from_arrays(inner.astype(np.int32), pa.array(values.astype(np.int32)))))
            return pa.RecordBatch.from_arrays(columns, names=parts.names)

        for batch in batches:
            for first, texts in slices(batch.column(at)):
                yield run(batch.slice(first, len(texts)), texts)

    found = docs.mapInArrow(look_up, parts).withColumn("folded", fold_merges(F.col("open"), ranks, table))
    little = lambda i: F.lpad(F.hex(i.cast("long").bitwiseAND(F.lit(255)) * F.lit(1 << 24) + F.shiftright(i, 8).cast("long").bitwiseAND(F.lit(255)) * F.lit(1 << 16) + F.shiftright(i, 16).cast("long") * F.lit(1 << 8)), 8, "0")
    four = F.transform("folded", lambda w: F.unhex(F.array_join(F.transform(w, little), "")))
    made = {"ids": _joined(F.col("ids"), F.col("places"), four)}
    if decoded:
        spelt = [""] * (1 + max(ranks.values(), default=0))
        for t, i in ranks.items():
            spelt[i] = t.hex()
        said = _let(F.split(F.lit(",".join(spelt)), ","), lambda p: F.transform("folded", lambda w: F.unhex(F.array_join(F.transform(w, lambda i: F.get(p, i)), ""))))
        made["decoded"] = _joined(F.col("pieces"), F.col("places"), said)
    out = found.select(*[F.col(f"c{i}") for i in own], *[c.alias(k) for k, c in made.items()])
    renamed = [F.col(f"c{i}").alias(docs.columns[i]) for i in own]
    return out.select(*renamed, "ids", F.shiftright(F.octet_length("ids"), 2).cast("long").alias("n_tokens"), *["decoded"] * decoded)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """encoded with `decoded`: the bytes of its ids' pieces, in order. Null ids decode to nothing."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    encoded = encoded.drop("decoded")
    schema, at = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]), encoded.columns.index(ids)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = Pieces(ranks.value)
        for batch in batches:
            for rows in pieces([batch]):
                out = [piece.join(np.frombuffer(x or b"", "<u4"))[0].tobytes() for x in rows.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.mapInArrow(join, schema)
