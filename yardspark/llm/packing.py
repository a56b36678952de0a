"""Token-id output: documents packed into rows of fixed capacity by best-fit decreasing.

Texts are encoded with a rank vocabulary by the tiktoken library. A document longer than the capacity is split into
pieces of the capacity, losslessly: its pieces carry their number and offset. Pieces are packed by best-fit decreasing:
the longest first, each into the fullest row that still has room, which a segment tree over the free capacities finds.
Every task packs its own documents in windows of WINDOW tokens, so memory is bounded, no text or id is shuffled, and a
lost task is simply packed again; only the last rows of each window can stay partly empty.

Null and empty texts have no tokens and are in no row. Ids may be null or repeated; each row of docs is packed.
Ties go to the document that comes first. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardspark.llm._pretokens import Chunks, Table, gather, segments
from yardspark.llm._words import slices
from yardspark.llm.byte_bpe import read_ranks

#: Tokens of a row; tokens after which a task packs what it holds; distinct chunks that it remembers.
CAPACITY, WINDOW, MEMORY = 2048, 4_000_000, 300_000
SCHEMA = "pack long, n_tokens long, n_segments int, doc_ids array<long>, pieces array<int>, offsets array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class FreeSpace:
    """A segment tree over capacities 0..most: how many open rows have each free space, and the rows themselves."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        at = free + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The (free space, row) with the least free space of at least `need`, taken out."""
        at = need + self.leaves
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        free = at - self.leaves
        row = self.rows[free].pop()
        if not self.rows[free]:
            self.any[at] = 0
            while at > 1 and not self.any[at ^ 1]:
                at >>= 1
                self.any[at] = 0
        return free, row


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers; sizes are from 1 to the capacity."""
    rows: list[list[int]] = []
    space = FreeSpace(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        free, row = space.take(sizes[i]) or (capacity, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        if free > sizes[i]:
            space.add(free - sizes[i], row)
    return rows


def pack_documents(docs: DataFrame, vocabulary: str, split_pattern: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows of at most `capacity` tokens.

    input_ids and position_ids hold little-endian unsigned 32-bit integers; positions start again at 0 in every segment
    that cu_seqlens (0, then the running ends) marks. doc_ids, pieces and offsets name each segment's document, the number
    of its piece and the piece's first token. pack is unique within the result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=split_pattern, mergeable_ranks=sent.value, special_tokens={})
        memory = Table.empty()

        def encoded(texts: list[bytes]) -> list[np.ndarray]:
            """The ids of some texts: distinct chunks are encoded once and remembered."""
            nonlocal memory
            cut = [(i, part) for i, t in enumerate(texts) for part in segments(t)]
            found = Chunks([part for _, part in cut])
            if len(memory.code) > MEMORY:
                memory = Table.empty()
            at = memory.find(found.code, found.check)
            new = np.flatnonzero(at < 0)
            each = [coder.encode_ordinary(c.decode()) for c in found.take(new)]
            n, ids = np.array([len(x) for x in each], np.int64), np.array([i for x in each for i in x], "<u4")
            start, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            start[at >= 0], size[at >= 0] = memory.start[at[at >= 0]], memory.size[at[at >= 0]]
            start[new], size[new] = len(memory.flat) + np.cumsum(n) - n, n
            memory = memory.with_more(found.code[new], found.check[new], n, ids)
            ends = np.cumsum(np.bincount(np.repeat(np.array([i for i, _ in cut], np.int64), found.per_text), size[found.number], minlength=len(texts)).astype(np.int64))
            return np.split(gather(memory.flat, start[found.number], size[found.number]), ends[:-1])

        def packed(held: list[tuple], first: int) -> tuple[pa.RecordBatch, int]:
            rows = best_fit_decreasing([len(h[3]) // 4 for h in held], capacity)
            members = [[held[i] for i in row] for row in rows]
            lengths = [[len(h[3]) // 4 for h in m] for m in members]
            steps = np.arange(capacity, dtype="<u4")
            ends = [np.concatenate(([0], np.cumsum(n))).astype(np.int32) for n in lengths]
            columns = [
                pa.array(range(first, first + len(rows)), pa.int64()), pa.array([int(e[-1]) for e in ends], pa.int64()), pa.array([len(m) for m in members], pa.int32()),
                pa.array([[h[0] for h in m] for m in members], pa.list_(pa.int64())), pa.array([[h[1] for h in m] for m in members], pa.list_(pa.int32())),
                pa.array([[h[2] for h in m] for m in members], pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int32())),
                pa.array([b"".join(h[3] for h in m) for m in members], pa.binary()), pa.array([b"".join(steps[:n].tobytes() for n in s) for s in lengths], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["pack", "n_tokens", "n_segments", "doc_ids", "pieces", "offsets", "cu_seqlens", "input_ids", "position_ids"]), first + len(rows)

        held: list[tuple] = []
        size = number = 0
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                keys = batch.column(0).slice(first, len(texts)).to_pylist()
                for key, own in zip(keys, encoded(texts), strict=True):
                    for piece, at in enumerate(range(0, len(own), capacity)):
                        held.append((key, piece, at, own[at : at + capacity].tobytes()))
                    size += len(own)
                    if size >= WINDOW:
                        out, number = packed(held, number)
                        yield out
                        held, size = [], 0
        if held:
            yield packed(held, number)[0]

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
    return rows.withColumn("pack", F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("pack"))


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet: one matrix row each, with segment lengths and position resets."""
    packed.write.parquet(path)
